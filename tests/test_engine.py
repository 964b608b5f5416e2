import pytest

from relgrid.domain import Object, Subject, Tuple
from relgrid.engine import Engine, Tenants
from relgrid.errors import ArtifactError, ConsistencyError, EvaluationError, PolicyTextError, RelgridError, SchemaError, StoreError
from relgrid.functions.columns import COLUMNS, SCHEMA
from relgrid.operators.store import Mutation, Precondition, SubjectFilter, TupleFilter
from relgrid.plans.fixpoint import Limits
from relgrid.sources import artifact
from relgrid.sources.text import PolicyText, read_tuples

PORT = """
namespace quay { relation lit {} }
namespace ship {
    relation captain {} relation pilot {} relation berth {} relation barred {}
    relation board { rewrite union(this, computed_userset(relation: "captain"), computed_userset(relation: "pilot"), tuple_to_userset(tupleset: "berth", computed_userset: "lit")) }
    relation steer { rewrite intersection(computed_userset(relation: "captain"), computed_userset(relation: "pilot")) }
    relation sail { rewrite exclusion(computed_userset(relation: "board"), computed_userset(relation: "barred")) }
}
"""
CREWS = """
namespace crew { relation hand {} }
namespace fleet { relation flies {} relation signals { rewrite computed_userset(relation: "flies") } }
namespace ship {
    relation under {} relation mans {} relation barred {}
    relation works { rewrite exclusion(union(computed_userset(relation: "mans"), tuple_to_userset(tupleset: "under", computed_userset: "signals")), computed_userset(relation: "barred")) }
}
"""


def engine(spark, dsl, *tuples, **options):
    e = Engine(spark, **options)
    e.apply_schema(dsl)
    if tuples:
        e.write([Mutation("create", Tuple.parse(t)) for t in tuples])
    return e


def ids(frame, column="resource_id"):
    return sorted(r[column] for r in frame.collect())


def code(f):
    with pytest.raises(RelgridError) as e:
        f()
    return type(e.value), e.value.code


@pytest.fixture(scope="module")
def port(spark):
    return engine(spark, PORT, "ship:argo#captain@user:ida", "ship:argo#pilot@user:ora", "ship:argo#board@user:pia", "ship:argo#berth@quay:north#lit", "quay:north#lit@user:una", "ship:argo#barred@user:ora", "ship:argo#pilot@user:ida")


@pytest.fixture(scope="module")
def crews(spark):
    return engine(spark, CREWS, "crew:red#hand@user:ida", "fleet:west#flies@crew:red#hand", "ship:tern#under@fleet:west#signals", "ship:gull#mans@crew:red#hand", "ship:kite#mans@crew:red#hand", "ship:kite#barred@user:ida")


def test_check(spark, port):
    people = ("ida", "ora", "pia", "una", "eve")
    asked = spark.createDataFrame([("ship", "argo", r, "user", u, None) for r in ("board", "steer", "sail") for u in people], SCHEMA)
    found = {}
    for row in port.check_many(asked).collect():
        found.setdefault(row.relation, {})[row.subject_id] = row.allowed
    assert [found["board"][u] for u in people] == [True, True, True, True, False]
    assert [found["steer"][u] for u in people] == [True, False, False, False, False]
    assert [found["sail"][u] for u in people] == [True, False, True, True, False]
    assert port.check(Object("ship", "argo"), "sail", Subject.user("una")) and not port.check(Object("ship", "argo"), "sail", Subject.user("ora"))


def test_unknown_names(port):
    assert code(lambda: port.check(Object("ship", "x"), "nope", Subject.user("a"))) == (SchemaError, "relation_not_found")
    assert code(lambda: port.check(Object("nope", "x"), "board", Subject.user("a"))) == (SchemaError, "namespace_not_found")
    assert code(lambda: port.lookup_subjects(Object("ship", "x"), "board", "nope")) == (SchemaError, "namespace_not_found")


def flat(tree):
    return tree.value if tree.value else [tree.kind, *map(flat, tree.children)]


def test_expand(port):
    argo = Object("ship", "argo")
    assert flat(port.expand(argo, "board")) == ["union", ["union", "user:pia"], ["union", "user:ida"], ["union", "user:ida", "user:ora"], ["union", ["union", "user:una"]]]
    assert flat(port.expand(argo, "steer")) == ["intersection", ["union", "user:ida"], ["union", "user:ida", "user:ora"]]
    assert flat(port.expand(argo, "sail"))[0] == "exclusion"


def test_group_lookups(crews):
    ida = Subject.user("ida")
    assert ids(crews.lookup_resources(ida, "works", "ship")) == ["gull", "tern"]
    assert crews.lookup_permissions(ida, Object("ship", "gull")) == ["mans", "works"]
    assert crews.lookup_permissions(ida, Object("ship", "tern")) == ["under", "works"]
    assert ids(crews.lookup_subjects(Object("ship", "tern"), "works", "user"), "subject_id") == ["ida"]
    assert ids(crews.lookup_subjects(Object("ship", "tern"), "works", "crew"), "subject_id") == ["red"]
    assert crews.check(Object("ship", "gull"), "mans", Subject.parse("crew:red#hand"))
    assert not crews.check(Object("crew", "red"), "hand", Subject.parse("crew:red#hand"))
    assert crews.lookup_object_permissions(Object("ship", "gull"), "user") == {"works": ["user:ida"], "mans": ["user:ida"]}
    assert flat(crews.expand(Object("ship", "gull"), "mans")) == ["union", "crew:red#hand"]


def test_limits_are_flagged(crews):
    rows = crews.lookup_resources(Subject.user("ida"), "works", "ship", 1).collect()
    assert [(r.resource_id, r.truncated) for r in rows] == [("gull", True)]


def test_tuple_links_ignore_the_stored_relation(spark):
    dsl = 'namespace folder { relation owner {} relation viewer {} } namespace doc { relation parent {} relation can_view { rewrite tuple_to_userset(tupleset: "parent", computed_userset: "viewer") } }'
    e = engine(spark, dsl, "doc:a#parent@folder:x#owner", "folder:x#viewer@user:u", "doc:b#parent@folder:x")
    assert e.check(Object("doc", "a"), "can_view", Subject.user("u"))
    assert not e.check(Object("doc", "b"), "can_view", Subject.user("u"))


def test_rewrite_without_this_ignores_own_tuples(spark):
    e = engine(spark, 'namespace d { relation a {} relation b { rewrite computed_userset(relation: "a") } }', "d:1#b@user:u", "d:2#a@user:u")
    assert ids(e.lookup_resources(Subject.user("u"), "b", "d")) == ["2"]


def test_user_with_relation_grants_the_user(spark):
    e = engine(spark, "namespace user { relation friend {} } namespace d { relation v {} }", "d:1#v@user:alice#friend", "user:alice#friend@user:bob")
    assert all(e.check(Object("d", "1"), "v", s) for s in (Subject.user("alice"), Subject.user("bob"), Subject.parse("user:alice#friend")))


def test_plain_objects(spark):
    e = engine(spark, "namespace group { relation member {} } namespace d { relation v {} }", "d:1#v@group:eng", "d:1#v@user:u", "d:2#v@user:u")
    assert e.check(Object("d", "1"), "v", Subject.user("u"))
    assert code(lambda: e.lookup_subjects(Object("d", "1"), "v", "user")) == (EvaluationError, "plain_subject")
    assert code(lambda: e.expand(Object("d", "1"), "v")) == (EvaluationError, "plain_subject")
    assert ids(e.lookup_subjects(Object("d", "2"), "v", "user"), "subject_id") == ["u"]


def test_cycles(spark):
    e = engine(spark, 'namespace d { relation v { rewrite computed_userset(relation: "v") } relation a { rewrite computed_userset(relation: "b") } relation b { rewrite computed_userset(relation: "a") } relation m {} }', "d:1#m@d:2#m", "d:2#m@d:1#m", "d:2#m@user:u")
    assert not e.check(Object("d", "1"), "v", Subject.user("u")) and not e.check(Object("d", "1"), "a", Subject.user("u"))
    assert flat(e.expand(Object("d", "1"), "v")) == ["union"] == flat(e.expand(Object("d", "1"), "a"))
    assert ids(e.lookup_resources(Subject.user("u"), "m", "d")) == ["1", "2"]


def test_memo_of_denials_does_not_leak(spark):
    dsl = 'namespace t { relation c {} relation a { rewrite union(computed_userset(relation: "b"), computed_userset(relation: "c")) } relation b { rewrite computed_userset(relation: "a") } relation d { rewrite computed_userset(relation: "b") } }'
    e = engine(spark, dsl, "t:1#c@user:alice")
    assert e.lookup_permissions(Subject.user("alice"), Object("t", "1")) == ["a", "b", "c", "d"]


def test_depth_guard(spark):
    dsl = 'namespace d { relation p {} relation v { rewrite union(this, tuple_to_userset(tupleset: "p", computed_userset: "v")) } }'
    chain = [f"d:{k}#p@d:{k + 1}#v" for k in range(5)] + ["d:5#v@user:u"]
    assert engine(spark, dsl, *chain).check(Object("d", "0"), "v", Subject.user("u"))
    short = engine(spark, dsl, *chain, limits=Limits(depth=1))
    assert code(lambda: short.check(Object("d", "0"), "v", Subject.user("u"))) == (EvaluationError, "depth")


def test_depth_guard_without_recursion(spark):
    """A request with a proof within the depth is allowed, others are errors where the depth cut them."""
    dsl = 'namespace shelf { relation a {} relation b { rewrite union(this, computed_userset(relation: "a")) } relation c { rewrite union(this, computed_userset(relation: "b")) } }'
    rows = ("shelf:x#a@user:low", "shelf:x#b@user:mid", "shelf:x#c@user:top")
    ask = lambda e, u: e.check(Object("shelf", "x"), "c", Subject.user(u))
    e = engine(spark, dsl, *rows, limits=Limits(depth=2))
    assert ask(e, "top") and ask(e, "mid")
    assert code(lambda: ask(e, "low")) == code(lambda: ask(e, "none")) == (EvaluationError, "depth")
    assert code(lambda: e.lookup_subjects(Object("shelf", "x"), "c", "user")) == (EvaluationError, "depth")
    assert code(lambda: e.lookup_permissions(Subject.user("none"), Object("shelf", "x"))) == (EvaluationError, "depth")
    deep = engine(spark, dsl, *rows, limits=Limits(depth=3))
    assert [ask(deep, u) for u in ("low", "mid", "top", "none")] == [True, True, True, False]
    ring = engine(spark, 'namespace d { relation p {} relation no {} relation v { rewrite exclusion(tuple_to_userset(tupleset: "p", computed_userset: "v"), computed_userset(relation: "no")) } }', "d:1#p@d:1#v", "d:1#no@user:u", limits=Limits(depth=2))
    assert not ring.check(Object("d", "1"), "v", Subject.user("u"))


def test_fanout_guard(spark):
    dsl = 'namespace crew { relation hand {} } namespace dock { relation near {} relation use {} relation any { rewrite union(computed_userset(relation: "use"), tuple_to_userset(tupleset: "near", computed_userset: "use")) } }'
    rows = [*(f"dock:wide#use@crew:k{k}#hand" for k in range(3)), *(f"dock:flat#use@user:u{k}" for k in range(9)), "dock:flat#use@crew:k0#hand", "dock:wide#use@user:ann", "crew:k2#hand@user:bea", "dock:by#near@dock:wide#use", "dock:far#near@dock:flat#use"]
    e = engine(spark, dsl, *rows, limits=Limits(fanout=2))
    ask = lambda o, r, u: e.check(Object("dock", o), r, Subject.user(u))
    assert ask("wide", "use", "ann") and ask("wide", "use", "bea") and ask("by", "any", "bea")
    assert code(lambda: ask("wide", "use", "zed")) == code(lambda: ask("by", "any", "zed")) == (EvaluationError, "fanout")
    assert ask("flat", "use", "u3") and not ask("flat", "use", "zed") and not ask("far", "any", "zed")  # users aren't followed
    many = spark.createDataFrame([("dock", o, "any", "user", u, None) for o, u in (("far", "zed"), ("by", "bea"), ("flat", "u1"))], SCHEMA)
    assert sorted((r.resource_id, r.allowed) for r in e.check_many(many).collect()) == [("by", True), ("far", False), ("flat", True)]
    assert code(lambda: e.check_many(many.union(spark.createDataFrame([("dock", "by", "any", "user", "zed", None)], SCHEMA)))) == (EvaluationError, "fanout")
    assert code(lambda: e.lookup_permissions(Subject.user("zed"), Object("dock", "by"))) == (EvaluationError, "fanout")
    assert e.lookup_permissions(Subject.user("zed"), Object("dock", "far")) == []
    assert code(lambda: e.lookup_subjects(Object("dock", "flat"), "use", "user")) == (EvaluationError, "fanout")  # all rows count here
    assert code(lambda: e.lookup_object_permissions(Object("dock", "by"), "user")) == (EvaluationError, "fanout")
    assert ids(e.lookup_subjects(Object("crew", "k2"), "hand", "user"), "subject_id") == ["bea"]
    assert code(lambda: e.expand(Object("dock", "wide"), "use")) == (EvaluationError, "fanout")
    assert ids(e.lookup_resources(Subject.user("bea"), "any", "dock")) == ["by", "wide"]  # follows what leads to the subject only
    e.delete("dock:wide#use@crew:k0#hand")
    assert not ask("wide", "use", "zed")


def test_counters(spark):
    dsl = 'namespace d { relation p {} relation v { rewrite union(this, tuple_to_userset(tupleset: "p", computed_userset: "v")) } }'
    e = engine(spark, dsl, *[f"d:{k}#p@d:{k + 1}#v" for k in range(3)], "d:3#v@user:u").evaluator()
    keys = spark.createDataFrame([("d#v", "0")], "g string, gid string")
    e.evaluate([("d", "v")], [("user", "u", None)], keys)
    assert e.counters == {"reached": [1, 1, 1, 1, 0], "members": [1, 1, 1, 1, 0]}


def test_self_exclusion(spark):
    dsl = 'namespace d { relation p {} relation all {} relation v { rewrite exclusion(computed_userset(relation: "all"), tuple_to_userset(tupleset: "p", computed_userset: "v")) } }'
    e = engine(spark, dsl, "d:1#all@user:u", "d:2#all@user:u", "d:3#all@user:u", "d:1#p@d:2#v", "d:2#p@d:3#v")
    assert ids(e.lookup_resources(Subject.user("u"), "v", "d")) == ["1", "3"]
    ring = engine(spark, dsl, "d:1#all@user:u", "d:1#p@d:1#v")
    assert code(lambda: ring.check(Object("d", "1"), "v", Subject.user("u"))) == (EvaluationError, "non_stratified")


def test_missing_target(spark):
    dsl = 'namespace a { relation v {} } namespace b { relation w {} } namespace d { relation p {} relation v { rewrite tuple_to_userset(tupleset: "p", computed_userset: "v") } }'
    rows = ("d:1#p@a:1#v", "d:1#p@b:1#w", "a:1#v@user:u")
    assert code(lambda: engine(spark, dsl, *rows).check(Object("d", "1"), "v", Subject.user("u"))) == (SchemaError, "relation_not_found")
    assert engine(spark, dsl, *rows, missing="deny").check(Object("d", "1"), "v", Subject.user("u"))


def test_writes(spark):
    e = engine(spark, "namespace d { relation v {} }", "d:1#v@user:a")
    before = e.token()
    assert code(lambda: e.create("d:1#v@user:a")) == (StoreError, "exists")
    assert code(lambda: e.delete("d:9#v@user:a")) == (StoreError, "not_found")
    assert code(lambda: e.touch("d:1#w@user:a")) == (SchemaError, "relation_not_found")
    assert code(lambda: e.write([Mutation("touch", Tuple.parse("d:1#v@user:b"))] * 2)) == (StoreError, "duplicate_mutation")
    assert e.token() == before
    e.touch("d:1#v@user:a")
    e.write([Mutation("delete", Tuple.parse("d:1#v@user:a")), Mutation("create", Tuple.parse("d:2#v@user:a"))])
    e.create("d:1#v@user:a")
    e.delete("d:2#v@user:a")
    assert ids(e.tuples()) == ["1"]
    assert e.write([]).revision == before.revision + 5
    e.compact()
    assert ids(e.tuples()) == ["1"]
    e.delete("d:1#v@user:a")
    e.create("d:1#v@user:a")  # back in the base, and there once
    assert ids(e.tuples()) == ["1"]
    e.delete("d:1#v@user:a")
    assert ids(e.tuples()) == []


def test_preconditions_and_caps(spark):
    e = engine(spark, "namespace d { relation v {} }", "d:1#v@user:a")
    here, new = TupleFilter("d", "1", "v", SubjectFilter("user", "a")), [Mutation("touch", Tuple.parse("d:2#v@user:a"))]
    assert code(lambda: e.write(new, [Precondition(False, here)])) == (StoreError, "precondition")
    assert code(lambda: e.write(new, [Precondition(True, TupleFilter("d", "7"))])) == (StoreError, "precondition")
    assert code(lambda: e.write(new, [Precondition(True, here)] * 101)) == (StoreError, "too_many_preconditions")
    many = [Mutation("touch", Tuple.parse(f"d:{k}#v@user:a")) for k in range(10_001)]
    assert code(lambda: e.write(many)) == (StoreError, "too_many_mutations")
    e.write(new, [Precondition(True, here), Precondition(False, TupleFilter("d", "7"))])
    assert ids(e.tuples()) == ["1", "2"]


def test_filters(spark):
    e = engine(spark, "namespace g { relation m {} } namespace d { relation v {} relation o {} }", "d:1#v@user:a", "d:1#o@user:b", "d:2#v@g:x#m", "d:2#v@user:a")
    count = lambda f: f.count()
    assert count(e.query(TupleFilter("d"))) == 4 and count(e.query(TupleFilter("d", "1"))) == 2 and count(e.query(TupleFilter("d", relation="v"))) == 3
    assert count(e.query(TupleFilter("d"), 2)) == 2
    assert count(e.query(TupleFilter("d", subject=SubjectFilter("g", "x", "m")))) == 1
    assert count(e.reverse_query(SubjectFilter("user", "a"))) == 2 and count(e.reverse_query(SubjectFilter("g"))) == 1


def test_snapshots_by_token(spark):
    e = engine(spark, "namespace d { relation v {} }", retained=3)
    first = e.create("d:1#v@user:a")
    second = e.delete("d:1#v@user:a")
    assert ids(e.tuples(first)) == ["1"] and ids(e.tuples(str(second))) == [] == ids(e.tuples())
    other = engine(spark, "namespace d { relation v {} }")
    assert code(lambda: other.tuples(first)) == (ConsistencyError, "wrong_datastore")
    future = type(first)(99, first.schema_hash, first.datastore)
    assert code(lambda: e.tuples(future)) == (ConsistencyError, "unavailable")
    mismatched = type(first)(first.revision, "0" * 64, first.datastore)
    assert code(lambda: e.tuples(mismatched)) == (ConsistencyError, "schema_mismatch")
    for k in range(3):
        e.touch(f"d:{k}#v@user:b")
    assert code(lambda: e.tuples(first)) == (ConsistencyError, "expired")


def test_schema_changes(spark):
    e = engine(spark, PORT, "ship:argo#captain@user:a")
    assert code(lambda: e.delete_relation("ship", "captain")) == (SchemaError, "in_use")
    assert code(lambda: e.delete_relation("ship", "nope")) == (SchemaError, "relation_not_found")
    assert code(lambda: e.delete_namespace("nope")) == (SchemaError, "namespace_not_found")
    assert code(lambda: e.delete_namespace("ship")) == (SchemaError, "in_use")
    e.delete_relation("ship", "steer")
    assert "steer" not in e.state().schema.relations("ship")
    assert code(lambda: e.replace_schema("namespace other {}")) == (SchemaError, "relation_not_found")
    e.apply_schema("namespace extra { relation r {} }")
    assert sorted(e.state().schema.namespaces) == ["extra", "quay", "ship"]
    e.delete_namespace("extra")
    assert sorted(e.state().schema.namespaces) == ["quay", "ship"]


def test_policy_text(spark, tmp_path, crews):
    exported = crews.export_policy_text()
    assert sorted(exported.files) == [f"relationships/{t}.zedtuples" for t in ("crew", "fleet", "ship")]
    assert exported.files["relationships/ship.zedtuples"].splitlines() == sorted(exported.files["relationships/ship.zedtuples"].splitlines())
    e = Engine(spark)
    e.apply_policy_text(PolicyText(exported.schema, {k: "# c\n\n// d\n  " + v for k, v in exported.files.items()}))
    assert e.export_policy_text() == exported
    out = tmp_path / "out"
    for _ in range(2):  # a second export takes the first one's place
        e.export_policy_files(str(out))
    assert (out / "schema.zed").read_text() == exported.schema
    for name, contents in exported.files.items():
        assert "".join(p.read_text() for p in sorted((out / name).glob("part-*"))) == contents
    assert read_tuples(spark, str(out / "relationships" / "*")).count() == 6
    again = Engine(spark)
    again.apply_policy_files(str(out))
    assert again.export_policy_text() == exported
    assert code(lambda: e.export_policy_files("")) == (PolicyTextError, "path")
    twice = PolicyText(exported.schema, {"a": exported.files["relationships/crew.zedtuples"] * 2})
    assert code(lambda: e.apply_policy_text(twice)) == (StoreError, "exists")
    assert code(lambda: e.apply_policy_text(PolicyText(exported.schema, {"a": "nonsense\n"}))) == (PolicyTextError, "line")
    assert code(lambda: e.apply_policy_text(PolicyText(exported.schema, {"../a": ""}))) == (PolicyTextError, "path")


def test_artifacts(spark, tmp_path, crews):
    path, ida = f"file://{tmp_path}/art", Subject.user("ida")
    crews.save_snapshot(path)
    loaded = Engine.load_snapshot(spark, path)
    assert loaded.datastore != crews.datastore and loaded.token().revision == crews.token().revision
    assert ids(loaded.lookup_resources(ida, "works", "ship")) == ["gull", "tern"]
    assert all("/by_subject/" in f for f in loaded.reverse_query(SubjectFilter("user", "ida")).inputFiles())
    loaded.create("crew:red#hand@user:zoe")
    assert loaded.check(Object("ship", "gull"), "works", Subject.user("zoe"))
    assert ids(loaded.lookup_resources(Subject.user("zoe"), "works", "ship")) == ["gull", "kite", "tern"] and loaded.reverse_query(SubjectFilter("user", "zoe")).count() == 1
    Engine.load_snapshot(spark, path, validation="trusted", integrity="external")
    assert code(lambda: Engine.load_snapshot(spark, path, integrity="external")) == (ArtifactError, "options")
    assert code(lambda: Engine.load_snapshot(spark, path, validation="trusted", latency=True)) == (ArtifactError, "options")
    assert code(lambda: Engine.load_snapshot(spark, f"file://{tmp_path}/none")) == (ArtifactError, "missing")
    extra = spark.createDataFrame([("ship", "x", "mans", "user", "u", None)], SCHEMA)
    extra.write.mode("append").parquet(f"{path}/tuples")
    assert code(lambda: Engine.load_snapshot(spark, path)) == (ArtifactError, "checksum")
    crews.save_snapshot(f"file://{tmp_path}/small", profile="check_only")
    small = Engine.load_snapshot(spark, f"file://{tmp_path}/small")
    assert small.check(Object("ship", "gull"), "works", ida)
    assert code(lambda: small.lookup_resources(ida, "works", "ship")) == (ArtifactError, "unsupported")
    doubled = crews.tuples().unionByName(crews.tuples())
    artifact.save(f"file://{tmp_path}/twice", crews.state().schema, doubled, 1)
    assert code(lambda: artifact.load(spark, f"file://{tmp_path}/twice")) == (ArtifactError, "duplicate")


def test_tenants(spark):
    tenants = Tenants(lambda: Engine(spark))
    assert tenants.get("a") is None
    assert tenants.get_or_create("b") is tenants.get_or_create("b") is not tenants.get_or_create("a")
    assert tenants.tenants() == ["a", "b"]
    with pytest.raises(RelgridError):
        tenants.get_or_create("no spaces")


def test_stream(spark, tmp_path):
    from relgrid.streaming.log import follow

    e = engine(spark, "namespace d { relation v {} }", "d:1#v@user:a")
    rows = spark.createDataFrame([("touch", "d", "2", "v", "user", "a", None), ("delete", "d", "1", "v", "user", "a", None), ("delete", "d", "9", "v", "user", "a", None)], f"op string, {SCHEMA}")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = follow(e, stream.select("op", *COLUMNS), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert ids(e.tuples()) == ["2"]
