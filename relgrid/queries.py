"""One query for each operator of the engine, over tuples derived from the order tables, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgrid import fixtures
from relgrid.domain import Object, Subject, Tuple
from relgrid.engine import Engine, Tenants
from relgrid.errors import RelgridError
from relgrid.functions import columns as fn
from relgrid.functions.columns import COLUMNS, SCHEMA
from relgrid.operators import graph, stats, store
from relgrid.operators.store import Mutation, SubjectFilter, TupleFilter
from relgrid.plans import lineage, policy
from relgrid.plans.fixpoint import MEMBER, Evaluator, Limits, Prepared
from relgrid.sources import artifact, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TUPLE = ", ".join(COLUMNS)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {fixtures.SQL} {sql}"
        return f

    return add


def with_members(sql: str) -> str:
    return f", {fixtures.MEMBERS_SQL} {sql}"


_STORED: dict[tuple[str, str], str] = {}


def _tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuples as an engine stores them: a table by type and relation in the shared folder, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not lineage.exists(spark, _STORED[key]):
        _STORED[key] = lineage.written(fixtures.tuples(spark, sf_dir), ("resource_type", "relation"), lasting=True)
    return spark.read.schema(SCHEMA).parquet(_STORED[key]).select(COLUMNS)


def _evaluator(spark: SparkSession, sf_dir: str, limits: Limits | None = None) -> Evaluator:
    return Evaluator(policy.compile_policy(fixtures.POLICY), _tuples(spark, sf_dir), limits)


#: For groups and nations with more subjects than the guard lets a lookup follow.
WIDE = Limits(fanout=1 << 40)


def _engine(spark: SparkSession, sf_dir: str, **options: object) -> Engine:
    engine = Engine(spark, **options)
    engine.replace_all(fixtures.POLICY, _tuples(spark, sf_dir))
    return engine


def _outcome(f: Callable[[], object]) -> str:
    """What a call ends with: ok, or its error's code."""
    try:
        f()
    except RelgridError as e:
        return e.code
    return "ok"


def _values(*rows: tuple) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)


def _members(f: DataFrame) -> DataFrame:
    return f.withColumn("subject_relation", F.nullif("subject_relation", F.lit("")))


_ORDERS_OF = """SELECT resource_id FROM (
  SELECT resource_id FROM t WHERE resource_type = 'order' AND relation = 'owner' AND subject_id = '{u}'
  UNION SELECT p.resource_id FROM t p JOIN nv ON p.resource_type = 'order' AND p.relation = 'parent' AND p.subject_id = nv.n AND nv.st = 'user' AND nv.si = '{u}') o
  WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.resource_type = 'order' AND b.relation = 'banned' AND b.resource_id = o.resource_id AND b.subject_id = '{u}')"""


# -- sources and sinks


@query(f"SELECT {TUPLE} FROM t")
def rel01_tuple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _tuples(spark, sf_dir).select(F.concat(F.lit("  "), fn.format_relationship(), F.lit(" \t")).alias("value"))
    noise = spark.createDataFrame([("",), ("# comment",), ("  // comment",)], "value string")
    return text.checked(text.parse_lines(lines.union(noise)))


@query("SELECT resource_type, count(*) AS n, count(DISTINCT line) AS n_distinct FROM line GROUP BY resource_type")
def rel02_policy_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported to files, and taken in from them by another engine."""
    path = f"{lineage.shared_dir(spark)}/policy-{uuid.uuid4().hex}"
    _engine(spark, sf_dir).export_policy_files(lineage.remove_at_exit(spark, path))
    engine = Engine(spark)
    engine.apply_policy_files(path)
    return engine.tuples().withColumn("line", fn.format_relationship()).groupBy("resource_type").agg(F.count("*").alias("n"), F.count_distinct("line").alias("n_distinct"))


@query("SELECT * FROM (VALUES ('group','member'),('nation','banned'),('nation','can_view'),('nation','editor'),('nation','parent'),('nation','viewer'),('order','banned'),('order','can_edit'),('order','can_view'),('order','owner'),('order','owner_view'),('order','parent'),('order','viewer'),('part','can_view'),('part','parent'),('part','viewer'),('region','viewer')) v(namespace, relation)")
def rel03_policy_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations in byte order, through text and back."""
    return spark.createDataFrame(policy.compile_policy(policy.text(policy.compile_policy(fixtures.POLICY))).pairs(), "namespace string, relation string")


@query("SELECT resource_type, md5(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS contents_md5, count(*) AS n_lines FROM line GROUP BY resource_type")
def rel05_policy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.export_digests(_tuples(spark, sf_dir))


@query("SELECT resource_type, line FROM line")
def rel06_policy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.export_lines(_tuples(spark, sf_dir))


#: A log over the tuples: revision 1 creates all, 2 deletes order owners with an odd key, 3 touches those divisible by 3 again.
LOG_SQL = "l AS (SELECT *, (CASE WHEN resource_type = 'order' AND relation = 'owner' AND resource_id::BIGINT % 2 = 1 THEN CASE WHEN resource_id::BIGINT % 3 = 0 THEN 3 ELSE 2 END ELSE 1 END) AS last FROM t)"


def _log(t: DataFrame) -> DataFrame:
    odd = t.where("resource_type = 'order' and relation = 'owner' and cast(resource_id as bigint) % 2 = 1")
    step = lambda f, r, op: f.select(F.lit(r).cast("long").alias("revision"), F.lit(0).alias("ordinal"), F.lit(op).alias("op"), *COLUMNS)
    return step(t, 1, "create").union(step(odd, 2, "delete")).union(step(odd.where("cast(resource_id as bigint) % 3 = 0"), 3, "touch"))


@query(f", {LOG_SQL} SELECT {TUPLE} FROM l WHERE last <> 2")
def rel07_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tuples(spark, sf_dir)
    return store.as_of(t.limit(0), _log(t), 3)


@query(f", {LOG_SQL} SELECT {TUPLE} FROM l WHERE last = 1")
def rel08_snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tuples(spark, sf_dir)
    return store.as_of(t.limit(0), _log(t), 2)


@query()
def rel09_artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved with every profile's layout, validated on reading (sources/artifact.py); the rows are those saved."""
    path = lineage.remove_at_exit(spark, f"{lineage.shared_dir(spark)}/artifact-{uuid.uuid4().hex}")
    artifact.save(path, policy.compile_policy(fixtures.POLICY), _tuples(spark, sf_dir), 1)
    return artifact.load(spark, path).tuples


SQL["rel09_artifact_round_trip"] = f"WITH {fixtures.SQL} SELECT {TUPLE} FROM t"


@query(f"SELECT * FROM (VALUES {_values(('as saved', 'full', 'checksum', 'ok'), ('as saved', 'trusted', 'external', 'ok'), ('as saved', 'full', 'external', 'options'), ('as saved', 'half', 'checksum', 'options'), ('trusted, for low latency', 'trusted', 'checksum', 'options'), ('rows added', 'full', 'checksum', 'checksum'), ('rows added', 'trusted', 'external', 'ok'), ('rows twice', 'full', 'checksum', 'duplicate'), ('rows twice', 'trusted', 'checksum', 'ok'), ('not in the schema', 'full', 'checksum', 'invalid_rows'), ('nothing', 'full', 'checksum', 'missing'))}) v(artifact, validation, integrity, outcome)")
def rel11_validation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What loading an artifact ends with, for artifacts that are whole and broken."""
    schema, t = policy.compile_policy(fixtures.POLICY), _tuples(spark, sf_dir)
    base = lineage.remove_at_exit(spark, f"{lineage.shared_dir(spark)}/artifacts-{uuid.uuid4().hex}")
    strange = t.where("resource_type = 'region'").withColumn("relation", F.lit("unheard_of"))
    for name, rows in {"as saved": t, "rows added": t, "rows twice": t.union(t), "not in the schema": t.union(strange)}.items():
        artifact.save(f"{base}/{name}", schema, rows, 1, "check_only")
    strange.write.mode("append").parquet(f"{base}/rows added/tuples")
    asked = [(a, v, i, False) for a in ("as saved", "rows added", "rows twice", "not in the schema", "nothing") for v, i in (("full", "checksum"), ("trusted", "external"), ("trusted", "checksum"), ("full", "external"), ("half", "checksum"))]
    wanted = {("as saved", "full", "checksum"), ("as saved", "trusted", "external"), ("as saved", "full", "external"), ("as saved", "half", "checksum"), ("rows added", "full", "checksum"), ("rows added", "trusted", "external"), ("rows twice", "full", "checksum"), ("rows twice", "trusted", "checksum"), ("not in the schema", "full", "checksum"), ("nothing", "full", "checksum")}
    out = [(a, v, i, _outcome(lambda a=a, v=v, i=i: artifact.load(spark, f"{base}/{a}", v, i))) for a, v, i, _ in asked if (a, v, i) in wanted]
    out.append(("trusted, for low latency", "trusted", "checksum", _outcome(lambda: artifact.load(spark, f"{base}/as saved", "trusted", latency=True))))
    return spark.createDataFrame(out, "artifact string, validation string, integrity string, outcome string")


@query(with_members(f"""SELECT profile, by_subject, outcome, (SELECT count(*) FROM t WHERE subject_type = 'user' AND subject_id = 'c1') AS tuples_of_c1,
  CASE WHEN outcome = 'ok' THEN (SELECT count(*) FROM ({_ORDERS_OF.format(u='c1')})) END AS orders_of_c1 FROM (VALUES ('full', true, 'ok'), ('check_only', false, 'unsupported'), ('check_and_object_audit', false, 'unsupported')) v(profile, by_subject, outcome)"""))
def rel12_index_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a loaded artifact can do by its profile, and whether its tuples are read by subject."""
    saved, out = _engine(spark, sf_dir), []
    for profile in artifact.PROFILES:
        path = lineage.remove_at_exit(spark, f"{lineage.shared_dir(spark)}/artifact-{uuid.uuid4().hex}")
        saved.save_snapshot(path, profile)
        engine = Engine.load_snapshot(spark, path)
        tuples = engine.reverse_query(SubjectFilter("user", "c1"))
        orders = lambda engine=engine: engine.lookup_resources(Subject.user("c1"), "can_view", "order", 1 << 30)
        outcome = _outcome(orders)
        out.append((profile, any("/by_subject/" in f for f in tuples.inputFiles()), outcome, tuples.count(), orders().count() if outcome == "ok" else None))
    return spark.createDataFrame(out, "profile string, by_subject boolean, outcome string, tuples_of_c1 long, orders_of_c1 long")


@query("SELECT o_orderpriority AS benchmark, max(o_orderkey) AS run, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_orderpriority")
def rel15_history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("benchmark"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("value"))
    last = orders.groupBy("benchmark").agg(F.max("run").alias("run"), F.max_by("value", "run").alias("value"))
    first = orders.groupBy("benchmark").agg(F.min("run").alias("run"), F.min_by("value", "run").alias("value"))
    return stats.upsert(first, last, ["benchmark"])


# -- filters and probes


@query(f"SELECT {TUPLE} FROM t WHERE resource_type = 'order' AND relation = 'parent' AND subject_type = 'nation' AND subject_id = '3'")
def rel16_resource_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.query(_tuples(spark, sf_dir), TupleFilter("order", relation="parent", subject=SubjectFilter("nation", "3")), None)


@query(f"SELECT {TUPLE} FROM t WHERE subject_type = 'user' AND subject_id = 'c1'")
def rel17_subject_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.reverse_query(_tuples(spark, sf_dir), SubjectFilter("user", "c1"))


@query("SELECT o_orderkey::VARCHAR AS resource_id FROM orders WHERE EXISTS (SELECT 1 FROM t WHERE resource_type = 'order' AND relation = 'banned' AND resource_id = o_orderkey::VARCHAR AND subject_id = 'c' || o_custkey)")
def rel18_exact_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    none = F.lit(None).cast("string")
    probes = orders.select(F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lit("banned").alias("relation"), F.lit("user").alias("subject_type"), F.concat(F.lit("c"), "o_custkey").alias("subject_id"), none.alias("subject_relation"))
    return store.existing(_tuples(spark, sf_dir), probes).select("resource_id")


@query("SELECT 'c' || c_custkey AS subject_id FROM customer WHERE EXISTS (SELECT 1 FROM t WHERE subject_type = 'user' AND subject_id = 'c' || c_custkey AND resource_type = 'order')")
def rel19_subject_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("user").alias("subject_type"), F.concat(F.lit("c"), "c_custkey").alias("subject_id"), F.lit(None).cast("string").alias("subject_relation"))
    return store.existing_subjects(_tuples(spark, sf_dir).where("resource_type = 'order'"), users).select("subject_id")


@query("SELECT relation, count(*) FILTER (subject_relation IS NOT NULL) AS usersets, count(*) FILTER (subject_type = 'user' AND subject_relation IS NULL) AS users, count(*) FILTER (subject_type <> 'user' AND subject_relation IS NULL) AS objects FROM t GROUP BY relation")
def rel20_subject_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(spark, sf_dir).groupBy("relation").agg(F.count_if(fn.is_userset()).alias("usersets"), F.count_if(fn.is_user()).alias("users"), F.count_if(fn.is_plain_object()).alias("objects"))


@query("SELECT resource_type || ':' || resource_id AS object, relation, subject_type || ':' || subject_id || coalesce('#' || subject_relation, '') AS subject FROM t")
def rel21_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(spark, sf_dir).select(F.concat_ws(":", "resource_type", "resource_id").alias("object"), "relation", fn.format_subject().alias("subject"))


@query("SELECT 'must_match' AS kind, EXISTS (SELECT 1 FROM t WHERE resource_type = 'order' AND relation = 'banned') AS holds UNION ALL SELECT 'must_not_match', NOT EXISTS (SELECT 1 FROM t WHERE resource_type = 'part' AND relation = 'viewer' AND subject_id = 's1')")
def rel22_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tuples(spark, sf_dir)
    given = {"must_match": store.Precondition(True, TupleFilter("order", relation="banned")), "must_not_match": store.Precondition(False, TupleFilter("part", relation="viewer", subject=SubjectFilter("user", "s1")))}
    return spark.createDataFrame([(k, store.failed_precondition(t, [p]) is None) for k, p in given.items()], "kind string, holds boolean")


# -- joins and rewrites


def _node(spark: SparkSession, sf_dir: str, kind: str, relation: str, subjects: list | None = None) -> DataFrame:
    return _members(_evaluator(spark, sf_dir).evaluate([(kind, relation)], subjects)[(kind, relation)])


@query("SELECT resource_id, subject_type, subject_id, subject_relation FROM t WHERE resource_type = 'order' AND relation = 'owner'")
def rel25_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node(spark, sf_dir, "order", "owner")


@query(with_members("SELECT r AS resource_id, st AS subject_type, si AS subject_id, sr AS subject_relation FROM rv"))
def rel26_nested_usersets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node(spark, sf_dir, "region", "viewer")


@query("SELECT resource_id, subject_type, subject_id, subject_relation FROM t o WHERE resource_type = 'order' AND relation = 'owner' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.resource_type = 'order' AND b.relation = 'banned' AND b.resource_id = o.resource_id AND b.subject_id = o.subject_id)")
def rel27_computed_and_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node(spark, sf_dir, "order", "can_edit")


@query(with_members("SELECT n AS resource_id, st AS subject_type, si AS subject_id, sr AS subject_relation FROM nv"))
def rel28_via_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node(spark, sf_dir, "nation", "can_view")


@query(with_members("SELECT n AS resource_id, st AS subject_type, si AS subject_id, sr AS subject_relation FROM nraw EXCEPT SELECT n, st, si, sr FROM nv"))
def rel29_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exclusion takes away."""
    e = _evaluator(spark, sf_dir)
    whole = policy.Union((policy.Computed("editor"), policy.Computed("viewer"), policy.ViaTuples("parent", "viewer")))
    found = e.evaluate([("nation", "can_view")])[("nation", "can_view")]
    return _members(e._expression(("nation", "can_view"), whole, e.members, e.members).join(found, MEMBER, "left_anti"))


@query("SELECT resource_type, relation, count(*) AS n FROM (SELECT resource_type, relation FROM t WHERE NOT (resource_type = 'nation' AND relation = 'banned') UNION ALL SELECT 'order', 'viewer' FROM t WHERE resource_type = 'order' AND relation = 'banned') GROUP BY resource_type, relation")
def rel30_delta_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tuples(spark, sf_dir)
    inserted = t.where("resource_type = 'order' and relation = 'banned'").withColumn("relation", F.lit("viewer"))
    live = store.overlay(t, t.where("resource_type = 'nation' and relation = 'banned'"), inserted)
    return live.groupBy("resource_type", "relation").agg(F.count("*").alias("n"))


@query(f"SELECT {TUPLE} FROM t WHERE resource_type = 'part' OR subject_type = 'part'")
def rel31_schema_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples that a schema without parts leaves without a relation."""
    schema = policy.compile_policy(fixtures.POLICY)
    return store.broken_references(_tuples(spark, sf_dir), policy.Schema({n: r for n, r in schema.namespaces.items() if n != "part"}))


# -- aggregates and order


@query("SELECT DISTINCT subject_type, subject_id, subject_relation FROM t")
def rel32_distinct_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(spark, sf_dir).select(COLUMNS[3:]).distinct()


@query("SELECT resource_id, bool_or(relation = 'banned') AS any_banned, bool_and(subject_type = 'user') AS all_users FROM t WHERE resource_type = 'order' GROUP BY resource_id")
def rel33_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tuples(spark, sf_dir).where("resource_type = 'order'")
    return rows.groupBy("resource_id").agg(F.bool_or(F.col("relation") == "banned").alias("any_banned"), F.bool_and(F.col("subject_type") == "user").alias("all_users"))


@query(with_members("""SELECT relation, count(DISTINCT si) AS n, md5(string_agg(DISTINCT si, ',' ORDER BY si)) AS subjects_md5 FROM (
  SELECT relation, 'user:' || subject_id AS si FROM t WHERE resource_type = 'nation' AND resource_id = '0' AND subject_type = 'user'
  UNION ALL SELECT 'can_view', 'user:' || si FROM nv WHERE n = '0' AND st = 'user'
  UNION ALL SELECT 'parent', 'user:' || si FROM rv JOIN t ON t.resource_type = 'nation' AND t.resource_id = '0' AND t.relation = 'parent' AND t.subject_id = rv.r WHERE st = 'user') GROUP BY relation"""))
def rel34_subjects_by_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.lookup_object_permissions(_evaluator(spark, sf_dir, WIDE), Object("nation", "0"), "user")
    return found.select("relation", F.size("subjects").cast("long").alias("n"), F.md5(F.array_join("subjects", ",")).alias("subjects_md5"))


@query("SELECT resource_id, count(*) AS n, count(*) > 1000 AS over FROM t WHERE resource_type = 'group' AND relation = 'member' GROUP BY resource_id")
def rel36_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach_counts(_evaluator(spark, sf_dir), ("group", "member"), usersets_only=False)


def _histogram_sql() -> str:
    low = (0, *stats.BUCKETS)
    cases = ", ".join(f"count(*) FILTER (n > {a} AND n <= {b}) AS b{k}" for k, (a, b) in enumerate(zip(low, stats.BUCKETS, strict=False)))
    return " UNION ALL ".join(f"SELECT '{name}' AS index_name, count(*) AS keys, sum(n)::BIGINT AS total, max(n) AS largest, {cases}, count(*) FILTER (n > {stats.BUCKETS[-1]}) AS b{len(stats.BUCKETS)} FROM (SELECT count(*) AS n FROM t GROUP BY {', '.join(key)})" for name, key in stats.INDEXES.items())


@query(_histogram_sql())
def rel37_posting_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histograms(_tuples(spark, sf_dir))


@query("SELECT a AS base_rows, b AS inserted_rows, c AS deleted_rows, a - c + b AS live_rows, c * 10000 // a AS tombstone_bps FROM (SELECT count(*) AS a, count(*) FILTER (resource_type = 'order' AND relation = 'banned') AS b, count(*) FILTER (resource_type = 'nation' AND relation = 'banned') AS c FROM t)")
def rel38_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tuples(spark, sf_dir)
    return stats.delta_stats(t, t.where("resource_type = 'nation' and relation = 'banned'"), t.where("resource_type = 'order' and relation = 'banned'"))


@query("SELECT depth AS round, count(*) AS rows FROM (WITH RECURSIVE w AS (SELECT resource_id AS p, 0 AS depth FROM t WHERE resource_type = 'part' AND relation = 'viewer' AND subject_id = 's1' UNION ALL SELECT a.resource_id, depth + 1 FROM t a JOIN w ON a.resource_type = 'part' AND a.relation = 'parent' AND a.subject_id = w.p) SELECT * FROM w) GROUP BY depth UNION ALL SELECT max(length(p_partkey::VARCHAR)), 0 FROM part WHERE p_partkey::VARCHAR LIKE '1%'")
def rel39_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found in each round of a recursive evaluation; the last finds none."""
    evaluator = _evaluator(spark, sf_dir)
    evaluator.evaluate([("part", "can_view")], [("user", "s1", None)])
    return spark.createDataFrame(list(enumerate(evaluator.counters["members"])), "round int, rows long").withColumn("round", F.col("round").cast("int"))


@query("SELECT resource_type AS namespace, line, row_number() OVER (PARTITION BY resource_type ORDER BY line) - 1 AS ordinal FROM line")
def rel45_canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exported line with its place in its file."""
    return text.numbered_lines(_tuples(spark, sf_dir)).select(F.col("resource_type").alias("namespace"), "line", "ordinal")


@query("SELECT namespace, relation, row_number() OVER (PARTITION BY namespace ORDER BY relation) - 1 AS ordinal FROM (VALUES ('order','viewer'),('order','parent'),('order','owner_view'),('order','owner'),('order','can_view'),('order','can_edit'),('order','banned'),('nation','viewer'),('nation','parent'),('nation','editor'),('nation','can_view'),('nation','banned'),('part','viewer'),('part','parent'),('part','can_view'),('group','member'),('region','viewer')) v(namespace, relation)")
def rel42_sorted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of each namespace in byte order of their names."""
    schema = policy.compile_policy(fixtures.POLICY)
    return spark.createDataFrame([(n, r, k) for n in schema.namespaces for k, r in enumerate(schema.relations(n))], "namespace string, relation string, ordinal long")


@query("SELECT o_orderpriority, o_totalprice AS value FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, floor(0.95 * (count(*) OVER (PARTITION BY o_orderpriority) - 1)) AS wanted FROM orders) WHERE r = wanted")
def rel40_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_rank(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority"], "o_totalprice", 0.95)


@query("SELECT o_custkey, latest, previous, round(CASE WHEN previous <> 0 THEN (latest - previous) / previous * 100 END, 6) AS change_pct FROM (SELECT o_custkey, max(p) FILTER (r = 1) AS latest, max(p) FILTER (r = 2) AS previous FROM (SELECT o_custkey, o_totalprice::DOUBLE AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 2 GROUP BY o_custkey)")
def rel41_latest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("p"))
    return stats.latest_change(runs, ["o_custkey"], "o_orderkey", "p").withColumn("change_pct", F.round("change_pct", 6))


@query("SELECT resource_type, resource_id, relation, subject_type, subject_id, subject_relation FROM t WHERE resource_type = 'order' ORDER BY resource_type, resource_id, relation, subject_type, subject_id, subject_relation LIMIT 1000")
def rel43_query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.query(_tuples(spark, sf_dir), TupleFilter("order"))


@query(with_members(f"SELECT resource_id, true AS truncated FROM ({_ORDERS_OF.format(u='s1')}) ORDER BY resource_id LIMIT 50"))
def rel44_lookup_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup_resources(_evaluator(spark, sf_dir), Subject.user("s1"), "can_view", "order", 50)


@query(with_members("SELECT n AS resource_id, st AS subject_type, si AS subject_id, sr AS subject_relation FROM nraw"))
def rel46_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = policy.compile_policy(fixtures.POLICY)
    whole = {**schema.namespaces["nation"], "any": policy.Union((policy.Computed("editor"), policy.Computed("viewer"), policy.ViaTuples("parent", "viewer")))}
    e = Evaluator(policy.validate(policy.Schema({**schema.namespaces, "nation": whole})), _tuples(spark, sf_dir))
    return _members(e.evaluate([("nation", "any")])[("nation", "any")])


@query(with_members("SELECT o.resource_id, o.subject_type, o.subject_id, o.subject_relation FROM t o JOIN t p ON o.resource_type = 'order' AND o.relation = 'owner' AND p.resource_type = 'order' AND p.relation = 'parent' AND p.resource_id = o.resource_id JOIN nv ON nv.n = p.subject_id AND nv.st = 'user' AND nv.si = o.subject_id"))
def rel47_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners who can also view the nation, asked as pairs."""
    e = _evaluator(spark, sf_dir)
    owners = _tuples(spark, sf_dir).where("resource_type = 'order' and relation = 'owner'")
    requests = owners.withColumn("relation", F.lit("owner_view"))
    return graph.check(e, requests).where("allowed").select("resource_id", "subject_type", "subject_id", "subject_relation")


# -- functions


@query("SELECT coalesce(a::VARCHAR, 'conditional') AS a, coalesce(b::VARCHAR, 'conditional') AS b, coalesce((a OR b)::VARCHAR, 'conditional') AS u, coalesce((a AND b)::VARCHAR, 'conditional') AS i, coalesce((a AND NOT b)::VARCHAR, 'conditional') AS x FROM (VALUES (true), (false), (NULL)) p(a), (VALUES (true), (false), (NULL)) q(b)")
def rel51_membership_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [True, False, None]
    both = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    named = {"a": a, "b": b, "u": fn.member_union(a, b), "i": fn.member_intersection(a, b), "x": fn.member_exclusion(a, b)}
    return both.select(*(F.coalesce(c.cast("string"), F.lit("conditional")).alias(n) for n, c in named.items()))


@query(f"SELECT line, {TUPLE} FROM line UNION ALL SELECT line || '@', NULL, NULL, NULL, NULL, NULL, NULL FROM line")
def rel52_parse_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _tuples(spark, sf_dir).select(fn.format_relationship().alias("line"))
    both = lines.union(lines.select(F.concat("line", F.lit("@"))))
    return both.withColumn("p", fn.parse_relationship(F.col("line"))).select("line", *(F.col(f"p.{c}").alias(c) for c in COLUMNS))


@query("SELECT line FROM line")
def rel53_format_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(spark, sf_dir).select(fn.format_relationship().alias("line"))


@query("SELECT resource_type AS object_type, resource_id AS object_id, subject_type, subject_id, subject_relation FROM t")
def rel54_parse_object_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _tuples(spark, sf_dir).select(fn.parse_object(F.concat_ws(":", "resource_type", "resource_id")).alias("o"), fn.parse_subject(fn.format_subject()).alias("s"))
    return texts.select(F.col("o.type").alias("object_type"), F.col("o.id").alias("object_id"), F.col("s.type").alias("subject_type"), F.col("s.id").alias("subject_id"), F.col("s.relation").alias("subject_relation"))


@query("SELECT doc_id, regexp_full_match(source, '[A-Za-z][A-Za-z0-9_]*') AND strlen(source) <= 64 AS name_ok, coalesce(regexp_full_match(text, '[!-\"$-.0-9;-?A-\\[\\]-~]+') AND strlen(text) <= 256, false) AS id_ok, regexp_full_match(lang, '[A-Za-z0-9_.-]+') AND strlen(lang) <= 128 AS tenant_ok FROM documents")
def rel55_identifier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", fn.is_name(F.col("source")).alias("name_ok"), fn.is_id(F.col("text")).alias("id_ok"), fn.is_tenant(F.col("lang")).alias("tenant_ok"))


#: Tokens made of order keys: some with digits in upper case, some with a part cut short, some with revision 0 or one too large.
_TOKEN_SQL = "'rg1:' || CASE WHEN o_orderkey % 11 = 0 THEN '0' WHEN o_orderkey % 13 = 0 THEN '18446744073709551616' WHEN o_orderkey % 17 = 0 THEN '18446744073709551615' ELSE o_orderkey::VARCHAR END || ':' || CASE WHEN o_orderkey % 5 = 0 THEN upper(sha256(o_orderkey::VARCHAR)) ELSE sha256(o_orderkey::VARCHAR) END || ':' || CASE WHEN o_orderkey % 7 = 0 THEN substring(md5(o_orderkey::VARCHAR), 2) ELSE md5(o_orderkey::VARCHAR) END"


@query(f"SELECT token, CASE WHEN ok THEN split_part(token, ':', 2) END AS revision, CASE WHEN ok THEN sha256(k::VARCHAR) END AS schema_hash, CASE WHEN ok THEN md5(k::VARCHAR) END AS datastore FROM (SELECT o_orderkey AS k, {_TOKEN_SQL} AS token, o_orderkey <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS ok FROM orders)")
def rel56_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of tokens and what they hold."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    revision = F.when(k % 11 == 0, "0").when(k % 13 == 0, str(1 << 64)).when(k % 17 == 0, str((1 << 64) - 1)).otherwise(key)
    digest = F.when(k % 5 == 0, F.upper(F.sha2(key, 256))).otherwise(F.sha2(key, 256))
    store_id = F.when(k % 7 == 0, F.substring(F.md5(key), 2, 31)).otherwise(F.md5(key))
    tokens = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("rg1:"), revision, F.lit(":"), digest, F.lit(":"), store_id).alias("token"))
    return tokens.withColumn("p", fn.parse_token(F.col("token"))).select("token", F.col("p.revision").cast("string").alias("revision"), "p.schema_hash", "p.datastore")


@query(f"SELECT * FROM (VALUES {_values(('as text and back', 1), ('namespaces in another order', 1), ('relations in another order', 1), ('operands in another order', 0), ('a relation more', 0), ('nothing', 0))}) v(policy, same)")
def rel57_schema_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether changes to a policy change its hash."""
    whole = policy.compile_policy(fixtures.POLICY)
    turned = {**whole.namespaces["order"], "can_edit": policy.Exclusion(policy.Computed("banned"), policy.Computed("owner"))}
    made = {
        "as text and back": policy.compile_policy(policy.text(whole)),
        "namespaces in another order": policy.Schema(dict(reversed(whole.namespaces.items()))),
        "relations in another order": policy.Schema({n: dict(reversed(r.items())) for n, r in whole.namespaces.items()}),
        "operands in another order": policy.Schema({**whole.namespaces, "order": turned}),
        "a relation more": policy.Schema({**whole.namespaces, "part": {**whole.namespaces["part"], "more": None}}),
        "nothing": policy.Schema({}),
    }
    return spark.createDataFrame([(k, int(policy.schema_hash(v) == policy.schema_hash(whole))) for k, v in made.items()], "policy string, same int")


# -- graph queries


@query(with_members("""SELECT o.o_orderkey::VARCHAR AS resource_id, 'c' || o.o_custkey AS subject_id,
  NOT EXISTS (SELECT 1 FROM t b WHERE b.resource_type = 'order' AND b.relation = 'banned' AND b.resource_id = o.o_orderkey::VARCHAR AND b.subject_id = 'c' || o.o_custkey) AS allowed FROM orders o"""))
def rel60_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May the customer of each order view it?"""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    none = F.lit(None).cast("string")
    requests = orders.select(F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lit("can_view").alias("relation"), F.lit("user").alias("subject_type"), F.concat(F.lit("c"), "o_custkey").alias("subject_id"), none.alias("subject_relation"))
    return graph.check(_evaluator(spark, sf_dir), requests).select("resource_id", "subject_id", "allowed")


@query(with_members("""SELECT q.rid AS resource_id, q.st AS subject_type, q.si AS subject_id, q.sr AS subject_relation, (ow.resource_id IS NOT NULL OR v.n IS NOT NULL) AND b.resource_id IS NULL AS allowed FROM (
    SELECT o_orderkey::VARCHAR AS rid, 'user' AS st, 'c' || o_custkey AS si, NULL::VARCHAR AS sr FROM orders
    UNION ALL SELECT o_orderkey::VARCHAR, 'user', 's' || (o_orderkey % 10), NULL FROM orders
    UNION ALL SELECT o_orderkey::VARCHAR, 'user', 'c' || (o_custkey * 7 % 1000), NULL FROM orders
    UNION ALL SELECT o_orderkey::VARCHAR, 'group', s, 'member' FROM orders JOIN seg ON o_orderkey % 5 = k) q
  LEFT JOIN (SELECT * FROM t WHERE resource_type = 'order' AND relation = 'owner') ow ON ow.resource_id = q.rid AND ow.subject_type = q.st AND ow.subject_id = q.si
  LEFT JOIN (SELECT resource_id, subject_id AS n FROM t WHERE resource_type = 'order' AND relation = 'parent') p ON p.resource_id = q.rid
  LEFT JOIN nv v ON v.n = p.n AND v.st = q.st AND v.si = q.si AND v.sr IS NOT DISTINCT FROM q.sr
  LEFT JOIN (SELECT * FROM t WHERE resource_type = 'order' AND relation = 'banned') b ON b.resource_id = q.rid AND b.subject_type = q.st AND b.subject_id = q.si"""))
def rel60_check_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May these view each order: its customer, an editor of some nation, some other customer (often a stranger, sometimes the same one again), and a segment's members as a set?"""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    segments = customers.select(F.lower("c_mktsegment").alias("s")).distinct()
    numbered = segments.agg(F.array_sort(F.collect_list("s")).alias("names")).select(F.posexplode("names").alias("k", "s"))  # five rows
    user = lambda x: ("user", x, F.lit(None).cast("string"))
    subjects = [user(F.concat(F.lit("c"), "o_custkey")), user(F.concat(F.lit("s"), F.col("o_orderkey") % 10)), user(F.concat(F.lit("c"), F.col("o_custkey") * 7 % 1000)), ("group", F.col("s"), F.lit("member"))]
    known = orders.join(F.broadcast(numbered), F.col("o_orderkey") % 5 == F.col("k"))
    array = F.array(*(F.struct(F.lit(t).alias("subject_type"), i.alias("subject_id"), r.alias("subject_relation")) for t, i, r in subjects))
    requests = known.select(F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lit("can_view").alias("relation"), F.explode(array).alias("s")).select("resource_type", "resource_id", "relation", "s.*")
    return graph.check(_evaluator(spark, sf_dir), requests).drop("resource_type", "relation")


@query("""SELECT root, path, kind, type, id, relation FROM (
  SELECT n_nationkey::VARCHAR AS root, x.path, x.kind, NULL AS type, NULL AS id, NULL AS relation FROM nation, (VALUES ('', 'exclusion'), ('0000', 'union'), ('00000000', 'union'), ('00000001', 'union'), ('00000002', 'union'), ('0001', 'union')) x(path, kind)
  UNION ALL SELECT resource_id, CASE relation WHEN 'editor' THEN '00000000' ELSE '0001' END || lpad((row_number() OVER (PARTITION BY resource_id, relation ORDER BY subject_id) - 1)::VARCHAR, 4, '0'), 'user', subject_type, subject_id, NULL FROM t WHERE resource_type = 'nation' AND relation IN ('editor', 'banned')
  UNION ALL SELECT resource_id, '000000020000', 'union', NULL, NULL, NULL FROM t WHERE resource_type = 'nation' AND relation = 'parent'
  UNION ALL SELECT p.resource_id, '000000020000' || lpad((row_number() OVER (PARTITION BY p.resource_id ORDER BY v.subject_id) - 1)::VARCHAR, 4, '0'), 'userset', v.subject_type, v.subject_id, v.subject_relation FROM t p JOIN t v ON p.resource_type = 'nation' AND p.relation = 'parent' AND v.resource_type = 'region' AND v.relation = 'viewer' AND v.resource_id = p.subject_id)""")
def rel61_expand_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with links to regions, and sets of members as leaves."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("id"))
    return graph.expand(_evaluator(spark, sf_dir, WIDE), nations, "nation", "can_view")


@query("""SELECT root, path, kind, type, id, relation FROM (
  SELECT DISTINCT resource_id AS root, x.path, x.kind, NULL AS type, NULL AS id, NULL AS relation FROM t, (VALUES ('', 'exclusion'), ('0000', 'union'), ('0001', 'union')) x(path, kind) WHERE resource_type = 'order' AND relation = 'owner'
  UNION ALL SELECT resource_id, CASE relation WHEN 'owner' THEN '0000' ELSE '0001' END || lpad((row_number() OVER (PARTITION BY resource_id, relation ORDER BY subject_id) - 1)::VARCHAR, 4, '0'), 'user', subject_type, subject_id, NULL FROM t WHERE resource_type = 'order' AND relation IN ('owner', 'banned'))""")
def rel61_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id"))
    return graph.expand(_evaluator(spark, sf_dir), orders, "order", "can_edit")


@query(with_members(f"SELECT resource_id, false AS truncated FROM ({_ORDERS_OF.format(u='c1')})"))
def rel62_lookup_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup_resources(_evaluator(spark, sf_dir), Subject.user("c1"), "can_view", "order")


@query(with_members("SELECT DISTINCT p AS resource_id, false AS truncated FROM pv WHERE si = 's1'"))
def rel62_lookup_resources_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup_resources(_evaluator(spark, sf_dir), Subject.user("s1"), "can_view", "part")


@query(with_members("SELECT st AS subject_type, si AS subject_id, sr AS subject_relation, false AS truncated FROM nv WHERE n = '0' AND st = 'user'"))
def rel63_lookup_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup_subjects(_evaluator(spark, sf_dir, WIDE), Object("nation", "0"), "can_view", "user")


@query(with_members("SELECT st AS subject_type, si AS subject_id, sr AS subject_relation, false AS truncated FROM nv WHERE n = '0' AND st = 'group'"))
def rel63_lookup_subject_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup_subjects(_evaluator(spark, sf_dir, WIDE), Object("nation", "0"), "can_view", "group")


@query(with_members("""SELECT resource_id, relation, subject_type, subject_id, subject_relation FROM (
  SELECT resource_id, relation, subject_type, subject_id, subject_relation FROM t WHERE resource_type = 'nation' AND relation IN ('editor', 'banned')
  UNION SELECT p.resource_id, 'parent', v.st, v.si, v.sr FROM t p JOIN rv v ON p.resource_type = 'nation' AND p.relation = 'parent' AND p.subject_id = v.r
  UNION SELECT n, 'can_view', st, si, sr FROM nv) WHERE subject_type = 'user'"""))
def rel64_permissions_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user has on each nation."""
    users = _tuples(spark, sf_dir).where(fn.is_user()).select(COLUMNS[3:]).distinct()
    return graph.permissions_of(_evaluator(spark, sf_dir), users, "nation")


@query("SELECT * FROM (VALUES ('can_view'), ('owner')) v(relation) WHERE EXISTS (SELECT 1 FROM t WHERE resource_type = 'order' AND resource_id = '1' AND relation = 'owner')")
def rel64_lookup_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All permissions of order 1's owner on it, but those through the nation."""
    t = _tuples(spark, sf_dir)
    owner = t.where("resource_type = 'order' and resource_id = '1' and relation = 'owner'").first()
    if owner is None:
        return spark.createDataFrame([], "relation string")
    found = graph.lookup_permissions(_evaluator(spark, sf_dir), Subject.user(owner.subject_id), Object("order", "1"))
    return found.where("relation in ('can_view', 'owner')")


@query(with_members("SELECT p AS resource_id, count(*) AS n FROM pv GROUP BY p"))
def rel66_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewers of every part, through chains of parents made into rings at the roots, which change nothing."""
    t = _tuples(spark, sf_dir)
    ring = t.where("resource_type = 'part' and relation = 'viewer'").select("resource_type", "resource_id", F.lit("parent").alias("relation"), F.lit("part").alias("subject_type"), F.col("resource_id").alias("subject_id"), F.lit("can_view").alias("subject_relation"))
    e = Evaluator(policy.compile_policy(fixtures.POLICY), t.unionByName(ring))
    return e.evaluate([("part", "can_view")])[("part", "can_view")].where("subject_relation = ''").groupBy("resource_id").agg(F.count("*").alias("n"))


@query("SELECT depth, CASE WHEN depth <= (SELECT max(length(p_partkey::VARCHAR)) FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part)) THEN 'depth' ELSE 'ok' END AS outcome FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (50)) v(depth)")
def rel67_depth_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of a stranger on the part with the longest chain of parents ends with, by the depth allowed."""
    last = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()[0]
    t, schema = _tuples(spark, sf_dir), policy.compile_policy(fixtures.POLICY)
    request = spark.createDataFrame([("part", str(last), "can_view", "user", "nobody", None)], SCHEMA)
    prepared = Prepared(t, Limits().fanout)
    ask = lambda depth: graph.check(Evaluator(schema, t, Limits(depth=depth), prepared=prepared), request).collect()
    return spark.createDataFrame([(d, _outcome(lambda d=d: ask(d))) for d in (1, 2, 3, 4, 5, 6, 7, 50)], "depth int, outcome string")


#: Nations with up to three regions as viewers, under a guard that lets two be followed.
_WIDE_SQL = "SELECT n_nationkey, n_nationkey % 4 AS k FROM nation"


@query(f"SELECT n_nationkey::VARCHAR AS resource_id, CASE WHEN k = 3 THEN 'fanout' ELSE 'ok' END AS outcome FROM ({_WIDE_SQL})")
def rel68_fanout_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of a stranger on each nation ends with, where a step may follow two usersets."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    wide = nations.select(F.lit("nation").alias("resource_type"), F.col("n_nationkey").cast("string").alias("resource_id"), F.lit("viewer").alias("relation"), F.lit("region").alias("subject_type"), F.explode(F.expr("slice(array('0', '1', '2'), 1, cast(n_nationkey % 4 as int))")).alias("subject_id"), F.lit("viewer").alias("subject_relation"))
    evaluator = Evaluator(policy.compile_policy(fixtures.POLICY), _tuples(spark, sf_dir).unionByName(wide), Limits(fanout=2))
    keys = nations.select(F.lit("nation#can_view").alias("g"), F.col("n_nationkey").cast("string").alias("gid"), F.col("n_nationkey").cast("string").alias("root"))
    undecided = evaluator.undecided(keys, [("nation", "can_view")])
    return keys.select("root").join(undecided, "root", "left").select(F.col("root").alias("resource_id"), F.coalesce("code", F.lit("ok")).alias("outcome"))


# -- writes


#: A batch over the tuples: creates of new order viewers, touches of stored owners, deletes of stored bans.
def _batch(t: DataFrame) -> DataFrame:
    banned = t.where("resource_type = 'order' and relation = 'banned'")
    op = lambda f, o: f.select(F.lit(o).alias("op"), *COLUMNS)
    return op(banned.withColumn("relation", F.lit("viewer")), "create").union(op(t.where("resource_type = 'order' and relation = 'owner'"), "touch")).union(op(banned, "delete"))


@query(f"SELECT {TUPLE} FROM t WHERE NOT (resource_type = 'order' AND relation = 'banned') UNION ALL SELECT resource_type, resource_id, 'viewer', subject_type, subject_id, subject_relation FROM t WHERE resource_type = 'order' AND relation = 'banned'")
def rel75_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tuples(spark, sf_dir)
    store.validate_batch(t, _batch(t), [], 0)
    deleted, inserted = store.changes(t, _batch(t))
    return store.overlay(t, deleted, inserted)


@query(f"SELECT 'create' AS op, {TUPLE} FROM t WHERE relation = 'editor' UNION ALL SELECT 'delete', resource_type, resource_id, 'viewer', subject_type, subject_id, subject_relation FROM t WHERE relation = 'editor'")
def rel72_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates of stored tuples and deletes of missing ones; touches never conflict."""
    t = _tuples(spark, sf_dir)
    stored = t.where("relation = 'editor'")
    op = lambda f, o: f.select(F.lit(o).alias("op"), *COLUMNS)
    return store.conflicts(t, op(stored, "create").union(op(stored.withColumn("relation", F.lit("viewer")), "delete")).union(op(stored, "touch")))


@query(f"SELECT {TUPLE} FROM t WHERE NOT (resource_type = 'order' AND relation = 'banned') UNION ALL SELECT resource_type, resource_id, 'viewer', subject_type, subject_id, subject_relation FROM t WHERE resource_type = 'order' AND relation = 'banned'")
def rel75_engine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch through the engine, as one revision."""
    engine = _engine(spark, sf_dir)
    engine.write_frame(_batch(_tuples(spark, sf_dir)))
    return engine.tuples()


@query(f"SELECT * FROM (VALUES {_values(('apply', 'ok', 'a:r,a:s,b:r'), ('apply one again', 'ok', 'a:r,b:r'), ('delete a relation in use', 'in_use', 'a:r,b:r'), ('delete a namespace in use', 'in_use', 'a:r,b:r'), ('delete what is not there', 'namespace_not_found', 'a:r,b:r'), ('replace what tuples need', 'relation_not_found', 'a:r,b:r'), ('delete a namespace', 'ok', 'a:r'), ('replace', 'ok', 'a:r,c:q'), ('delete a relation', 'ok', 'a:r'), ('a target that is not there', 'computed_not_found', 'a:r'))}) v(step, outcome, relations)")
def rel76_schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes of the schema end with, and the relations after each."""
    engine, out = Engine(spark), []
    steps = {
        "apply": lambda: (engine.apply_schema("namespace a { relation r {} relation s {} } namespace b { relation r {} }"), engine.create("a:1#r@user:u")),
        "apply one again": lambda: engine.apply_schema("namespace a { relation r {} }"),
        "delete a relation in use": lambda: engine.delete_relation("a", "r"),
        "delete a namespace in use": lambda: engine.delete_namespace("a"),
        "delete what is not there": lambda: engine.delete_namespace("z"),
        "replace what tuples need": lambda: engine.replace_schema("namespace b { relation r {} }"),
        "delete a namespace": lambda: engine.delete_namespace("b"),
        "replace": lambda: engine.replace_schema("namespace a { relation r {} } namespace c { relation q {} }"),
        "delete a relation": lambda: engine.delete_relation("c", "q"),
        "a target that is not there": lambda: engine.apply_schema('namespace d { relation r { rewrite computed_userset(relation: "x") } }'),
    }
    for name, step in steps.items():
        outcome = _outcome(step)
        out.append((name, outcome, ",".join(f"{n}:{r}" for n, r in sorted(engine.state().schema.pairs()))))
    return spark.createDataFrame(out, "step string, outcome string, relations string")


@query(f"SELECT * FROM (VALUES {_values((1, 'expired', None), (2, 'expired', None), (3, 'ok', 2), (4, 'ok', 3), (5, 'ok', 4), (6, 'unavailable', None), (0, 'wrong_datastore', None), (-1, 'schema_mismatch', None))}) v(revision, outcome, tuples)")
def rel79_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads by token end with, of an engine that keeps three revisions; 0 is another engine's token, -1 one with another schema."""
    engine = Engine(spark, retained=3)
    tokens = {1: engine.apply_schema("namespace d { relation v {} }"), **{k: engine.touch(f"d:{k}#v@user:u") for k in range(2, 6)}}
    last = tokens[5]
    tokens |= {6: type(last)(6, last.schema_hash, last.datastore), 0: Engine(spark).token(), -1: type(last)(5, "0" * 64, last.datastore)}
    out = [(k, _outcome(lambda t=t: engine.state(t)), engine.tuples(t).count() if k in (3, 4, 5) else None) for k, t in tokens.items()]
    return spark.createDataFrame(out, "revision int, outcome string, tuples int")


@query(f"SELECT * FROM (VALUES {_values(('create', 'ok', '1'), ('create again', 'exists', '1'), ('touch again', 'ok', '1'), ('touch', 'ok', '1,2'), ('delete', 'ok', '2'), ('delete again', 'not_found', '2'), ('one key twice', 'duplicate_mutation', '2'), ('an unknown relation', 'relation_not_found', '2'), ('nothing', 'ok', '2'), ('malformed', 'malformed', '2'))}) v(step, outcome, objects)")
def rel80_single_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What single writes end with, and the objects stored after each."""
    engine, out = Engine(spark), []
    engine.apply_schema("namespace d { relation v {} }")
    touch = lambda t: Mutation("touch", Tuple.parse(t))
    steps = {
        "create": lambda: engine.create("d:1#v@user:u"),
        "create again": lambda: engine.create("d:1#v@user:u"),
        "touch again": lambda: engine.touch("d:1#v@user:u"),
        "touch": lambda: engine.touch("d:2#v@user:u"),
        "delete": lambda: engine.delete("d:1#v@user:u"),
        "delete again": lambda: engine.delete("d:1#v@user:u"),
        "one key twice": lambda: engine.write([touch("d:3#v@user:u"), touch("d:3#v@user:u")]),
        "an unknown relation": lambda: engine.create("d:3#w@user:u"),
        "nothing": lambda: engine.write([]),
        "malformed": lambda: engine.create("d:3#v"),
    }
    for name, step in steps.items():
        outcome = _outcome(step)
        out.append((name, outcome, ",".join(sorted(r.resource_id for r in engine.tuples().select("resource_id").collect()))))
    return spark.createDataFrame(out, "step string, outcome string, objects string")


@query("SELECT count(*) AS n, count(DISTINCT line) AS n_distinct, count(*) FILTER (line LIKE '%#banned@%') AS banned FROM line")
def rel81_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bans deleted and brought back, and the base rewritten: the tuples are those there were."""
    engine, banned = _engine(spark, sf_dir), _tuples(spark, sf_dir).where("relation = 'banned'")
    for op in ("delete", "create"):
        engine.write_frame(banned.select(F.lit(op).alias("op"), *COLUMNS))
    engine.compact()
    if engine.state().changes:
        raise ValueError("the base was not rewritten")
    return engine.tuples().withColumn("line", fn.format_relationship()).agg(F.count("*").alias("n"), F.count_distinct("line").alias("n_distinct"), F.count_if(F.col("relation") == "banned").alias("banned"))


@query(f"SELECT * FROM (VALUES {_values(('none yet', ''), ('asked for, not made', ''), ('one made', 'north'), ('the same one', 'north'), ('another', 'north,south'), ('malformed', 'north,south'))}) v(step, tenants)")
def rel50_tenant_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names known after each step."""
    tenants, out = Tenants(lambda: Engine(spark)), []
    steps = {"none yet": lambda: None, "asked for, not made": lambda: tenants.get("north"), "one made": lambda: tenants.get_or_create("north"), "the same one": lambda: tenants.get_or_create("north"), "another": lambda: tenants.get_or_create("south"), "malformed": lambda: tenants.get_or_create("a b")}
    for name, step in steps.items():
        _outcome(step)
        out.append((name, ",".join(tenants.tenants())))
    return spark.createDataFrame(out, "step string, tenants string")


@query("SELECT tenant, resource_type, count(*) AS n FROM (SELECT resource_type, 'tenant' || (strlen(subject_id) % 3) AS tenant FROM t) GROUP BY tenant, resource_type")
def rel82_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine for each tenant, with its share of the tuples."""
    tenants, t = Tenants(lambda: Engine(spark)), _tuples(spark, sf_dir)
    out = None
    for k in range(3):
        engine = tenants.get_or_create(f"tenant{k}")
        engine.replace_all(fixtures.POLICY, t.where(F.octet_length("subject_id") % 3 == k))
    for name in tenants.tenants():
        rows = tenants.get(name).tuples().groupBy(F.lit(name).alias("tenant"), "resource_type").agg(F.count("*").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that customer 1 can view."""
    return rel62_lookup_resources(spark, sf_dir)
