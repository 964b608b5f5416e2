import pytest

from relgrid.errors import SchemaError
from relgrid.plans import policy
from relgrid.plans.policy import Computed, Exclusion, Intersection, This, Union, ViaTuples

PORT = """
// who may board which ship
namespace crew { relation hand {} relation mate {} }
namespace ship {
    relation captain {}
    relation berth {}
    relation barred {}
    relation board { rewrite union(computed_userset(relation: "captain"), this, tuple_to_userset(tupleset: "berth", computed_userset: "hand")) }
    relation steer { rewrite exclusion((intersection(this, computed_userset(relation: "board"))), computed_userset(relation: "barred")) }
}
"""


def test_parse():
    schema = policy.compile_policy(PORT)
    assert schema.namespaces["ship"]["board"] == Union((Computed("captain"), This(), ViaTuples("berth", "hand")))
    assert schema.namespaces["ship"]["steer"] == Exclusion(Intersection((This(), Computed("board"))), Computed("barred"))
    assert schema.relations("ship") == ["barred", "berth", "board", "captain", "steer"]
    assert schema.rewrite("crew", "mate") == This()


def test_text_round_trip_and_hash():
    schema = policy.compile_policy(PORT)
    again = policy.compile_policy(policy.text(schema))
    assert again == schema and policy.text(again) == policy.text(schema)
    assert policy.schema_hash(again) == policy.schema_hash(schema)
    turned = policy.compile_policy('namespace b { relation y {} relation x {} }\nnamespace a { relation r { rewrite union(this, computed_userset(relation: "s")) } relation s {} }')
    same = policy.compile_policy('namespace a { relation s {} relation r { rewrite union(this, computed_userset(relation: "s")) } } namespace b { relation x {} relation y {} }')
    other = policy.compile_policy('namespace a { relation s {} relation r { rewrite union(computed_userset(relation: "s"), this) } } namespace b { relation x {} relation y {} }')
    assert policy.schema_hash(turned) == policy.schema_hash(same) != policy.schema_hash(other)


@pytest.mark.parametrize(
    ("dsl", "code"),
    [
        ("namespace a {} namespace a {}", "duplicate_namespace"),
        ("namespace a { relation r {} relation r {} }", "duplicate_relation"),
        ('namespace a { relation r { rewrite computed_userset(relation: "x") } }', "computed_not_found"),
        ('namespace a { relation r { rewrite tuple_to_userset(tupleset: "x", computed_userset: "r") } }', "tupleset_not_found"),
        ('namespace a { relation p {} relation r { rewrite tuple_to_userset(tupleset: "p", computed_userset: "x") } }', "target_not_found"),
        ("namespace a { relation r { rewrite union() } }", "operands"),
        ("namespace a { relation r { rewrite intersection() } }", "operands"),
        ("namespace a { relation r { rewrite exclusion(this) } }", "parse"),
        ("namespace a { relation r { rewrite never } }", "parse"),
        ("namespacea {}", "parse"),
        ("namespace _a {}", "parse"),
        ("namespace a { relation", "parse"),
        ("namespace a ;", "parse"),
    ],
)
def test_bad_policies(dsl, code):
    with pytest.raises(SchemaError) as e:
        policy.compile_policy(dsl)
    assert e.value.code == code


def test_declared_subject_types():
    parsed = policy.parse('namespace f { relation v {} } namespace g {} namespace d { relation p {} relation r { rewrite tuple_to_userset(tupleset: "p", computed_userset: "v") } }')
    policy.validate(policy.Schema(parsed.namespaces, {("d", "p"): ("f",)}))
    with pytest.raises(SchemaError):
        policy.validate(policy.Schema(parsed.namespaces, {("d", "p"): ("f", "g")}))
