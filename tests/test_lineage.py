from pathlib import Path

from relgrid.domain import Object, Subject
from relgrid.engine import Engine
from relgrid.plans import lineage

RINGS = '''
namespace team { relation member {} }
namespace box { relation inside {} relation holder {}
                relation opener { rewrite union(this, computed_userset(relation: "holder"), tuple_to_userset(tupleset: "inside", computed_userset: "opener")) } }
'''


def _tables(spark):
    return set(Path(lineage.shared_dir(spark).removeprefix("file:")).glob("round-*"))


def test_rounds_go_and_revisions_stay(spark):
    engine = Engine(spark)
    engine.apply_schema(RINGS)
    with lineage.temporary(spark):
        engine.create("team:a#member@user:u")
        engine.create("box:small#inside@box:large#opener")
        engine.create("box:large#holder@team:a#member")
        assert engine.check(Object("box", "small"), "opener", Subject.user("u"))
        during = _tables(spark)
    after = _tables(spark)
    assert after < during and engine.tuples().count() == 3
    with lineage.temporary(spark):
        assert engine.check(Object("box", "small"), "opener", Subject.user("u"))
    assert _tables(spark) == after


def test_blocks_are_nested_and_survive_errors(spark):
    with lineage.temporary(spark):
        outer = lineage.cut(spark.range(3))
        try:
            with lineage.temporary(spark):
                lost, kept = lineage.written(spark.range(4)), lineage.cut(spark.range(5), lasting=True)
                raise ValueError
        except ValueError:
            pass
        assert not lineage.exists(spark, lost) and outer.count() == 3
    after = lineage.cut(spark.range(6))
    assert kept.count() == 5 and after.count() == 6
