"""Steps whose work must not grow with what they don't concern, or gather in one task."""

import pytest
from pyspark.sql import functions as F

from relgrid import fixtures
from relgrid.engine import Engine
from relgrid.errors import ArtifactError, SchemaError, StoreError
from relgrid.functions.columns import SCHEMA
from relgrid.operators import store
from relgrid.plans import fixpoint, policy
from relgrid.plans.fixpoint import Evaluator, Prepared
from relgrid.sources import artifact

ROWS = [("order", "1", "owner", "user", "u", None), ("order", "2", "owner", "user", "u", None), ("order", "1", "parent", "nation", "1", "can_view"), ("nation", "1", "editor", "user", "v", None)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_repeated_rows_are_counted_by_digest_in_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(store, "COUNTED", 2)
    assert store.repeated(_frame(spark, ROWS), 4) is None and store.repeated(_frame(spark, []), 0) is None
    assert tuple(store.repeated(_frame(spark, [*ROWS, ROWS[2]]), 5)) == ROWS[2]
    assert store.repeated(_frame(spark, [*ROWS, ("order", "1", "parent", "nation", "1", "x")]), 5) is None
    with pytest.raises(StoreError, match="given twice"):
        Engine(spark).replace_all(fixtures.POLICY, _frame(spark, [*ROWS, ROWS[0]]))


def test_references_are_checked_without_moving_rows(spark):
    schema = policy.compile_policy(fixtures.POLICY)
    bad = [("order", "1", "unheard", "user", "u", None), ("order", "1", "viewer", "group", "g", "unheard"), ("order", "1", None, "user", "u", None)]
    found = store.broken_references(_frame(spark, [*ROWS, *bad, bad[0]]), schema)
    assert {tuple(r) for r in found.collect()} == set(bad) and found.count() == 3
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(SchemaError, match="unheard"):
        store.check_references(_frame(spark, [*ROWS, bad[1]]), schema)
    store.check_references(_frame(spark, ROWS), schema)


def test_a_batch_meets_only_tuples_of_its_relations(spark):
    batch = _frame(spark, [("order", "9", "owner", "user", "u", None), ("nation", "1", "banned", "user", "u", None)])
    assert sorted(r.resource_id for r in store.near(_frame(spark, ROWS), batch).collect()) == ["1", "2"]
    assert store.near(_frame(spark, ROWS), batch.limit(0)).collect() == []


def test_tuples_of_one_subject_spread_over_files(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("order").alias("resource_type"), F.col("id").cast("string").alias("resource_id"), F.lit("parent").alias("relation"), F.lit("nation").alias("subject_type"), F.lit("1").alias("subject_id"), F.lit("can_view").alias("subject_relation"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        artifact.save(str(tmp_path / "a"), policy.compile_policy(fixtures.POLICY), rows, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "a/by_subject")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 3600
    assert artifact.load(spark, str(tmp_path / "a")).tuples.count() == 4000
    artifact.save(str(tmp_path / "b"), policy.compile_policy(fixtures.POLICY), rows.limit(5).withColumn("resource_id", F.lit("a/b")), 1, "check_only")
    with pytest.raises(ArtifactError) as e:
        artifact.load(spark, str(tmp_path / "b"))
    assert e.value.code == "duplicate"


def test_links_are_read_without_a_shuffle(spark):
    e = Evaluator(policy.compile_policy(fixtures.POLICY), _frame(spark, ROWS))
    links = e._links(("order", "can_view"), "parent", ("nation", "can_view"), "through")
    assert "Aggregate" not in links._jdf.queryExecution().optimizedPlan().toString() and links.collect() == [("1", "1")]


def test_wide_objects_are_found_though_slots_are_shared(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "SLOTS", 1)
    sets = [("order", str(k % 5), "parent", "nation", str(k), "can_view") for k in range(5)]
    assert Prepared(_frame(spark, sets), 5).over is None and Prepared(_frame(spark, sets), 1).over is None and Prepared(_frame(spark, []), 1).over is None
    assert [tuple(r) for r in Prepared(_frame(spark, [*sets, ("order", "3", "parent", "nation", "9", "can_view")]), 1).over.collect()] == [("order#parent", "3")]
