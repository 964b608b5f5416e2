"""Exports and imports whose work must be dealt over tasks, whatever the size of a type."""

import hashlib

import pytest
from pyspark.sql import functions as F

from relgrid.domain import Object, Subject, Tuple
from relgrid.errors import DomainError, PolicyTextError
from relgrid.functions import columns as fn
from relgrid.functions.columns import SCHEMA, format_relationship
from relgrid.sources import text


def _orders(spark, n):
    subject = [F.lit("user").alias("subject_type"), F.concat(F.lit("c"), F.col("id") % 7).alias("subject_id"), F.lit(None).cast("string").alias("subject_relation")]
    big = spark.range(n).select(F.lit("order").alias("resource_type"), F.col("id").cast("string").alias("resource_id"), F.lit("owner").alias("relation"), *subject)
    return big.union(spark.createDataFrame([("a", "é", "r", "user", "u", None), ("z", "1", "r", "group", "g", "member"), ("z", "1", "r", "group", "g", "member")], SCHEMA))


def _files(tuples):
    out = {}
    for r in tuples.select("resource_type", format_relationship().alias("line")).collect():
        out.setdefault(r.resource_type, []).append(r.line)
    return {kind: sorted(lines, key=str.encode) for kind, lines in out.items()}


def _no_gathering(frame):
    assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_digests_of_a_type_in_many_chunks(spark):
    tuples = _orders(spark, 25_000).repartition(5)
    found = text.export_digests(tuples)
    _no_gathering(found)
    want = {(k, hashlib.md5(("\n".join(v) + "\n").encode()).hexdigest(), len(v)) for k, v in _files(tuples).items()}
    assert {tuple(r) for r in found.collect()} == want
    assert text.export_digests(tuples.limit(0)).collect() == []


def test_ordinals_of_a_type_in_many_ranges(spark):
    tuples = _orders(spark, 5_000).repartition(5)
    found = text.numbered_lines(tuples)
    _no_gathering(found)
    want = sorted((k, line, n) for k, v in _files(tuples).items() for n, line in enumerate(v))
    assert sorted(tuple(r) for r in found.collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert sorted(tuple(r) for r in text.numbered_lines(tuples).collect()) == want and text.numbered_lines(tuples.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_expression_decides_on_a_line(spark):
    """Six columns of a million lines took minutes while each was cut out by an expression of its own."""
    names, ids = ["a", "A_9", "n" * 64, "n" * 65, "9a", "", "é"], ["1", "!~{}.-", "i" * 256, "i" * 257, "", "a/b", "a b", "ü"]
    lines = [f"{n}:{i}#{r}@{t}:{j}{s}" for n in names for i in ids for r in ("r", "", "r" * 65) for t, j in (("user", "u"), ("g", "x" * 256), ("", "u"), ("g", "")) for s in ("", "#m", "#", "#m#m", "@u", "\n")]
    lines += ["", "a", "a:1", "a:1#r", "a:1#r@", "@", "a:1#r@u:1:2", ":::", "a:1@b:2#c", None]
    frame = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("t", fn.parse_relationship(F.col("line")))
    frame = frame.select("line", "t", fn.parse_object(F.substring_index("line", "#", 1)).alias("o"), fn.parse_subject(F.substring_index("line", "@", -1)).alias("s"))
    assert frame.select("t")._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 1
    assert "regexp_" not in text.parse_lines(frame.select("line"))._jdf.queryExecution().optimizedPlan().toString()
    known = lambda make, x: _parsed(make, x) if x is not None else None
    for r in frame.collect():
        assert (tuple(r.t) if r.t else None) == known(lambda x: Tuple.parse(x).row(), r.line), r.line
        if r.line is not None:
            o, s = known(Object.parse, r.line.split("#")[0]), known(Subject.parse, r.line.split("@")[-1])
            assert (tuple(r.o) if r.o else None) == ((o.type, o.id) if o else None), r.line
            assert (tuple(r.s) if r.s else None) == ((s.type, s.id, s.relation) if s else None), r.line


def _parsed(make, x):
    try:
        return make(x)
    except DomainError:
        return None


def test_lines_are_trimmed_and_the_first_bad_one_is_named(spark):
    lines = spark.createDataFrame([("\t\x0b a:1#r@user:u \r\f",), ("  # a",), (" // b",), (" \n",), ("\u00a0a:1#r@user:u",), ("bad",)], "value string")
    parsed = text.parse_lines(lines)
    assert sorted(r.line for r in parsed.collect()) == ["a:1#r@user:u", "bad", "\u00a0a:1#r@user:u"]
    with pytest.raises(PolicyTextError, match="'bad'"):
        text.checked(parsed)
    assert text.checked(parsed.where("line < 'b'")).collect() == [("a", "1", "r", "user", "u", None)]
