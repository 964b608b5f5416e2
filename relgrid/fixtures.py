"""Tuples and a policy derived from order data: customers in segments, regions, nations, orders and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgrid.functions.columns import COLUMNS

POLICY = """
namespace user {}
namespace group { relation member {} }
namespace region { relation viewer {} }
namespace nation {
    relation parent {}
    relation editor {}
    relation viewer {}
    relation banned {}
    relation can_view { rewrite exclusion(union(computed_userset(relation: "editor"), computed_userset(relation: "viewer"), tuple_to_userset(tupleset: "parent", computed_userset: "viewer")), computed_userset(relation: "banned")) }
}
namespace order {
    relation parent {}
    relation owner {}
    relation viewer {}
    relation banned {}
    relation can_view { rewrite exclusion(union(computed_userset(relation: "owner"), computed_userset(relation: "viewer"), tuple_to_userset(tupleset: "parent", computed_userset: "can_view")), computed_userset(relation: "banned")) }
    relation can_edit { rewrite exclusion(computed_userset(relation: "owner"), computed_userset(relation: "banned")) }
    relation owner_view { rewrite intersection(computed_userset(relation: "owner"), tuple_to_userset(tupleset: "parent", computed_userset: "can_view")) }
}
namespace part {
    relation parent {}
    relation viewer {}
    relation can_view { rewrite union(computed_userset(relation: "viewer"), tuple_to_userset(tupleset: "parent", computed_userset: "can_view")) }
}
"""


def _rows(frame: DataFrame, resource: tuple, relation: str, subject: tuple) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (*resource, relation, *subject)
    return frame.select(*(as_column(v).cast("string").alias(c) for v, c in zip(values, COLUMNS, strict=True)))


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c, orders, supplier, nation, region, part = (read(t) for t in ("customer", "orders", "supplier", "nation", "region", "part"))
    user = lambda prefix, key: ("user", F.concat(F.lit(prefix), F.col(key)), None)
    segments = c.select(F.lower("c_mktsegment").alias("s")).distinct().withColumn("k", F.row_number().over(Window.orderBy("s")) - 1)  # five rows
    regions = region.join(F.broadcast(segments), F.pmod(region.r_regionkey, F.lit(5)) == segments.k)
    owned = orders.join(c.select("c_custkey", "c_nationkey"), orders.o_custkey == F.col("c_custkey"))
    key = F.col("p_partkey")
    frames = [
        _rows(c, ("group", F.lower("c_mktsegment")), "member", user("c", "c_custkey")),
        _rows(regions, ("region", F.col("r_regionkey")), "viewer", ("group", F.col("s"), "member")),
        _rows(nation, ("nation", F.col("n_nationkey")), "parent", ("region", F.col("n_regionkey"), "viewer")),
        _rows(supplier, ("nation", F.col("s_nationkey")), "editor", user("s", "s_suppkey")),
        _rows(c.where("c_acctbal < 0"), ("nation", F.col("c_nationkey")), "banned", user("c", "c_custkey")),
        _rows(orders, ("order", F.col("o_orderkey")), "owner", user("c", "o_custkey")),
        _rows(owned, ("order", F.col("o_orderkey")), "parent", ("nation", F.col("c_nationkey"), "can_view")),
        _rows(orders.where("o_orderstatus = 'F' and o_orderkey % 10 = 0"), ("order", F.col("o_orderkey")), "banned", user("c", "o_custkey")),
        _rows(part.where("p_partkey >= 10"), ("part", key), "parent", ("part", F.floor(key / 10), "can_view")),
        _rows(part.where("p_partkey < 10"), ("part", key), "viewer", user("s", "p_partkey")),
    ]
    return reduce(DataFrame.union, frames)


#: The same tuples in SQL: a list of common table expressions ending in t.
SQL = """
seg AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k FROM (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer)),
t(resource_type, resource_id, relation, subject_type, subject_id, subject_relation) AS (
  SELECT 'group', lower(c_mktsegment), 'member', 'user', 'c' || c_custkey, NULL::VARCHAR FROM customer
  UNION ALL SELECT 'region', r_regionkey::VARCHAR, 'viewer', 'group', s, 'member' FROM region JOIN seg ON r_regionkey % 5 = k
  UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'parent', 'region', n_regionkey::VARCHAR, 'viewer' FROM nation
  UNION ALL SELECT 'nation', s_nationkey::VARCHAR, 'editor', 'user', 's' || s_suppkey, NULL FROM supplier
  UNION ALL SELECT 'nation', c_nationkey::VARCHAR, 'banned', 'user', 'c' || c_custkey, NULL FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'order', o_orderkey::VARCHAR, 'owner', 'user', 'c' || o_custkey, NULL FROM orders
  UNION ALL SELECT 'order', o_orderkey::VARCHAR, 'parent', 'nation', c_nationkey::VARCHAR, 'can_view' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'order', o_orderkey::VARCHAR, 'banned', 'user', 'c' || o_custkey, NULL FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0
  UNION ALL SELECT 'part', p_partkey::VARCHAR, 'parent', 'part', (p_partkey // 10)::VARCHAR, 'can_view' FROM part WHERE p_partkey >= 10
  UNION ALL SELECT 'part', p_partkey::VARCHAR, 'viewer', 'user', 's' || p_partkey, NULL FROM part WHERE p_partkey < 10
),
line AS (SELECT *, resource_type || ':' || resource_id || '#' || relation || '@' || subject_type || ':' || subject_id || coalesce('#' || subject_relation, '') AS line FROM t)
"""

#: Members in SQL: m(resource_type, resource_id, relation, subject_type, subject_id, subject_relation) of nations and regions, and part_view, by recursion over stored links.
MEMBERS_SQL = """
rv AS (SELECT resource_id AS r, subject_type AS st, subject_id AS si, subject_relation AS sr FROM t WHERE resource_type = 'region' AND relation = 'viewer'
  UNION SELECT a.resource_id, 'user', b.subject_id, NULL FROM t a JOIN t b ON a.resource_type = 'region' AND a.relation = 'viewer' AND b.resource_type = a.subject_type AND b.resource_id = a.subject_id AND b.relation = a.subject_relation),
nraw AS (SELECT resource_id AS n, subject_type AS st, subject_id AS si, subject_relation AS sr FROM t WHERE resource_type = 'nation' AND relation = 'editor'
  UNION SELECT p.resource_id, v.st, v.si, v.sr FROM t p JOIN rv v ON p.resource_type = 'nation' AND p.relation = 'parent' AND p.subject_id = v.r),
nv AS (SELECT n, st, si, sr FROM nraw WHERE NOT (st = 'user' AND EXISTS (SELECT 1 FROM t b WHERE b.resource_type = 'nation' AND b.relation = 'banned' AND b.resource_id = nraw.n AND b.subject_id = nraw.si))),
pv AS (WITH RECURSIVE w AS (
    SELECT resource_id AS p, subject_id AS si FROM t WHERE resource_type = 'part' AND relation = 'viewer'
    UNION SELECT a.resource_id, w.si FROM t a JOIN w ON a.resource_type = 'part' AND a.relation = 'parent' AND a.subject_id = w.p)
  SELECT * FROM w)
"""
