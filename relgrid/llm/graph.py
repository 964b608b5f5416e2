"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrid.llm.common import dealt_join, hot_keys, written


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """(id, label): for each end of an edge (a, b), the smallest id that it is connected with.

    Each round takes the smallest label among the neighbours and then the label of that label, so paths shorten at least
    as fast as by halving; every round is written to the shared folder. Aggregates are partial before each exchange, and the edges of a hot id are dealt.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    hot = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), ["b"])
    for _ in range(limit):
        near = dealt_join(both, labels.select(F.col("id").alias("b"), F.col("label").alias("near")), ["b"], ["a"], hot).groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        stepped = labels.join(near, "id").select("id", F.least("label", "near").alias("step"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("step"), F.col("label").alias("jump"))
        new = written(stepped.join(jump, "step", "left").select("id", F.least("step", F.coalesce("jump", "step")).alias("label"), "was"), "labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")
