"""Counts over tuples and logs: posting histograms, delta statistics, percentiles, benchmark history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper bounds of the size buckets (the last is open).
BUCKETS = (1, 4, 16, 64, 256, 1024, 4096)
#: The keys by which tuples are looked up.
INDEXES = {
    "resource_relation_subject": ["resource_type", "resource_id", "relation", "subject_type", "subject_id", "subject_relation"],
    "resource_relation": ["resource_type", "resource_id", "relation"],
    "resource": ["resource_type", "resource_id"],
    "resource_type": ["resource_type"],
    "subject_relation": ["subject_type", "subject_id", "subject_relation"],
    "subject": ["subject_type", "subject_id"],
    "subject_type": ["subject_type"],
}


def histograms(tuples: DataFrame) -> DataFrame:
    """A row for each index: index_name, keys, total, largest, and how many keys fall in each size bucket (b0 to b7). One scan and one shuffle for all of them."""
    columns = INDEXES["resource_relation_subject"]
    grouped = tuples.groupingSets(list(INDEXES.values()), *columns).agg(F.grouping_id().alias("id"), F.count("*").alias("n"))
    mask = lambda key: sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in key)
    names = F.create_map(*(F.lit(x) for name, key in INDEXES.items() for x in (mask(key), name)))
    low = (0, *BUCKETS)
    counts = [F.count_if((F.col("n") > a) & (F.col("n") <= b)).alias(f"b{k}") for k, (a, b) in enumerate(zip(low, BUCKETS, strict=False))]
    found = grouped.groupBy(names[F.col("id").cast("int")].alias("index_name")).agg(F.count("*").alias("keys"), F.sum("n").alias("total"), F.max("n").alias("largest"), *counts, F.count_if(F.col("n") > BUCKETS[-1]).alias(f"b{len(BUCKETS)}"))
    every = tuples.sparkSession.createDataFrame([(n,) for n in INDEXES], "index_name string")
    return every.join(found, "index_name", "left").na.fill(0)


def delta_stats(base: DataFrame, deleted: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: base_rows, inserted_rows, deleted_rows, live_rows, tombstone_bps (deleted per 10 000 of the base)."""
    count = lambda f, n: f.agg(F.count("*").alias(n))
    joined = count(base, "base_rows").join(count(inserted, "inserted_rows"), how="cross").join(count(deleted, "deleted_rows"), how="cross")  # one row each
    return joined.select("*", F.expr("base_rows - deleted_rows + inserted_rows").alias("live_rows"), F.expr("if(base_rows = 0, 0L, deleted_rows * 10000 div base_rows)").alias("tombstone_bps"))


def nearest_rank(values: DataFrame, key: list[str], value: str, share: float) -> DataFrame:
    """The value at rank floor(share * (n - 1)) of each key."""
    counts = F.count("*").over(Window.partitionBy(key))
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1).withColumn("at", F.floor(F.lit(share) * (counts - 1)))
    return ranked.where("r = at").select(*key, F.col(value).alias("value"))


def latest_change(runs: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """latest, previous and change_pct of each key, by time."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    ranked = runs.withColumn("r", F.row_number().over(w)).where("r <= 2")
    out = ranked.groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("r") == 2, F.col(value))).alias("previous"))
    return out.withColumn("change_pct", F.when(F.col("previous") != 0, (F.col("latest") - F.col("previous")) / F.col("previous") * 100))


def upsert(history: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """History with the new rows in place of those with the same key."""
    both = history.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c not in key]), "_new").alias("v"))
    return last.select(*key, "v.*").drop("_new").select(history.columns)
