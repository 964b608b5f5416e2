"""Benchmark history: estimates from JSON files, kept as one row per run and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgrid.operators.stats import upsert

ESTIMATES = "mean struct<point_estimate: double, confidence_interval: struct<lower_bound: double, upper_bound: double>>"


def read_estimates(spark: SparkSession, path: str, run_id: str, recorded_at: str) -> DataFrame:
    """(run_id, benchmark, recorded_at, low_ns, mean_ns, high_ns) of files <path>/**/<benchmark>/new/estimates.json."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "estimates.json").option("multiLine", "true").schema(ESTIMATES).json(path)
    named = raw.withColumn("file", F.col("_metadata.file_path")).where(F.col("file").rlike("/new/estimates\\.json$"))
    prefix = F.lit("/" + path.rstrip("/").split("/")[-1] + "/")
    return named.select(F.lit(run_id).alias("run_id"), F.regexp_replace(F.substring_index("file", prefix, -1), "/new/estimates\\.json$", "").alias("benchmark"), F.lit(recorded_at).alias("recorded_at"), F.col("mean.confidence_interval.lower_bound").alias("low_ns"), F.col("mean.point_estimate").alias("mean_ns"), F.col("mean.confidence_interval.upper_bound").alias("high_ns"))


def merge(history: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(history, new, ["run_id", "benchmark"])
