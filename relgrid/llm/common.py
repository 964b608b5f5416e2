"""Shared folders, lineage cuts and reading of the input tables."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relgrid.plans.lineage import remove_at_exit, shared_dir


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; what is there goes when the driver ends."""
    return remove_at_exit(spark, f"{shared_dir(spark)}/relgrid-{what}-{uuid.uuid4().hex}")


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = scratch(spark, what)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of a record batch between Spark and a Python worker. Spark's own bound, 64 MB, is held several times over in each task.
BATCH_BYTES = 4 << 20


def small_batches(frame: DataFrame) -> DataFrame:
    """The frame; its session now passes batches of BATCH_BYTES at most, unless it is set to smaller ones already."""
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = "".join(c for c in str(conf.get(key)) if c.isdigit())
    if not 0 < int(digits or 0) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return frame


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Task) -> Task:
    """A function for mapInArrow that gives the memory which its task has freed back to the system when the task ends.
    Workers live on, and glibc keeps freed blocks of under 32 MB in each of them, beside the heap of the executor's JVM."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):  # no glibc
                ctypes.CDLL(None).malloc_trim(0)

    return whole


#: A key is hot with more rows than HOT_ROWS and than a HOT_KEYS-th of all; so there are at most HOT_KEYS such keys, which may be broadcast.
HOT_ROWS, HOT_KEYS = 200, 4096


def hot_keys(counts: DataFrame, on: list[str]) -> DataFrame | None:
    """(on, parts__) of the hot keys of a frame (on, n) that counts each key's rows; parts__: in how many parts a join should deal them. None if no key is hot."""
    seen = Observation()
    above = written(counts.select(*on, "n").observe(seen, F.sum("n").alias("n"), F.max("n").alias("top")).where(F.col("n") > HOT_ROWS), "hot")
    most = max(HOT_ROWS, (seen.get["n"] or 0) // HOT_KEYS)
    if (seen.get["top"] or 0) <= most:
        return None
    return above.where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("parts__"))


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left.join(right, on), inner or left: a hot key's rows on the left are dealt over its parts by the columns `by`, each with a copy of the key's rows on the right.
    Without hot keys it is that plain join, which spares the plan two broadcasts."""
    if hot is None:
        return left.join(right, on, how)
    many = F.broadcast(hot)
    parts = F.coalesce("parts__", F.lit(1))
    mine = left.join(many, on, "left").withColumn("part__", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("parts__")
    theirs = right.join(many, on, "left").withColumn("part__", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts__")
    return mine.join(theirs, [*on, "part__"], how).drop("part__")
