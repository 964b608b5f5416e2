"""Cutting lineage between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, as in tests, a folder in the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return given.rstrip("/") if given else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


#: Paths written in the innermost open block of temporary().
_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and a folder that stays does no harm
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove_at_exit(spark: SparkSession, path: str, lasting: bool = False) -> str:
    """The path, which is deleted when this driver ends, or at the end of a block of temporary() unless it is `lasting`: frames that read it may be used until then."""
    atexit.register(delete, spark, path)
    if not lasting and (inside := _OPEN.get()) is not None:
        inside.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Rounds and other intermediate tables written in this block are deleted at its end; an engine's revisions stay.
    For callers that have their results elsewhere by then: frames made in the block can't be read after it."""
    inside: list[str] = []
    outer = _OPEN.set(inside)
    try:
        yield
    finally:
        _OPEN.reset(outer)
        for path in inside:
            delete(spark, path)


def cut(frame: DataFrame, lasting: bool = False) -> DataFrame:
    """The frame as a table written in the shared folder: plans stay short, and a lost executor costs a reread."""
    return frame.sparkSession.read.schema(frame.schema).parquet(written(frame, lasting=lasting))


def written(frame: DataFrame, by: tuple[str, ...] = (), lasting: bool = False) -> str:
    """The path of a table with the frame's rows in the shared folder, in a folder for each value of the columns `by`."""
    path = remove_at_exit(frame.sparkSession, f"{shared_dir(frame.sparkSession)}/round-{uuid.uuid4().hex}", lasting)
    frame.write.partitionBy(*by).parquet(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cut_counted(frame: DataFrame, lasting: bool = False) -> tuple[DataFrame, int]:
    """cut(), and the number of rows, counted as they are written."""
    out, seen = cut_observed(frame, F.count(F.lit(1)).alias("n"), lasting=lasting)
    return out, seen["n"]


def cut_observed(frame: DataFrame, *measures: Column, lasting: bool = False) -> tuple[DataFrame, dict]:
    """cut(), and aggregates of the rows, taken as they are written."""
    seen = Observation()
    out = cut(frame.observe(seen, *measures), lasting)
    return out, seen.get
