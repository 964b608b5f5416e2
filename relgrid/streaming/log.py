"""A stream of operations, applied to an engine batch by batch in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from relgrid.engine import Engine
from relgrid.functions.columns import COLUMNS


def follow(engine: Engine, operations: DataFrame, checkpoint: str) -> StreamingQuery:
    """Publishes a revision for each micro-batch of a streaming frame (op and the six columns).

    Operations are taken as touches and deletes of what may be there, so a batch that is delivered again changes nothing.
    """

    def publish(batch: DataFrame, number: int) -> None:
        engine.merge(batch.select("op", *COLUMNS))

    return operations.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).start()
