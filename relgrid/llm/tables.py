"""Count tables of a fixed width, gathered over all partitions and small enough to hand to every task.

Each task adds its rows up in one array, writes it out in compressed slices, and the slices are summed by
slice number with one batch in memory at a time. What is shuffled grows with the number of tasks; what reaches the
driver and the executors is the table itself, whose size is the fixed parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from relgrid.llm.common import lean

SLICES = 32


def sum_tables(rows: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...], dtype: str = "int64", wire: str = "int32") -> np.ndarray:
    """The sum over all partitions of fill(batches), an array of `shape`. wire: the type sent by each task."""
    length = int(np.prod(shape))
    cuts = np.linspace(0, length, SLICES + 1).astype(int)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = fill(batches).reshape(-1)
        if not flat.any():
            return
        press = zstandard.ZstdCompressor(level=1)
        for k in range(SLICES):
            part = flat[cuts[k] : cuts[k + 1]]
            if part.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "b": pa.array([press.compress(part.astype(wire).tobytes())], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.as_py()), wire)
                if k in total:
                    total[k] += part
                else:
                    total[k] = part.astype(dtype)
        press = zstandard.ZstdCompressor(level=1)
        for k, part in total.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "b": pa.array([press.compress(part.tobytes())], pa.binary())})

    kind = "k int, b binary"
    out = np.zeros(length, dtype)
    for row in rows.mapInArrow(lean(emit), kind).repartition(SLICES, "k").mapInArrow(lean(add), kind).collect():
        out[cuts[row.k] : cuts[row.k + 1]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.b), dtype)
    return out.reshape(shape)
