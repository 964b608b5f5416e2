"""Language identification by compression.

A language's model is a zstandard raw-content dictionary: pieces of SAMPLE_ROWS training texts of that language of whatever length, one after
another, DICTIONARY_BYTES in all. Texts too long for their part give a piece from a place that their hash chooses.
A text is lower-cased, runs of anything but letters become one space, and what is left is encoded in windows with every
dictionary; the language whose dictionary gives the fewest bytes wins. Where the runner-up is within `margin` of the winner (relative to the winner's bytes), the text is rejected as undecided.

A short text often finds no match in any dictionary, and whole bytes are too coarse to tell its margin. Where languages are within RESOLUTION bytes
of the winner, and the margin is under that, these are told apart by a finer measure: the text is encoded behind each of CARRIERS pieces of a language's
dictionary, and what it adds to them is summed up, so that letters count as matches do. The margin is then FINER times as wide.

Defined results: a null, empty or letterless text is `und` with score 0 and rejected. Equal totals go to the
language that is first in alphabetical order. With no training rows every text is `und`. Repeated rows are
judged alike. Texts are encoded whole, in windows of `WINDOW` bytes, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgrid.llm.common import lean, small_batches

#: Bounds of the sample on which dictionaries are fitted, per language: so many texts, so many characters of each, and so many bytes in all.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 8192, 1 << 17
WINDOW = 4096
LEVEL = 6
#: Rejected: a runner-up within this share of the winner's bytes.
MARGIN = 0.004
#: The finer measure of short texts.
RESOLUTION, CARRIERS, CARRIER_BYTES, FINER = 3, 16, 1024, 5
UNDECIDED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """What is encoded: the letters in lower case, with one space for anything else."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries from labelled rows: of each language the `sample_rows` different texts with the smallest hashes, each up to the length that lets all of them in."""
    spark = rows.sparkSession
    known = small_batches(rows).select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null and t <> ''").select("t", F.col("l").cast("string").alias("l"))
    keyed = _least(known.select("l", F.xxhash64("t").alias("h")), sample_rows)
    groups = max(1, math.isqrt(known.rdd.getNumPartitions()))
    # Among some tasks first and then among all, so that no task ranks more than the root of their number times sample_rows.
    first = keyed.withColumn("part", F.pmod("task", F.lit(groups)))
    for by in (["l", "part"], ["l"]):
        first = first.withColumn("r", F.dense_rank().over(Window.partitionBy(by).orderBy("h"))).where(F.col("r") <= sample_rows).select("l", "h", "part").distinct()
    chosen = first.select("l", "h").distinct().collect()  # languages x sample_rows
    if not chosen:
        return {}
    keys = F.broadcast(spark.createDataFrame(chosen, "l string, h long"))
    size = int(sample_bytes)
    piece = F.expr(f"if(length(t) <= {size}, t, substring(t, 1 + cast(pmod(xxhash64(t, 'place'), length(t) - {size} + 1) AS int), {size}))")
    texts = known.withColumn("h", F.xxhash64("t")).join(keys, ["l", "h"]).groupBy("l", "h").agg(F.min(piece).alias("t")).collect()
    out: dict[str, list[tuple[int, str]]] = {}
    for row in texts:
        out.setdefault(row.l, []).append((row.h, row.t))
    return {name: _joined([(h, plain(t)) for h, t in sorted(found)]) for name, found in sorted(out.items())}


def _least(rows: DataFrame, k: int) -> DataFrame:
    """(l, h, task): of each task's rows (l, h) the k smallest different hashes of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in pc.unique(table["l"]).to_pylist():
                found = table.filter(pc.equal(table["l"], name))["h"].to_numpy()
                least[name] = np.unique(np.concatenate([least.get(name, found[:0]), found]))[:k]
        task = TaskContext.get().partitionId()
        for name, found in least.items():
            yield pa.RecordBatch.from_pydict({"l": pa.array([name] * len(found), pa.string()), "h": pa.array(found, pa.int64()), "task": pa.array([task] * len(found), pa.int32())})

    return rows.mapInArrow(lean(run), "l string, h bigint, task int")


def _joined(texts: list[tuple[int, bytes]]) -> bytes:
    """All texts in one dictionary: what is longer than the length that fits gives a piece from a place that its hash chooses."""
    left, limit = DICTIONARY_BYTES - len(texts), 0
    for k, n in enumerate(sorted(len(t) for _, t in texts)):
        limit = left // (len(texts) - k)
        if n > limit:
            break
        left, limit = left - n, n
    cut = [(h % (len(t) - limit + 1) if len(t) > limit else 0, t) for h, t in texts]
    return b" ".join(t[a : a + limit] for a, t in cut)


class Encoder:
    """Compressed sizes of texts under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        self.names = list(dictionaries)
        self.press = []
        for content in dictionaries.values():
            ready = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            ready.precompute_compress(level=level)
            self.press.append(zstandard.ZstdCompressor(dict_data=ready, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.bare = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        self.carriers = []
        for content in dictionaries.values():
            pieces = [content[at : at + CARRIER_BYTES] for at in (k * len(content) // CARRIERS for k in range(CARRIERS))]
            self.carriers.append((pieces, sum(len(self.bare.compress(piece)) for piece in pieces)))

    def sizes(self, text: bytes) -> np.ndarray:
        out = np.zeros(len(self.press), np.int64)
        for at in range(0, len(text), WINDOW):
            part = text[at : at + WINDOW]
            for k, press in enumerate(self.press):
                out[k] += len(press.compress(part))
        return out

    def added(self, text: bytes, language: int) -> int:
        """The bytes that the text adds to the carriers of a language."""
        pieces, alone = self.carriers[language]
        windows = [text[at : at + WINDOW] for at in range(0, len(text), WINDOW)]
        return sum(len(self.bare.compress(piece + b" " + part)) for part in windows for piece in pieces) - alone * len(windows)

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.names or not _LETTER.search(text):
            return UNDECIDED, 0.0, True
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        flat = plain(text)
        sizes = self.sizes(flat)
        least = int(sizes.min())
        extra, slack = sizes - least, margin * least
        rivals = np.flatnonzero(extra < RESOLUTION)
        if slack < RESOLUTION and len(rivals) > 1:
            added = np.array([self.added(flat, k) for k in rivals])
            extra[rivals] = apart = added - added.min()
            slack = FINER * margin * max(int(added.min()), 1)
        else:
            apart = extra
        score = float(1.0 / np.exp2(-np.minimum(extra * 0.25, 60.0)).sum())
        return self.names[int(extra.argmin())], score, bool(np.partition(apart, 1)[1] < slack)


def classify(rows: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN, keep: list[Column] | None = None) -> DataFrame:
    """Every row's `keep` columns with lang_pred, score and rejected."""
    shared = rows.sparkSession.sparkContext.broadcast(dictionaries)  # languages x sample_rows x sample_bytes at most
    kept = small_batches(rows).select(*(keep or []), F.col(text).cast("string").alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    width = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found = [encoder.judge(t, margin) for t in batch.column(width).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:width], "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return kept.mapInArrow(lean(run), schema)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def accepted(rows: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows, all columns as they are, without those that classify() would reject."""
    shared = small_batches(rows).sparkSession.sparkContext.broadcast(dictionaries)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            keep = [not encoder.judge(t, margin)[2] for t in batch.column(at).cast(pa.string()).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(lean(run), rows.schema)
