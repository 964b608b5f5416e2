"""Cross-entropy difference between a target and a background language model.

Both are word bigram models with the same smoothing, over the same words: the background counts every document, the target those
marked as target. A word's loss is -log2 P(word | word before), with the bigram count smoothed towards the unigram share by a Dirichlet prior. A
document's score is the mean over its words of target loss less background loss: the lower, the more it is like the target.
A document is scored by what the other documents hold: its own words and bigrams are taken off the counts of each model that read it. With them,
a target document is known by heart, and its score tells that it is in the target rather than what it is like.

Words and bigrams are counted exactly, each under its own 64-bit hash, and the models are as large as the corpus makes them:

1. Documents are written in chunks of about CHUNK bytes. Each chunk sends its different words and bigrams with their counts to
   ranges of hashes, which grow in number with the corpus; so a common word is one entry a chunk, and no range is hot.
2. A range adds up its chunks' counts and sends every chunk the totals of what it sent, in the same order.
3. Each chunk is joined with its totals, which are all that its documents' losses need beside their own counts. Nothing is gathered or broadcast but sums.

Defined results: null and empty texts have 0 words and null losses. Without (other) target documents the target model is
uniform. Repeated rows count as often as they occur, and each is scored by the others. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgrid.llm.common import small_batches, written
from relgrid.llm.decontam import words
from relgrid.llm.vec import U64, mix, portions

#: VOCABULARY: words that smoothing allows for; more where the corpus has more.
VOCABULARY, PRIOR, UNSEEN = 1 << 18, 50.0, 0.5
#: Up to so many target ids are broadcast; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Bytes of text in a chunk; words of the corpus for each range of hashes, and the fewest ranges.
CHUNK, RANGE_WORDS, RANGES = 4 << 20, 2_000_000, 32
FIELDS = "n_words bigint, target_loss double, background_loss double, score double"


def keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, bigram hashes, whether a word has one before it, first word of each row); a bigram is named by its last word."""
    word, first = words(column)
    has = np.ones(len(word), bool)
    starts = first[:-1]
    has[starts[starts < len(word)]] = False
    prior = np.zeros(len(word), U64)
    prior[1:] = word[:-1]
    return word, mix(prior * U64(0x9E3779B97F4A7C15) + word), has, first


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers, bytes of one rank together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype(U64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T).view(U64).reshape(-1)


def chunks(rows: DataFrame) -> DataFrame:
    """Rows (..., text, target), written as rows (chunk, n, t, body): words, words of target documents, and the rows as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for k, batch in enumerate(portions(batches, "text__", CHUNK)):
            n = np.diff(words(batch.column(batch.num_columns - 2))[1])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([base | k], pa.int64()), "n": pa.array([n.sum()], pa.int64()), "t": pa.array([n[_marked(batch)].sum()], pa.int64()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return written(rows.mapInArrow(run, "chunk bigint, n bigint, t bigint, body binary"), "chunks")


def _rows(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _marked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)


def totals(chunked: DataFrame, ranges: int) -> DataFrame:
    """(chunk, kind, part, counts, found): for every chunk the corpus's counts of its words (kind 0) and bigrams (kind 1) in each
    range of hashes, background then target, in order of hash; found: the range's different keys, in one row of each range."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], U64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = _rows(body.as_py())
                word, pair, has, first = keys(rows.column(rows.num_columns - 2))
                target = np.repeat(_marked(rows), np.diff(first))
                out = []
                for kind, (key, some) in enumerate(((word, target), (pair[has], target[has]))):
                    known, at, n = np.unique(key, return_inverse=True, return_counts=True)
                    t = np.bincount(at[some], minlength=len(known))
                    cut = np.r_[0, np.searchsorted(known, edges), len(known)]
                    out += [(chunk, kind, p, pack(np.diff(known[a:b], prepend=U64(0))), pack(n[a:b]), pack(t[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "kind", "part", "keys", "n", "t"])

    def add(table: pa.Table) -> pa.Table:
        sent = [np.cumsum(unpack(raw), dtype=U64) for raw in table["keys"].to_pylist()]
        key = np.concatenate(sent)
        order = np.argsort(key, kind="stable")
        head = np.r_[True, np.diff(key[order]) != 0]
        at, group = np.flatnonzero(head), np.cumsum(head) - 1
        whole = []
        for name in ("n", "t"):
            some = np.concatenate([unpack(raw) for raw in table[name].to_pylist()])
            back = np.empty_like(some)
            back[order] = np.add.reduceat(some[order], at)[group]
            whole.append(back)
        cut = np.r_[0, np.cumsum([len(s) for s in sent])]
        counts = [pack(np.concatenate([w[a:b] for w in whole])) for a, b in zip(cut, cut[1:], strict=False)]
        found = [len(at)] + [0] * (len(sent) - 1)
        return pa.table({"chunk": table["chunk"], "kind": table["kind"], "part": table["part"], "counts": pa.array(counts, pa.binary()), "found": pa.array(found, pa.int64())})

    entries = chunked.select("chunk", "body").mapInArrow(send, "chunk bigint, kind int, part int, keys binary, n binary, t binary")
    return written(entries.groupBy("kind", "part").applyInArrow(add, "chunk bigint, kind int, part int, counts binary, found bigint"), "totals")


def _of_chunk(table: pa.Table, kind: int) -> np.ndarray:
    """(2, keys): counts of a chunk's different words or bigrams, in order of hash."""
    rows = sorted((r["part"], r["counts"]) for r in table.select(["kind", "part", "counts"]).to_pylist() if r["kind"] == kind)
    return np.concatenate([np.zeros((2, 0)), *(unpack(raw).reshape(2, -1) for _, raw in rows)], axis=1)


def _own(ident: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each place's key (a small number) occurs in the place's document."""
    _, at, n = np.unique(doc * (int(ident.max(initial=0)) + 1) + ident, return_inverse=True, return_counts=True)
    return n[at]


def score(rows: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Every row's `keep` columns with n_words, target_loss, background_loss and score; target_ids: one column of ids."""
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("id__")).where("id__ is not null").distinct()
    few = ids.count() <= BROADCAST_IDS
    marked = ids.withColumn("target__", F.lit(True))
    kept = small_batches(rows).select(*(keep or []), F.col(doc_id).alias("id__"), F.col(text).cast("string").alias("text__"))
    fields = kept.schema.fields[:-2]
    width = len(fields)
    whole = kept.join(F.broadcast(marked) if few else marked, "id__", "left").withColumn("target__", F.coalesce("target__", F.lit(False))).drop("id__")
    chunked = chunks(whole)
    sums = chunked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    counted = totals(chunked, max(RANGES, -(-sums.n // RANGE_WORDS)))
    known = max(VOCABULARY, counted.where("kind = 0").agg(F.sum("found")).first()[0] or 0)
    mass = np.array([[sums.n], [sums.t]]) + UNSEEN * known

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        done = []
        for body in left["body"].to_pylist():
            batch = _rows(body)
            word, pair, has, first = keys(batch.column(width))
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            read = np.stack([np.ones(len(n), bool), _marked(batch)])  # which model read which document
            own = read[:, doc]
            ident = np.unique(word, return_inverse=True)[1]
            single = _of_chunk(right, 0)[:, ident] - own * _own(ident, doc)
            ident = np.unique(pair[has], return_inverse=True)[1]
            seen, context = np.zeros_like(single), np.zeros_like(single)
            seen[:, has] = _of_chunk(right, 1)[:, ident] - own[:, has] * _own(ident, doc[has])
            context[:, 1:] = single[:, :-1]
            context[:, ~has] = 0
            share = (single + UNSEEN) / (mass - read * n)[:, doc]
            total = np.zeros((2, len(word) + 1))
            np.cumsum(-np.log2((seen + PRIOR * share) / (context + PRIOR)), axis=1, out=total[:, 1:])
            mean = (total[:, first[1:]] - total[:, first[:-1]]) / np.maximum(n, 1)
            none = n == 0
            columns = [pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=none) for x in (mean[1], mean[0], mean[1] - mean[0]))]
            done.append(pa.Table.from_arrays([*(batch.column(k) for k in range(width)), *columns], names=[*batch.schema.names[:width], "n_words", "target_loss", "background_loss", "score"]))
        return pa.concat_tables(done)

    schema = T.StructType([*fields, *T.StructType.fromDDL(FIELDS).fields])
    return chunked.select("chunk", "body").groupBy("chunk").cogroup(counted.drop("found").groupBy("chunk")).applyInArrow(run, schema)
