"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and averages taken over the whole text, cut into bins. For each feature a lookup table of bin scores is
learnt by cyclic boosting: in each round every feature in turn gets one shallow tree (three splits, four leaves) fitted to the gradient, added to its table with
a small step. Then the pairs of features that explain most of what is left get tables over both bins, boosted the same way with trees of one split per side. A score is the sum of
one addition per feature and pair, through a logistic function.

Defined results: null and empty texts have all features 0 and get the model's score for that. With no labelled rows, or
one label alone, the score is 0.5 or that label. Ties and repeated rows are scored alike. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgrid.llm.common import small_batches
from relgrid.llm.vec import SPACE, portions, segments, utf8, word_hashes, word_spans

#: Bound of the sample on which the model is fitted: the labelled rows with the smallest hashes.
SAMPLE_ROWS = 20_000
BINS, ROUNDS, STEP, PAIRS, PAIR_BINS, PAIR_ROUNDS, MIN_LEAF = 32, 120, 0.1, 6, 8, 60, 5
FEATURES = ("words", "word_bytes", "upper", "digits", "punctuation", "symbols", "high_bytes", "lines", "line_words", "distinct", "repeats", "commonest", "symbol_words", "upper_words", "short_words", "lone_symbols")


def _kinds() -> np.ndarray:
    """1 upper, 2 digit, 4 sentence punctuation, 8 other symbol, 16 line end, 32 high byte, 64 letter."""
    out = np.zeros(256, np.uint8)
    out[65:91], out[97:123], out[48:58], out[10] = 1 | 64, 64, 2, 16
    for c in range(33, 127):
        if not chr(c).isalnum():
            out[c] = 4 if chr(c) in ".,;:'\"!?-()" else 8
    out[128:] = 32 | 64
    return out


KINDS = _kinds()


def text_features(column: pa.Array) -> np.ndarray:
    """(rows, features) of a string column."""
    buf, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    kind = KINDS[buf]

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    start, end, first = word_spans(buf, offsets, SPACE)
    words = np.diff(first)
    has = np.maximum(words, 1)
    doc = segments(words)

    def per_word(mask: np.ndarray) -> np.ndarray:
        """Of each word, the bytes that the mask holds."""
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[end] - total[start]

    count = lambda flags: np.bincount(doc, weights=flags, minlength=n) if len(doc) else np.zeros(n)
    length = end - start
    symbols, upper, letters = per_word(kind & 8 > 0), per_word(kind & 1 > 0), per_word(kind & 64 > 0)
    hashes = word_hashes(buf, start, end)
    order = np.lexsort((hashes, doc))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = (hashes[order[1:]] == hashes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    runs = np.flatnonzero(~same)
    run_size = np.diff(np.append(runs, len(order)))
    commonest = np.zeros(n)
    if len(runs):
        np.maximum.at(commonest, doc[order[runs]], run_size)
    adjacent = np.zeros(len(doc), bool)
    if len(doc) > 1:
        adjacent[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lines = per_doc(kind & 16 > 0) + 1
    return np.stack([
        np.log1p(words), (np.diff(offsets) - words) / has, per_doc(kind & 1 > 0) / size, per_doc(kind & 2 > 0) / size, per_doc(kind & 4 > 0) / size, per_doc(kind & 8 > 0) / size,
        per_doc(kind & 32 > 0) / size, np.log1p(lines), words / lines, count(~same[np.argsort(order)] if len(order) else np.zeros(0)) / has, count(adjacent) / has, commonest / has,
        count(symbols > 0) / has, count((upper > 1) & (upper >= letters)) / has, count(length <= 2) / has, count(symbols == length) / has,
    ], 1)


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # features, their edges, table
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for a, b, edges_a, edges_b, table in self.pairs:
            total += table[np.searchsorted(edges_a, x[:, a], "right"), np.searchsorted(edges_b, x[:, b], "right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray, splits: int) -> np.ndarray:
    """Leaf values over bins: the best split of one range at a time, `splits` times."""
    g, h, c = (np.concatenate([[0], np.cumsum(v)]) for v in (gradient, weight, count))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    ranges = [(0, len(gradient))]
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in ranges:
            at = np.arange(a + 1, b)
            at = at[(c[at] - c[a] >= MIN_LEAF) & (c[b] - c[at] >= MIN_LEAF)]
            if len(at):
                won = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (float(won[k]), (a, int(at[k]), b))
        if best[1] is None:
            break
        a, m, b = best[1]
        ranges.remove((a, b))
        ranges += [(a, m), (m, b)]
    out = np.zeros(len(gradient))
    for a, b in ranges:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One split of each axis, the second where the four quarters gain most: leaf values over the grid."""
    pad = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = pad(gradient), pad(weight)
    best, cut = -1.0, (1, 1)
    quarter = lambda m, a, b: (m[a, b], m[a, -1] - m[a, b], m[-1, b] - m[a, b], m[-1, -1] - m[a, -1] - m[-1, b] + m[a, b])
    for a in range(1, gradient.shape[0]):
        for b in range(1, gradient.shape[1]):
            won = sum(x * x / (y + 1.0) for x, y in zip(quarter(g, a, b), quarter(h, a, b), strict=True))
            if won > best:
                best, cut = won, (a, b)
    a, b = cut
    q = [x / (y + 1.0) for x, y in zip(quarter(g, a, b), quarter(h, a, b), strict=True)]
    out = np.empty(gradient.shape)
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = q
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single tables, then of the tables of the strongest pairs."""
    n_features = len(FEATURES)
    if not len(y) or y.min() == y.max():
        bias = 0.0 if not len(y) else (30.0 if y[0] else -30.0)
        return Model([np.zeros(0)] * n_features, [np.zeros(1)] * n_features, [], bias)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    edges = [_edges(x[:, k], BINS) for k in range(n_features)]
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(at, tables, strict=True)]
    total = np.full(len(y), bias)
    for _ in range(ROUNDS):
        for k, table in enumerate(tables):
            p = 1 / (1 + np.exp(-total))
            grow = STEP * _tree(np.bincount(at[k], y - p, len(table)), np.bincount(at[k], p * (1 - p), len(table)), counts[k], 3)
            table += grow
            total += grow[at[k]]
    p = 1 / (1 + np.exp(-total))
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(n_features)]
    spot = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def grids(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        flat = spot[a] * shape[1] + spot[b]
        return np.bincount(flat, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(flat, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = []
    for a in range(n_features):
        for b in range(a + 1, n_features):
            if len(coarse[a]) and len(coarse[b]):
                g, h = grids(a, b, p)
                gains.append((float((g * _pair_tree(g, h)).sum()), a, b))
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in chosen:
            grow = STEP * _pair_tree(*grids(a, b, 1 / (1 + np.exp(-total))))
            table += grow
            total += grow[spot[a], spot[b]]
    return Model(edges, tables, [(a, b, coarse[a], coarse[b], t) for a, b, t in chosen], bias)


def train(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows whose ids the labels hold; labels: at most `sample_rows` of them, by the ids' hashes."""
    chosen = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    texts = small_batches(rows).select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "i")  # sample_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            x = text_features(batch.column(1)).astype("f8")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "y", "x"])

    # One row of an id, however often it is repeated.
    found = texts.select("i", "text", "y").mapInArrow(run, "i string, y int, x array<double>").groupBy("i").agg(F.min(F.struct("y", "x")).alias("v")).select("i", "v.*").toArrow().to_pandas()
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    found = found.sort_values("i", kind="stable")
    return fit(np.stack(found["x"].to_numpy()), found["y"].to_numpy(float))


def score(rows: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Every row's `keep` columns with score and predicted."""
    kept = small_batches(rows).select(*(keep or []), F.col(text).cast("string").alias("text__"))
    fields = kept.schema.fields[:-1]
    width = len(fields)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # FEATURES x BINS and PAIRS x PAIR_BINS^2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text__"):
            p = shared.value.score(text_features(batch.column(width)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype("i4"), pa.int32())], names=[*batch.schema.names[:width], "score", "predicted"])

    return kept.mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL("score double, predicted int").fields]))
