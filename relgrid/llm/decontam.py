"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to FEATURES slots and counted over all documents; that gives the inverse frequencies.
2. The latent space is fitted on the passages of all documents, as TF-IDF rows A: every task adds up its part of A'(A Omega) for one random matrix Omega, and the
   sum gives the leading singular vectors and values of A in one pass (the Nystrom form of the randomised SVD).
3. Documents and benchmark items are compared in that latent space, whitened: windows of 16, 32 and 64 words, every 8 words, against the items
   (long ones in parts). A cosine of COSINE or more makes a candidate. Short items fill too little of a window for that, and
   edits lower it, so a stretch that shares enough pairs of adjacent words with an item is a candidate too. Half of what must be left
   of them when all but LIKELY of the item's words are replaced is enough, so nothing that step 4 accepts is lost by replacing words.
4. Each candidate is checked on the words themselves: the longest common subsequence of item and surroundings, and whether
   the item's answer (its last sentence, or last quarter) is there too. That catches paraphrases that keep most words in order.

Defined results: null and empty texts and items of under MIN_WORDS words match nothing. Repeated documents and items give a row each.
Rows with a null id keep it. Without documents or items there are no rows. Texts are searched whole, the benchmark in blocks
of ITEMS items, one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgrid.llm.common import lean, small_batches
from relgrid.llm.tables import sum_tables
from relgrid.llm.vec import LOWER, NON_WORD, U64, mix, portions, segments, utf8, word_hashes, word_spans

FEATURES, RANK, SKETCH, ITEMS = 1 << 15, 64, 80, 5000
#: Tasks that fit the space, each sending one FEATURES x SKETCH table: all up to FIT_TASKS partitions, and beyond that one for every FIT_SHARE of them.
FIT_TASKS, FIT_SHARE = 64, 4
STEP, SCALES, FITTED, BLOCKS, PASSAGES = 8, (16, 32, 64), 32, 4096, 4096  # words between windows, in windows, in the passages that the SVD sees; blocks and passages summed at once
COSINE, SURE, LIKELY, ANSWER, MIN_WORDS = 0.6, 0.8, 0.65, 0.5, 5
#: Runs of rows summed together, so few that their sums stay in cache, and rows of a run that are added one by one to those of other runs.
RUNS, ROUNDS = 512, 64
#: Bits of the filter on pairs of words, pairs looked at together, most pairs that a candidate must share, most places of one pair in an item.
FILTER, PAIRS, SHARED, PLACES = 1 << 22, 1 << 20, 4, 4


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the first of each row."""
    buf, offsets = utf8(column)
    buf = LOWER[buf]
    start, end, first = word_spans(buf, offsets, NON_WORD)
    return word_hashes(buf, start, end), first


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U64(FEATURES - 1)).astype(np.int64)


@dataclass
class Space:
    """vectors: for each slot its weighted, whitened latent vector."""

    vectors: np.ndarray
    singular: np.ndarray


def _sums(table: np.ndarray, index: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs, sums) in parts that hold each run once: the sums of table[index] over runs of index, given by their starts and sizes (1 at least).
    Runs go by size, so that their next rows are added to a leading part of the sums."""
    order = np.argsort(-size, kind="stable")
    for low in range(0, len(order), RUNS):
        runs = order[low : low + RUNS]
        head, less = start[runs], -size[runs]
        out = table.take(index[head], axis=0)
        longer = np.searchsorted(less, -np.arange(1, ROUNDS + 1)).tolist()  # how many runs have more than 1, 2, ... rows
        for j, n in enumerate(longer[:-1], 1):
            if not n:
                break
            out[:n] += table.take(index[head[:n] + j], axis=0)
        for k in range(longer[-1]):
            rest = table.take(index[head[k] + ROUNDS : head[k] - less[k]], axis=0)
            out[k] += np.ones(len(rest), table.dtype) @ rest  # rounds less than `sum`
        yield runs, out


def _add_passages(out: np.ndarray, slot: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray, weighted: np.ndarray) -> None:
    """Adds A'(A Omega) of some passages to `out`. slot: of their words; weighted: the weights' rows of Omega."""
    y = np.empty((len(start), SKETCH), np.float32)
    for some, sums in _sums(weighted, slot, start, size):
        y[some] = sums
    y /= np.maximum(np.add.reduceat(weight[slot] ** 2, start), 1e-9)[:, None]
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    by = slot[order]
    head = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
    passage = segments(size)[order]
    for some, sums in _sums(y, passage, head, np.diff(np.append(head, len(by)))):
        own = by[head[some]]
        sums *= weight[own][:, None]
        out[own] += sums


def fit(rows: DataFrame, text: str = "text") -> Space | None:
    """The latent space of all rows' passages; None if there are no words."""
    texts = small_batches(rows).select(F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(FEATURES, np.int64)
        for batch in portions(batches):
            out += np.bincount(_slot(words(batch.column(0))[0]), minlength=FEATURES)
        return out

    counts = sum_tables(texts, count, (FEATURES,), wire="int64")
    total = counts.sum()
    if not total:
        return None
    weight = np.log1p(total / FITTED / (1.0 + counts)).astype(np.float32)
    omega = np.random.default_rng(11).standard_normal((FEATURES, SKETCH)).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((weight, omega * weight[:, None]))  # FEATURES x SKETCH numbers

    def product(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weight, weighted = shared.value
        out = np.zeros((FEATURES, SKETCH), np.float32)
        for batch in portions(batches, limit=1 << 19):
            hashes, first = words(batch.column(0))
            slots, starts = _slot(hashes), np.append(_blocks(first, FITTED)[0], len(hashes))
            for low in range(0, len(starts) - 1, PASSAGES):
                start = starts[low : low + PASSAGES + 1]
                _add_passages(out, slots[start[0] : start[-1]], start[:-1] - start[0], np.diff(start), weight, weighted)
        return out

    few = max(FIT_TASKS, texts.rdd.getNumPartitions() // FIT_SHARE)  # grows with the input, so that no task has more than a few partitions
    z = sum_tables(texts.coalesce(few), product, (FEATURES, SKETCH), dtype="float64", wire="float32")
    shift = np.finfo(np.float32).eps * np.linalg.norm(z)
    z = z + shift * omega
    middle = omega.T.astype(float) @ z
    middle = (middle + middle.T) / 2
    values, basis = np.linalg.eigh(middle)
    keep = values > values.max() * 1e-10
    left, spread, _ = np.linalg.svd(z @ (basis[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    singular = np.sqrt(np.maximum(spread**2 - shift, 0))[:RANK]
    use = singular > singular[0] * 1e-6
    vectors = left[:, :RANK][:, use] / singular[use] * weight[:, None]
    return Space(np.ascontiguousarray(vectors, np.float32), singular[use])  # in rows: `take` copies any other order whole


def _blocks(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of each document's blocks of `size` words, and for each document its first block (n + 1 entries)."""
    n = -(-np.diff(first) // size)
    block = np.zeros(len(first), np.int64)
    np.cumsum(n, out=block[1:])
    return np.repeat(first[:-1], n) + (np.arange(block[-1]) - np.repeat(block[:-1], n)) * size, block


def lcs(masks: dict[int, int], n: int, region: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words (masks: word to its places as bits) and a list of words."""
    full = row = (1 << n) - 1
    for word in region:
        if (m := masks.get(word)) is not None:
            both = row & m
            row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


@dataclass
class Item:
    ident: object
    n: int
    masks: dict
    answer: dict
    answer_n: int
    slots: np.ndarray  # up to 64 different ones of its words
    untracked: int  # words beyond one for each of those
    vector: np.ndarray


def _adjacent(hashes: np.ndarray) -> np.ndarray:
    """A hash for each word and the next one."""
    return mix(hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:])


def _masks(seq: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(seq):
        out[w] = out.get(w, 0) | 1 << k
    return out


class Index:
    """Items by scale: unit latent vectors of their parts, and what the checks need."""

    def __init__(self, space: Space, idents: list, texts: list[str | None]) -> None:
        column = pa.array([t or "" for t in texts], pa.string())
        hashes, first = words(column)
        self.space, self.items, kept = space, [], []
        parts: dict[int, list[tuple[int, np.ndarray]]] = {s: [] for s in SCALES}
        for k, ident in enumerate(idents):
            seq = hashes[first[k] : first[k + 1]]
            if len(seq) < MIN_WORDS:
                continue
            body = (texts[k] or "").rstrip().rstrip(".!?")
            at = max(body.rfind(c) for c in ".!?\n") + 1
            tail = words(pa.array([body[at:]], pa.string()))[0] if at else seq[-max(1, len(seq) // 4) :]
            answer = (tail if len(tail) else seq[-1:]).tolist()
            masks = _masks(seq.tolist())
            kept.append(seq)
            slots = np.unique(_slot(np.array(list(masks), U64)))[:64]
            self.items.append(Item(ident, len(seq), masks, _masks(answer), len(answer), slots, len(seq) - len(slots), _unit(space.vectors[_slot(seq)].sum(0)[None])[0]))
            longest = SCALES[-1]
            for a in range(0, len(seq), longest):
                part = seq[a : a + longest]
                if a and len(part) < longest // 2:  # a short end, with what is before it
                    part = seq[-longest:]
                scale = next((s for s in SCALES if len(part) <= 1.5 * s), longest)
                parts[scale].append((len(self.items) - 1, space.vectors[_slot(part)].sum(0)))
        self.parts = {s: (np.array([i for i, _ in p]), _unit(np.stack([v for _, v in p]))) for s, p in parts.items() if p}
        pairs: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(kept):
            own: dict[int, list[int]] = {}
            for at, pair in enumerate(_adjacent(seq).tolist()):
                own.setdefault(pair, []).append(at)
            for pair, places in own.items():
                pairs.setdefault(pair, []).extend((k, at) for at in places[:PLACES])
        self.pairs = np.array(sorted(pairs), U64)
        entries = [e for pair in self.pairs.tolist() for e in pairs[pair]]
        self.entry_item, self.entry_at = np.array(entries, np.int64).reshape(-1, 2).T
        self.entries = np.r_[0, np.cumsum([len(pairs[pair]) for pair in self.pairs.tolist()], dtype=np.int64)]
        self.filter = np.zeros(FILTER, bool)
        self.filter[(self.pairs & U64(FILTER - 1)).astype(np.int64)] = True
        self.n = np.array([i.n for i in self.items], np.int64)
        left = np.ceil(LIKELY * self.n).astype(np.int64)
        self.needed = np.clip((left - (self.n - left) - 1) // 2, 1, SHARED)

    def seeds(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, first word, words, nan) of stretches that share pairs of adjacent words with an item, at about the same distance."""
        out = [(np.zeros(0, np.int64),) * 4]
        if len(self.pairs) and len(hashes) > 1:
            pair = _adjacent(hashes)
            place = np.flatnonzero(self.filter[(pair & U64(FILTER - 1)).astype(np.int64)])
            known = np.minimum(np.searchsorted(self.pairs, pair[place]), len(self.pairs) - 1)
            doc = np.searchsorted(first, place, "right") - 1
            good = (self.pairs[known] == pair[place]) & (place + 1 < first[doc + 1])
            place, known, doc = place[good], known[good], doc[good]
            n = self.entries[known + 1] - self.entries[known]
            so_far = np.cumsum(n)
            a = 0
            while a < len(place):
                b = max(a + 1, int(np.searchsorted(so_far, (so_far[a - 1] if a else 0) + PAIRS, "right")))
                if b < len(place):  # whole documents
                    low = int(np.searchsorted(doc, doc[b]))
                    b = low if low > a else int(np.searchsorted(doc, doc[b], "right"))
                out.append(self._together(first, place[a:b], known[a:b], doc[a:b], n[a:b]))
                a = b
        found = tuple(np.concatenate(c) for c in zip(*out, strict=True))
        return *found, np.full(len(found[0]), np.nan)

    def _together(self, first: np.ndarray, place: np.ndarray, known: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        entry = np.repeat(self.entries[known] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, doc = self.entry_item[entry], np.repeat(doc, n)
        width = STEP // 2 + self.n[item] // 8  # two of them are in reach of `plausible`
        bucket = (np.repeat(place, n) - first[doc] - self.entry_at[entry]) // width
        lowest = int(bucket.min()) - 1
        span = int(bucket.max()) - lowest + 1
        key = ((doc - doc[0]) * len(self.items) + item) * span + bucket - lowest
        key, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        rest, bucket = np.divmod(key, span)
        item = rest % len(self.items)
        enough = counts >= self.needed[item]
        doc, item, bucket = (rest // len(self.items) + doc[0])[enough], item[enough], bucket[enough] + lowest
        at = np.clip((bucket + 1) * (STEP // 2 + self.n[item] // 8), 0, first[doc + 1] - first[doc] - 1)
        return doc, item, at, self.n[item]

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, first word in the document, words, cosine) of windows that are near an item."""
        start, block = _blocks(first, STEP)
        out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
        slot = _slot(hashes)
        # Runs of whole documents with about BLOCKS blocks, so that sums stay in cache.
        cut = np.unique(np.minimum(np.searchsorted(block, np.arange(0, len(start) + BLOCKS, BLOCKS)), len(first) - 1))
        for low, high in zip(cut, cut[1:], strict=False):
            a, b = block[low], block[high]
            here = np.arange(a, b)
            if not len(here):
                continue
            doc = low + segments(np.diff(block[low : high + 1]))
            ends = block[doc + 1]
            size = np.minimum(first[doc + 1] - start[a:b], STEP)
            sums = np.empty((b - a, self.space.vectors.shape[1]), np.float32)
            for some, part in _sums(self.space.vectors, slot, start[a:b], size):
                sums[some] = part
            blocks = 1
            for scale in SCALES:
                while blocks < scale // STEP:
                    longer = sums.copy()
                    longer[:-blocks] += sums[blocks:]
                    last = np.flatnonzero(here[:-blocks] + blocks >= ends[:-blocks])  # nothing of their document follows
                    longer[last] = sums[last]
                    sums, blocks = longer, blocks * 2
                if scale not in self.parts:
                    continue
                owner, vectors = self.parts[scale]
                at = np.flatnonzero((here + blocks <= ends) | (here == block[doc]))
                near = _unit(sums[at]) @ vectors.T
                w, i = np.divmod(np.flatnonzero(near >= COSINE), len(owner))
                d = doc[at[w]]
                out.append((d, owner[i], start[a:b][at[w]] - first[d], np.full(len(w), scale), near[w, i]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def plausible(self, hashes: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(candidate, first word, end in the document) of those whose surroundings hold enough different words of the item for its subsequence."""
        slot, bits = _slot(hashes), np.zeros(FEATURES, U64)
        order = np.argsort(item, kind="stable")
        cuts = np.flatnonzero(np.r_[True, item[order][1:] != item[order][:-1]]) if len(order) else []
        kept = [(np.zeros(0, np.int64),) * 3]
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True) if len(order) else ():
            some, own = order[a:b], self.items[item[order[a]]]
            bits[own.slots] = U64(1) << np.arange(len(own.slots), dtype=U64)
            reach = np.maximum(own.n - size[some], 0) + own.n // 4 + STEP
            length = first[doc[some] + 1] - first[doc[some]]
            begin, end = np.maximum(0, at[some] - reach), np.minimum(length, at[some] + size[some] + reach)
            n = end - begin
            edge = np.cumsum(n) - n
            index = np.repeat(first[doc[some]] + begin - edge, n) + np.arange(n.sum())
            found = np.bitwise_count(np.bitwise_or.reduceat(bits[slot[index]], edge))
            bits[own.slots] = 0
            good = found + own.untracked >= LIKELY * own.n
            kept.append((some[good], begin[good], end[good]))
        return tuple(np.concatenate(c) for c in zip(*kept, strict=True))

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, float, float, int, int]]:
        """(document, item, cosine, lcs, answer, first word, words): of each document and item the best that passes the checks."""
        best: dict[tuple[int, int], tuple] = {}
        doc, owner, place, size, cosines = (np.concatenate(c) for c in zip(self.candidates(hashes, first), self.seeds(hashes, first), strict=True))
        for c, a, b in zip(*(x.tolist() for x in self.plausible(hashes, first, doc, owner, place, size)), strict=True):
            d, k, cosine = int(doc[c]), int(owner[c]), float(cosines[c])
            item = self.items[k]
            region = hashes[first[d] + a : first[d] + b].tolist()
            share = lcs(item.masks, item.n, region) / item.n
            if share < LIKELY:
                continue
            answer = lcs(item.answer, item.answer_n, region) / item.answer_n
            if share >= SURE or answer >= ANSWER:
                if cosine != cosine:
                    low = first[d] + int(place[c])
                    cosine = float(_unit(self.space.vectors[_slot(hashes[low : min(low + item.n, first[d + 1])])].sum(0)[None])[0] @ item.vector)
                found = (share, cosine, answer, a, b - a)
                if (d, k) not in best or found[:2] > best[d, k][:2]:
                    best[d, k] = found
        for (d, k), (share, cosine, answer, a, n) in sorted(best.items()):
            yield d, k, cosine, share, answer, a, n


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    named = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t"))
    blocks = max(1, -(-named.count() // ITEMS))
    for b in range(blocks):
        found = named.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect() if blocks > 1 else named.collect()
        yield [r.i for r in found], [r.t for r in found]


def search(rows: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", space: Space | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word, n_words) for every document and item that the document holds or paraphrases."""
    spark = rows.sparkSession
    docs = small_batches(rows).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema[item_id].dataType), *T.StructType.fromDDL("cosine double, lcs double, answer double, first_word bigint, n_words bigint").fields])
    space = space or fit(docs)
    out = spark.createDataFrame([], schema)
    for idents, texts in _item_blocks(items, item_id, item_text) if space else ():
        shared = spark.sparkContext.broadcast(Index(space, idents, texts))  # ITEMS items
        out = out.union(docs.mapInArrow(lean(_finder(shared, schema)), schema))
    return out


def _finder(shared: object, schema: T.StructType) -> object:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in portions(batches):
            found = list(index.matches(*words(batch.column(1))))
            if found:
                doc, item, *rest = zip(*found, strict=True)
                columns = [batch.column(0).take(pa.array(doc)), pa.array([index.items[k].ident for k in item], kinds.field(1).type), *(pa.array(c, kinds.field(k + 2).type) for k, c in enumerate(rest))]
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    return run


def clean(rows: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, all columns as they are, that hold no item."""
    space = fit(rows, text)
    at = rows.columns.index(text)
    for idents, texts in _item_blocks(items, item_id, item_text) if space else ():
        shared = rows.sparkSession.sparkContext.broadcast(Index(space, idents, texts))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in portions(batches, text):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in index.matches(*words(batch.column(at)))]] = False
                yield batch.filter(pa.array(keep))

        rows = rows.mapInArrow(lean(run), rows.schema)
    return rows
