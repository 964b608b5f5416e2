"""Removal of repeated strings: every byte that a string of `LENGTH` bytes covers which also starts anywhere else.

Anchors. Of every window of LENGTH bytes, the stretch of GRAM bytes in it with the least hash (the leftmost, if equal) is its anchor. Equal windows
have their anchors at the same place, so a repeated window's anchor is repeated. An anchor's context is what the windows
that have it as their anchor cover. About one place in seventy-five is an anchor; only these are shuffled.

Contexts. A context that occurs twice as a whole, by a 128-bit cryptographic digest of its bytes, makes all its bytes repeated. What is left are
the contexts that occur once, around the edges of repeated stretches. A window holds the anchor and REACH more bytes, half of them or
more on one side. So two contexts that share a window share the SIDE bytes before or after the anchor: contexts are grouped by anchor and
the hash of these bytes, once for each side, and only where a group has several are bytes fetched.

Suffix sort (suffixes.py). In each group the suffixes of its contexts from one offset on are merge-sorted: prefix polynomial hashes and a binary search find the common
extension of two suffixes, which is then verified byte by byte, and put right if hashes collided. A suffix shares most
with a neighbour in that order. How far its best match reaches can only grow with the offset, so from the rightmost window each look at an order
settles a stretch of windows at once.

Hot groups, of more than SPLIT contexts, are split before they are sorted. One context, of those that occur often if there are any, is the group's pivot, and the
others are compared with it wherever they are. A window that holds more than both share can only be
shared with contexts that differ from the pivot at the same place in the same way; these are the next groups.

Results are those of texts, so equal texts get equal ones; a text of LENGTH bytes or more that occurs in two rows is removed
whole. Defined results: null and empty texts, and texts of under LENGTH bytes, keep all their bytes. Matches never cross
texts. Where bytes are kept as text, those of a character that is cut in two are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgrid.llm.common import dealt_join, hot_keys, lean, small_batches, written
from relgrid.llm.suffixes import Suffixes
from relgrid.llm.vec import U64, mix, portions, prefix_hash, span_hash, utf8

LENGTH, GRAM = 200, 50
REACH = LENGTH - GRAM  # bytes of a context before its anchor
FRAME = REACH + LENGTH
_CHUNK, _PLACE = 1 << 20, U64((1 << 24) - 1)
SIDE = REACH // 2
#: Contexts that one sort takes on at least, contexts of a group that is split first, and rounds of splitting; groups are sorted as they are after these.
GROUPED, SPLIT, ROUNDS = 2_000, 200, 12


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of `width`."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place in it, bytes of context before the place, bytes from it on, hash of the anchor, first and last byte of the context, left and right key) of all anchors.

    A key is a hash of the anchor and the SIDE bytes beside it, 0 where the context has fewer there.
    """
    sizes = np.diff(offsets)
    if len(buf) < LENGTH or not (sizes >= LENGTH).any():
        return (np.zeros(0, np.int64),) * 9
    prefix = prefix_hash(buf)
    n = len(buf) - GRAM + 1
    grams = mix(span_hash(prefix, np.arange(n), np.arange(GRAM, GRAM + n)))
    step = np.zeros(len(buf) + 1, np.int64)
    np.add.at(step, offsets[:-1][sizes >= LENGTH], 1)
    np.add.at(step, (offsets[1:] - LENGTH + 1)[sizes >= LENGTH], -1)
    valid = np.cumsum(step[:-1]) > 0
    places, windows = [], []
    for at in range(0, len(buf) - LENGTH + 1, _CHUNK):
        size = min(_CHUNK, len(buf) - LENGTH + 1 - at)
        part = grams[at : at + size + REACH]
        least = _sliding_min((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), REACH + 1)
        own = np.flatnonzero(valid[at : at + size])
        places.append((least[own] & _PLACE).astype(np.int64) + at)
        windows.append(own + at)
    place, window = np.concatenate(places), np.concatenate(windows)
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    begin, end = window[head], window[np.append(head[1:], len(window)) - 1] + LENGTH
    place = place[head]
    doc = np.searchsorted(offsets, place, "right") - 1
    stop = place + GRAM
    left, right = place - begin >= SIDE, end - stop >= SIDE
    name = mix(grams[place])
    keys = (
        np.where(left, mix(name ^ span_hash(prefix, np.where(left, place - SIDE, place), place)), U64(0)),
        np.where(right, mix(name + span_hash(prefix, stop, np.where(right, stop + SIDE, stop))), U64(0)),
    )
    return doc, place - offsets[doc], place - begin, end - place, grams[place].view(np.int64), begin, end, keys[0].view(np.int64), keys[1].view(np.int64)


def against_pivots(frames: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray, others: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Contexts (rows of frames) against the pivots of their groups (rows of others), which are other contexts.

    Gives the first and last window that each shares with its pivot (none if first > last), and for the next groups rows (context, group, first
    and last window asked for): beyond the pivot's extension, to the right or left, with contexts that go on there with the same byte.
    """
    n = len(frames)
    suffixes = Suffixes(np.concatenate([frames.reshape(-1), others.reshape(-1)]))
    middle = np.arange(n) * FRAME + REACH
    right = suffixes.common(middle, middle + n * FRAME, np.minimum(high, other_high) - REACH)
    left = suffixes.common_left(middle, middle + n * FRAME, REACH - np.maximum(low, other_low))
    parts = []
    for side, more, key, first, last in (
        (0, right < high - REACH, lambda i: span_hash(suffixes.prefix, middle[i], middle[i] + right[i] + 1), np.maximum(a, right - GRAM + 1), b),
        (1, left < REACH - low, lambda i: span_hash(suffixes.prefix, middle[i] - left[i] - 1, middle[i]), a, np.minimum(b, np.minimum(REACH - left - 1, right - GRAM))),
    ):
        i = np.flatnonzero(more)
        code = mix(key(i) + mix(group[i].view(U64) * U64(2) + U64(side)) + (right if side == 0 else left)[i].astype(U64))
        parts.append((i, code.view(np.int64), first[i], last[i]))
    return REACH - left, right - GRAM, tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def repeated_windows(frames: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(context, first, last): stretches of windows between a and b that another context of the group holds; none are asked for if a > b.

    frames: contexts (rows of FRAME bytes, valid from low to high, the anchor at REACH), in ascending groups.
    """
    found = _settle(frames, low, high, group, a, b)
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _settle(frames: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """(context, first, last): stretches of windows between a and b that another of the group's contexts holds, by suffix sorts."""
    suffixes = Suffixes(frames.reshape(-1))
    first_of = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
    number = np.repeat(np.arange(len(first_of) - 1), np.diff(first_of))
    right = b.copy()  # the rightmost window not settled
    out = []
    live = np.flatnonzero(right >= a)
    while len(live):
        wanted = np.unique(number[live] * FRAME + right[live])  # orders: of a group, at an offset
        g, o = wanted // FRAME, wanted % FRAME
        size = first_of[g + 1] - first_of[g]
        which = np.repeat(np.arange(len(g)), size)
        member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first_of[g][which]
        offset = o[which]
        fits = (low[member] <= offset) & (high[member] > offset)  # also those that end too soon here: they count further left
        which, member, offset = which[fits], member[fits], offset[fits]
        best, who = suffixes.neighbours(member * FRAME + offset, member * FRAME + high[member], which)
        # Back to the contexts that asked.
        asked = np.searchsorted(wanted, number[live] * FRAME + right[live])
        spot = np.searchsorted(which * len(group) + member, asked * len(group) + live)
        x, at = live, right[live]
        n, y = best[spot], np.where(who[spot] >= 0, member[who[spot]], -1)
        hit = (n >= LENGTH) & (y >= 0)
        if hit.any():
            xs, ys, os = x[hit], y[hit], at[hit]
            back = suffixes.common_left(xs * FRAME + os, ys * FRAME + os, os - np.maximum(np.maximum(low[xs], low[ys]), a[xs]))
            out.append(np.stack([xs, os - back, os], 1))
            right[xs] = os - back - 1
        miss = x[~hit]
        right[miss] = np.minimum(at[~hit] - 1, at[~hit] + n[~hit] - LENGTH)
        live = live[right[live] >= a[live]]
    return out


def _keyed(rows: DataFrame) -> DataFrame:
    """(h1, h2, text) of texts that can hold a repeat."""
    return rows.where(F.octet_length("text") >= LENGTH).select(*_digest(), "text")


def _digest() -> list[Column]:
    """h1 and h2: the first 128 bits of the text's SHA-256 digest."""
    half = lambda at: F.conv(F.substring(F.sha2("text", 256), at, 16), 16, -10).cast("long")
    return [half(1).alias("h1"), half(17).alias("h2")]


def _first_seen(batch: pa.RecordBatch, seen: set[tuple[int, int]]) -> pa.RecordBatch:
    """The rows whose (h1, h2) this task hasn't met before: a group of copies is one row per task."""
    new = []
    for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        new.append(key not in seen)
        seen.add(key)
    return batch.filter(pa.array(new, pa.bool_()))


def _distinct_texts(texts: DataFrame) -> DataFrame:
    """The texts, each once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            yield _first_seen(batch, seen)

    return texts.mapInArrow(lean(run), "h1 bigint, h2 bigint, text string")


OCCURRENCE = "anchor bigint, c1 bigint, c2 bigint, kl bigint, kr bigint, h1 bigint, h2 bigint, pos bigint, reach int"


def _occurrences(texts: DataFrame, brief: bool) -> DataFrame:
    """Anchors of all texts: with `brief` (anchor, hp), else OCCURRENCE: c1 and c2, a digest of the context; its keys by the left and right side;
    its place, and its bytes before and from there. hp: a hash of text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in portions(batches, limit=1 << 19):
            batch = _first_seen(batch, seen)
            buf, offsets = utf8(batch.column(2))
            doc, place, before, after, anchor, begin, end, left, right = anchors(buf, offsets)
            h1, h2 = batch.column(0).to_numpy()[doc], batch.column(1).to_numpy()[doc]
            if brief:
                hp = mix(mix(h1.view(U64) ^ mix(h2.view(U64))) + place.astype(U64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(hp.view(np.int64), pa.int64())], names=["anchor", "hp"])
            else:
                raw = buf.tobytes()
                digest = b"".join([blake2b(raw[a:b], digest_size=16, salt=bytes((x,))).digest() for a, b, x in zip(begin.tolist(), end.tolist(), before.tolist(), strict=True)])
                c1, c2 = np.frombuffer(digest, np.int64).reshape(-1, 2).T
                columns = [pa.array(x, pa.int64()) for x in (anchor, c1, c2, left, right, h1, h2, place)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before * 256 + after, pa.int32())], names=["anchor", "c1", "c2", "kl", "kr", "h1", "h2", "pos", "reach"])

    return texts.mapInArrow(lean(run), "anchor bigint, hp bigint" if brief else OCCURRENCE)


MEMBER = "g bigint, multi boolean, a int, b int, h1 bigint, h2 bigint, pos bigint, reach int, frame binary"


def _members(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """The contexts `edges` (g, right, multi, h1, h2, pos, reach) with their bytes, each from one row of its text, and the windows that they ask for (a to b, none if a > b)."""
    wanted = edges.groupBy("h1", "h2").agg(F.collect_list(F.struct("g", "right", "multi", "pos", "reach")).alias("at"))  # as many as a text has anchors
    joined = _distinct_texts(texts).join(wanted, ["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in portions(batches, limit=1 << 19):
            batch = _first_seen(batch, seen)
            if not batch.num_rows:
                continue
            buf, offsets = utf8(batch.column(2))
            lists = batch.column(3)
            at = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            place, reach = at.field("pos").to_numpy(), at.field("reach").to_numpy().astype(np.int64)
            before, size = reach // 256, reach // 256 + reach % 256
            begin = offsets[row] + place - before
            ends = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=ends[1:])
            data = buf[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
            frames = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            right, multi = (at.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("right", "multi"))
            low = REACH - before
            first = np.where(right, np.maximum(low, SIDE), low)
            last = np.where(multi, -1, np.where(right, low + size - LENGTH, np.minimum(low + size - LENGTH, REACH - SIDE)))
            key = lambda k: batch.column(k).take(pa.array(row))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([at.field("g"), at.field("multi"), pa.array(first, pa.int32()), pa.array(last, pa.int32()), key(0), key(1), at.field("pos"), at.field("reach"), frames], names=["g", "multi", "a", "b", "h1", "h2", "pos", "reach", "frame"])

    return written(joined.select("h1", "h2", "text", "at").mapInArrow(lean(run), MEMBER), "members")


def _frames(reach: np.ndarray, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frames, low, high) of contexts given by their bytes."""
    low = REACH - reach.astype(np.int64) // 256
    buf, offsets = _binary(column)
    size = np.diff(offsets)
    frames = np.zeros((len(low), FRAME), np.uint8)
    frames.reshape(-1)[np.repeat(np.arange(len(low)) * FRAME + low - offsets[:-1], size) + np.arange(len(buf))] = buf
    return frames, low, low + size


SPANS = "h1 bigint, h2 bigint, a bigint, b bigint"


def _spans(h1: np.ndarray, h2: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Bytes of windows first to last of contexts."""
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h1, h2, pos - REACH + first, pos - REACH + last + LENGTH)], names=["h1", "h2", "a", "b"])


def _sizes(members: DataFrame) -> DataFrame:
    """(g, n) of groups of several, of which one at least asks."""
    return written(members.groupBy("g").agg(F.count("*").alias("n"), F.max((F.col("a") <= F.col("b")).cast("int")).alias("asks")).where("n > 1 and asks = 1").select("g", "n"), "sizes")


def _split(members: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans found, members of the next groups): every context of hot groups against the pivot of its group."""
    hot = hot_keys(sizes, ["g"])
    rank = F.struct("multi", F.expr("reach div 256 + reach % 256"), "h1", "h2", "pos")
    place = ["h1", "h2", "pos", "reach"]
    pivots = members.groupBy("g").agg(F.max(rank).alias("r")).select("g", *(F.col(f"r.{c}").alias("p_" + c) for c in place[:3]))
    chosen = dealt_join(members, pivots, ["g"], place[:3], hot)
    is_pivot = F.expr("h1 = p_h1 and h2 = p_h2 and pos = p_pos")
    pivots = chosen.where(is_pivot).groupBy("g").agg(F.min(F.struct(*place, "a", "b", "frame")).alias("p")).select("g", *(F.col(f"p.{c}").alias("p_" + c) for c in (*place, "a", "b", "frame")))
    both = written(dealt_join(members, pivots, ["g"], place[:3], hot).where(~is_pivot), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, GROUPED) for x in batches for at in range(0, x.num_rows, GROUPED)):
            rows = pa.Table.from_batches([batch])
            get = lambda c: rows[c].to_numpy()  # noqa: B023, E731
            mine, theirs = _frames(get("reach"), rows["frame"]), _frames(get("p_reach"), rows["p_frame"])
            a, b = get("a").astype(np.int64), get("b").astype(np.int64)
            first, last, (who, group, na, nb) = against_pivots(*mine, a, b, get("g"), *theirs)
            spans = []
            for p, x, y in (("", a, b), ("p_", get("p_a"), get("p_b"))):
                from_, to = np.maximum(first, x), np.minimum(last, y)
                good = from_ <= to
                spans.append(_spans(get(p + "h1")[good], get(p + "h2")[good], get(p + "pos")[good], from_[good], to[good]))
            found = pa.Table.from_batches(spans).group_by(["h1", "h2", "a", "b"]).aggregate([])
            yield _tagged(found, pa.table({}), 0)
            kept = rows.select(["multi", "h1", "h2", "pos", "reach", "frame"]).take(pa.array(who))
            yield _tagged(pa.table({"a": pa.array(na), "b": pa.array(nb)}), kept.append_column("g", pa.array(group, pa.int64())), 1)

    out = written(both.mapInArrow(lean(run), f"kind int, {MEMBER}"), "split")
    return out.where("kind = 0").select("h1", "h2", F.col("pos").alias("a"), (F.col("pos") + F.col("reach")).alias("b")), out.where("kind = 1").drop("kind")


def _tagged(numbers: pa.Table, rest: pa.Table, kind: int) -> pa.RecordBatch:
    """Spans (kind 0: pos is where it begins, reach its length) and members (kind 1) in one schema."""
    n = numbers.num_rows
    null = lambda t: pa.nulls(n, t)
    if kind == 0:
        columns = [null(pa.int64()), null(pa.bool_()), null(pa.int32()), null(pa.int32()), numbers["h1"], numbers["h2"], numbers["a"], pa.array(numbers["b"].to_numpy() - numbers["a"].to_numpy(), pa.int32()), null(pa.binary())]
    else:
        columns = [rest["g"], rest["multi"], numbers["a"].cast(pa.int32()), numbers["b"].cast(pa.int32()), rest["h1"], rest["h2"], rest["pos"], rest["reach"], rest["frame"]]
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    flat = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in flat]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *flat], names=["kind", "g", "multi", "a", "b", "h1", "h2", "pos", "reach", "frame"])


def _sorted_spans(members: DataFrame) -> DataFrame:
    """Repeated bytes that the suffix sort of each group finds."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        get = lambda c: rows[c].to_numpy()
        _, group = np.unique(get("g"), return_inverse=True)
        found = repeated_windows(*_frames(get("reach"), rows["frame"]), group, get("a").astype(np.int64), get("b").astype(np.int64))
        who = found[:, 0]
        return _spans(get("h1")[who], get("h2")[who], get("pos")[who], found[:, 1], found[:, 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in (b.slice(at, GROUPED) for b in batches for at in range(0, b.num_rows, GROUPED)):
            # Whole groups only: rows are sorted by group, so the last group may go on in the next batch.
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut and n + cut >= GROUPED or (cut == 0 and held and n >= GROUPED and held[-1].column(0)[-1].as_py() != keys[0]):
                yield spans(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, n = [batch.slice(cut)], batch.num_rows - cut
            else:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield spans(pa.Table.from_batches(held))

    return members.repartition("g").sortWithinPartitions("g").mapInArrow(lean(run), SPANS)


def _edge_spans(members: DataFrame) -> DataFrame:
    """(h1, h2, a, b): repeated bytes found in contexts that occur once."""
    out = []
    for left in range(ROUNDS, -1, -1):
        sizes = _sizes(members)
        hot = sizes.where(F.col("n") > SPLIT)
        if not left or hot.isEmpty():
            out.append(_sorted_spans(members.join(sizes.select("g"), "g", "left_semi").select(*members.columns)))
            break
        small = sizes.where(F.col("n") <= SPLIT).select("g")
        out.append(_sorted_spans(members.join(small, "g", "left_semi").select(*members.columns)))
        large = dealt_join(members, hot.select("g", F.lit(True).alias("large")), ["g"], ["h1", "h2", "pos"], hot_keys(sizes, ["g"])).select(*members.columns)
        found, members = _split(written(large, "large"), hot)
        out.append(found)
    return reduce(DataFrame.union, out)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.chunk(0)
    _, offs, data = whole.buffers()
    at = np.frombuffer(offs, np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def repeated(rows: DataFrame) -> DataFrame:
    """(h1, h2, spans): for each text of `rows` (column text) with repeated bytes, spans that cover them, in any order."""
    texts = _keyed(rows)
    again = written(_occurrences(texts, True).groupBy("anchor").agg(F.min("hp").alias("x"), F.max("hp").alias("y"), F.count("*").alias("n")).where("x <> y").select("anchor", "n"), "again")
    place = ["h1", "h2", "pos"]
    found = written(dealt_join(_occurrences(texts, False), again.select("anchor"), ["anchor"], place, hot_keys(again, ["anchor"])), "anchors")
    one = F.struct(*place, "reach", "kl", "kr")
    context = ["anchor", "c1", "c2"]
    contexts = found.groupBy(context).agg((F.min(one) != F.max(one)).alias("multi"), F.min(one).alias("p"), F.count("*").alias("n")).select(*context, "multi", "n", "p.*")
    contexts = written(contexts, "contexts")
    often = contexts.where("multi").select(*context, "n")
    whole = dealt_join(found, often.drop("n"), context, place, hot_keys(often, context)).select("h1", "h2", F.expr("pos - reach div 256").alias("a"), F.expr("pos + reach % 256").alias("b"))
    sides = contexts.select("multi", *place, "reach", F.explode(F.expr("array(struct(kl as g, false as right), struct(kr as g, true as right))")).alias("s")).select("multi", *place, "reach", "s.*").where("g <> 0")
    mixed = written(sides.groupBy("g").agg(F.count("*").alias("n"), F.min("multi").alias("all")).where("n > 1 and not all").select("g", "n"), "mixed")
    edges = _edge_spans(_members(texts, dealt_join(sides, mixed.select("g"), ["g"], place, hot_keys(mixed, ["g"]))))
    copies = rows.where(F.octet_length("text") >= LENGTH).groupBy(*_digest()).count().where("count > 1").select("h1", "h2", F.lit(0).cast("long").alias("a"), F.lit(1 << 60).alias("b"))
    spans = whole.union(edges).union(copies).distinct()
    return spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # as many as a text has anchors


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover, within 0..size."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, s["a"]), min(size, s["b"])) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows, all columns, with repeats (array of a, b): the removed runs of bytes of each text."""
    named = small_batches(rows).select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rows.columns)))
    at = f"c{rows.columns.index(text)}"
    base = named.withColumn("text", F.coalesce(F.col(at).cast("string"), F.lit("")))
    spans = written(repeated(base.select("text")), "repeats")
    keyed = base.select("*", *_digest()).drop("text")
    joined = keyed.join(spans, ["h1", "h2"], "left").drop("h1", "h2")
    return joined.toDF(*rows.columns, "repeats")


def cut(frame: DataFrame, text: str, outputs: str, make: object) -> DataFrame:
    """Rows of removed() without repeats, with further columns `outputs` from make(raw bytes, runs, kept bytes)."""
    fields = [f for f in frame.schema.fields if f.name != "repeats"]
    added = T.StructType.fromDDL(outputs)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(added)
    at, spans_at, width = [f.name for f in frame.schema.fields].index(text), len(frame.columns) - 1, len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value, spans in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                raw = (value or "").encode()
                runs = merged(spans, len(raw))
                edge = [0, *(x for r in runs for x in r), len(raw)]
                made.append(make(raw, runs, b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))))
            columns = [pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*made, strict=True))] if made else [pa.array([], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), *columns], names=[*batch.schema.names[:width], *kinds.names])

    return frame.mapInArrow(lean(run), T.StructType([*fields, *added.fields]))


def cleaned(rows: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows, all columns, with repeats cut out of the text, and its characters counted anew where there is a column for that."""
    frame = removed(rows, text)
    kept = cut(frame, text, "kept__ string, cut__ boolean", lambda raw, runs, kept: (kept.decode("utf-8", "ignore"), bool(runs)))
    out = []
    for field in rows.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.name == text:
            column = F.when(F.col("cut__"), F.col("kept__")).otherwise(column)
        elif field.name == n_chars:
            column = F.when(F.col("cut__"), F.length("kept__")).otherwise(column).cast(field.dataType)
        out.append(column.alias(field.name))
    return kept.select(out)
