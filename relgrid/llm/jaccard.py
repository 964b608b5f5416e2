"""Exact Jaccard self-join of documents by their word n-grams, with set-relation skipping.

Sets are ordered by one order of all n-grams, rare ones first (counts over all documents, kept in a table whose width follows the corpus;
any total order gives right results, a good one gives short lists). With similarity >= t, two sets of which one has n members share
one of the first n - ceil(t n) + 1 members of each. The index holds those, with size and position.

Block skipping: each list is cut into blocks by size (in steps of a ratio of 1 / t) and position (in eighths of a set's indexed
part). If a list's member is the first that two sets share, all members before it differ, so the positions add up to at most the
difference that t allows, and what follows must hold the whole overlap. A member is joined only with those blocks whose
bounds allow that; the other blocks of the list are skipped unread, and within the blocks joined the same bounds are tested exactly.

Before texts are fetched, pairs whose parity maps differ in more bits than t allows members to differ are dropped.

Answers from a similar set: each list has a leader. A list's members are compared with its leader, which yields their exact
differences. For two sets that are both similar to one leader, the difference follows from their differences with it, without either
set: D(y, z) = D(y, L) xor D(z, L). So inside a leader's ball only those that the leader itself doesn't link are
looked at again, by index lists over the differences, and only links that join two parts are written. Pairs are formed only for members that are unlike their leader.

Sets that are equal are one class from the start, represented by the smallest id. Hashes are of 64 bits (of a set: 128), of whole words
block by block, so that no two words are confused by their structure.

Defined results: null, empty and blank texts have no n-grams and are linked with nothing, each its own component. With fewer than k
words the whole sequence is the one n-gram. A null id gets a null component and links nothing. Rows that share an id
are one node, with the links of them all. Extra columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgrid.llm import graph
from relgrid.llm.common import dealt_join, hot_keys, lean, small_batches, written
from relgrid.llm.tables import sum_tables
from relgrid.llm.vec import LOWER, SPACE, U64, mix, portions, shingle_hashes, utf8, word_hashes, word_spans

#: Slots of the count table, a byte each when broadcast: about one for every SLOT_BYTES bytes of text, between these powers of two.
#: Beyond the last (64 MB), n-grams rarer than a 2^26th of all are ordered by hash; results stay the same.
COUNT_BITS, SLOT_BYTES = (18, 26), 64
#: Position blocks of a list for each size.
POSITIONS = 8
#: Bits of a set's parity map. Each member flips one bit, so two maps differ in no more bits than the sets do in members.
MAP_BITS = 1024
#: Beyond so many differing bits, large sets are taken to be outside a ball (links don't depend on that).
MAP_FULL = 430
#: A leader's ball holds the sets at least this similar to it (percent; less where less makes a link); members of a ball that one task takes on from each side, or the root of the ball's size.
BALL, BLOCK = 60, 128
#: Up to so many ids are broadcast (8 bytes each) to fetch texts; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram hashes of a string column with repeats, and offsets."""
    buf, offsets = utf8(column)
    buf = LOWER[buf]
    start, end, first = word_spans(buf, offsets, SPACE)
    return shingle_hashes(word_hashes(buf, start, end), first, k)


def _sets(docs: DataFrame, order: np.ndarray, k: int, t: int) -> DataFrame:
    """(id, n, s1, s2, prefix, map): size, 128-bit signature, the first members in the order, and the parity map."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # 2^26 bytes at most
    mask = U64(len(order) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in portions(batches, limit=1 << 19):
            hashes, offsets = shingles(batch.column(1), k)
            n, s1, s2, prefix, maps = [], [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = np.unique(hashes[a:b])
                m = len(own)
                n.append(m)
                flips = np.bincount((own >> U64(50)).astype(np.int64) & (MAP_BITS - 1), minlength=MAP_BITS) & 1
                maps.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
                s1.append(int(mix(own + U64(1)).sum(dtype=U64).astype(np.int64)) if m else 0)
                s2.append(int(mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64).astype(np.int64)) if m else 0)
                if m:
                    take = m - -(-(m * t) // 100) + 1
                    heat = rank[(own & mask).astype(np.int64)]
                    prefix.append(own[np.argsort(heat, kind="stable")[:take]].view(np.int64))
                else:
                    prefix.append(np.zeros(0, np.int64))
            flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), flat, pa.array(maps, pa.list_(pa.int64()))], names=["id", "n", "s1", "s2", "prefix", "map"])

    return docs.mapInArrow(lean(run), f"id {docs.schema['id'].dataType.simpleString()}, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, map array<bigint>")


def _order(docs: DataFrame, k: int) -> np.ndarray:
    """For each slot of n-gram hashes, the logarithm of their count over all documents."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = 1 << min(max((total // SLOT_BYTES).bit_length(), COUNT_BITS[0]), COUNT_BITS[1])

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(slots, np.int32)
        for batch in portions(batches, limit=1 << 19):
            hashes, _ = shingles(batch.column(0), k)
            np.add.at(out, (hashes & U64(slots - 1)).astype(np.int64), 1)
        return out

    return np.log2(sum_tables(docs.select("text"), fill, (slots,)) + np.float32(1), dtype=np.float32).astype(np.uint8)


def _compare(docs: DataFrame, pairs: DataFrame, k: int, t: int, ball: int) -> DataFrame:
    """For pairs (a, b) of ids, written: na, nb, d (size of the difference), linked, and diff (its members) if b is in a's ball."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = written(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    joined = pairs
    for end in ("b", "a"):
        hot = hot_keys(pairs.groupBy(end).agg(F.count("*").alias("n")), [end])
        joined = dealt_join(joined, texts.select(F.col("id").alias(end), F.col("text").alias("t" + end)), [end], ["a", "b"], hot)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in portions(batches, "tb"):
            left, rows, diffs = batch.column(0).to_pylist(), [], []
            hashes, offsets = shingles(batch.column(3), k)
            for r, ident in enumerate(left):
                if last[0] != ident:
                    last = (ident, np.unique(shingles(batch.column(2).slice(r, 1), k)[0]))
                mine, theirs = last[1], np.unique(hashes[offsets[r] : offsets[r + 1]])
                diff = np.setxor1d(mine, theirs, assume_unique=True)
                both = len(mine) + len(theirs)
                linked = 100 * (both - len(diff)) >= t * (both + len(diff))
                rows.append((len(mine), len(theirs), len(diff), linked))
                diffs.append(diff.view(np.int64) if 100 * (both - len(diff)) >= ball * (both + len(diff)) else None)
            columns = [batch.column(0), batch.column(1), *(pa.array(c, kd) for c, kd in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)), pa.array(diffs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "na", "nb", "d", "linked", "diff"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(lean(run), f"a {kind}, b {kind}, na bigint, nb bigint, d bigint, linked boolean, diff array<bigint>")


def _map_distance(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), written, with na, nb and bits: in how many bits their parity maps differ."""
    joined = pairs
    for x in ("a", "b"):
        hot = hot_keys(pairs.groupBy(x).agg(F.count("*").alias("n")), [x])
        side = sets.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("map").alias("m" + x))
        joined = dealt_join(joined, side, [x], ["a", "b"], hot)
    bits = F.expr("aggregate(zip_with(ma, mb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return joined.withColumn("bits", bits).drop("ma", "mb")


class _Parts:
    """Union-find over small integers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def ball_links(n: np.ndarray, members: np.ndarray, offsets: np.ndarray, linked: np.ndarray, left: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Links within a ball between a member of `left` that the leader doesn't link, and any other: enough to join all parts.

    n, linked: sizes, and whether the leader links, of all members; members, offsets: their differences with the leader, one
    after another. The overlap of differences is counted by index lists over what differs; sizes that can't fit are skipped first.
    """
    size = np.diff(offsets)
    by = np.argsort(members, kind="stable")
    keys, owner = members[by], np.repeat(np.arange(len(n)), size)[by]
    parts, out = _Parts(len(n)), []
    inner = np.flatnonzero(linked)
    for x in inner[1:].tolist():
        parts.join(int(inner[0]), x)
    for y in np.flatnonzero(left & ~linked).tolist():
        own = members[offsets[y] : offsets[y + 1]]
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        lists = np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]) if len(own) else owner[:0]
        d = size[y] + size - 2 * np.bincount(lists, minlength=len(n))
        both = n[y] + n
        for z in np.flatnonzero(100 * (both - d) >= t * (both + d)).tolist():
            if z != y and parts.join(y, z):
                out.append((y, z))
    return out


def _within_balls(compared: DataFrame, t: int) -> DataFrame:
    """Links (a, b) between members of one ball of which the leader doesn't link both."""
    kind = compared.schema["a"].dataType.simpleString()
    members = compared.where("diff is not null").select(F.col("a").alias("leader"), F.col("b").alias("id"), F.col("nb").alias("n"), "linked", "diff")
    sizes = written(members.groupBy("leader").agg(F.count("*").alias("m"), F.sum((~F.col("linked")).cast("long")).alias("outer")), "sizes")
    hot = hot_keys(sizes.withColumnRenamed("m", "n"), ["leader"])
    held = dealt_join(members, sizes.where("outer > 0 and m > 1"), ["leader"], ["id"], hot)
    blocks = lambda c: F.ceil(F.col(c) / F.greatest(F.lit(BLOCK), F.sqrt("m"))).cast("int")
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # Groups (leader, i, j): the outer members of block i as the left side, all members of block j as the right side.
    left = held.where(~F.col("linked")).withColumn("i", at(blocks("outer"))).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("m") - 1))).withColumn("left", F.lit(True))
    right = held.withColumn("j", at(blocks("m"))).withColumn("i", F.explode(F.sequence(F.lit(0), blocks("outer") - 1))).withColumn("left", F.lit(False))

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["id", "n", "linked", "diff", "left"])
        seen: dict = {}
        for k, (ident, left) in enumerate(zip(rows["id"].to_pylist(), rows["left"].to_pylist(), strict=True)):
            seen[ident] = (k, left or seen.get(ident, (0, False))[1])
        rows = rows.take(pa.array([k for k, _ in seen.values()])).combine_chunks()
        diffs = rows["diff"].combine_chunks() if isinstance(rows["diff"], pa.ChunkedArray) else rows["diff"]
        diffs = diffs.chunk(0) if isinstance(diffs, pa.ChunkedArray) else diffs
        offsets = diffs.offsets.to_numpy().astype(np.int64)
        links = ball_links(rows["n"].to_numpy(), diffs.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0], rows["linked"].to_numpy(), np.array([x for _, x in seen.values()]), t)
        ids = rows["id"].combine_chunks()
        pick = lambda side: ids.take(pa.array([x[side] for x in links], pa.int64()))
        return pa.table({"a": pick(0), "b": pick(1)})

    columns = ["leader", "i", "j", "id", "n", "linked", "diff", "left"]
    # Dealt by all three, or what the join has dealt by leader would do and hold a ball's groups in one task.
    return left.select(columns).union(right.select(columns)).repartition("leader", "i", "j").groupBy("leader", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def _size_step(t: int) -> float:
    """Sets that link are at most one step apart: the logarithm of 100 / t, and a little for rounding."""
    return math.log(100 / t) + 0.01


def _size_class(n: Column | str, t: int) -> Column:
    return F.floor(F.log(F.col(n) if isinstance(n, str) else n) / _size_step(t)).cast("int")


def _block_width(size_class: Column, t: int) -> Column:
    """Positions in a block of the size class: an eighth of what its largest sets index."""
    largest = F.exp((size_class + 1) * _size_step(t)) + 1
    return F.greatest(F.ceil((largest * (100 - t) / 100 + 1) / POSITIONS), F.lit(1)).cast("int")


def _blocks_met(t: int) -> Column:
    """For a member (n, pos): all (c, i), size class and position block, that hold members which may link with it through this list."""
    c = F.col("c")
    largest = F.least(F.exp((c + 1) * _size_step(t)) + 1, F.col("n") * 100 / t)
    differ = F.floor((F.col("n") + largest) * (100 - t) / (100 + t))
    last = F.floor((differ - F.col("pos")) / _block_width(c, t)).cast("int")
    return F.when(last >= 0, F.sequence(F.lit(0), F.least(last, F.lit(2 * POSITIONS))))


def _far_pairs(far: DataFrame, t: int) -> DataFrame:
    """(a, b) of list members, one of them outside the ball of the list's leader, that may link: blocks by size and position
    decide what is joined, and then position, size, and distance from the leader of each pair."""
    far = written(far.withColumn("c", _size_class("n", t)).withColumn("i", F.floor(F.col("pos") / _block_width(F.col("c"), t)).cast("int")), "far")
    key = ["token", "c", "i"]
    side = lambda f, p: f.select(*key, *(F.col(x).alias(p + x) for x in ("id", "n", "pos", "near", "d", "known")))
    asking = far.where("not near").withColumn("c", F.explode(F.expr("array(c - 1, c, c + 1)"))).withColumn("i", F.explode(_blocks_met(t)))
    hot = hot_keys(far.groupBy(key).agg(F.count("*").alias("n")), key)
    both = F.expr("un + vn")
    most = F.floor(both * (100 - t) / (100 + t))  # members that may differ
    need = F.ceil(both * t / (100 + t))
    fits = (
        (F.col("uid") != F.col("vid"))
        & (F.col("vnear") | (F.col("uid") < F.col("vid")))
        & (100 * F.least("un", "vn") >= t * F.greatest("un", "vn"))
        & (F.expr("upos + vpos") <= most)
        & (F.expr("least(un - upos, vn - vpos)") >= need)
        & (~F.col("vknown") | (F.expr("ud - vd") <= most))
        & (~F.col("uknown") | (F.expr("vd - ud") <= most))
    )
    met = dealt_join(side(far, "v"), side(asking, "u"), key, ["vid"], hot).where(fits)
    return met.select(F.least("uid", "vid").alias("a"), F.greatest("uid", "vid").alias("b")).distinct()


def join(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; two documents link at a Jaccard similarity of `percent` (1 to 100) or more."""
    t, ball = percent, min(BALL, percent)
    docs = small_batches(rows).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    sets = written(_sets(docs, _order(docs, k), k, t), "sets")
    usable = sets.where("n > 0 and id is not null")
    classes = written(usable.groupBy("s1", "s2").agg(F.min(F.struct("id", "n", "prefix", "map")).alias("f"), F.count("*").alias("copies")).select("s1", "s2", "f.*", "copies"), "classes")
    listed = classes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    leaders = listed.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct("id", "n")).alias("l")).where("m > 1").select("token", "m", F.col("l.id").alias("leader"), F.col("l.n").alias("ln"))
    leaders = written(leaders, "leaders")
    hot = hot_keys(leaders.select("token", F.col("m").alias("n")), ["token"])
    lists = written(dealt_join(listed, leaders.drop("m"), ["token"], ["id"], hot), "lists")

    # Members that a leader may link, and those that may be in its ball.
    reps = classes.select("id", "n", "map")
    pairs = lists.where("id <> leader and 100 * least(n, ln) >= %d * greatest(n, ln)" % ball).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    total, smaller, larger = F.expr("na + nb"), F.least("na", "nb"), F.greatest("na", "nb")
    may_link = (100 * smaller >= t * larger) & (F.col("bits") <= F.floor(total * (100 - t) / (100 + t)))
    may_be_near = F.col("bits") <= F.least(F.floor(total * (100 - ball) / (100 + ball)), F.lit(MAP_FULL))
    pairs = written(_map_distance(written(pairs, "pairs"), reps).where(may_link | may_be_near).select("a", "b"), "pairs")
    compared = written(_compare(docs, pairs, k, t, ball), "compared")
    links = compared.where("linked").select("a", "b").union(_within_balls(compared, t))

    near = compared.select(F.col("a").alias("leader"), F.col("b").alias("id"), "d", (F.col("diff").isNotNull()).alias("near"))
    far = lists.where("id <> leader").join(near, ["leader", "id"], "left")
    far = far.select("token", "id", "n", "pos", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("d", F.abs(F.col("n") - F.col("ln"))).alias("d"), F.col("d").isNotNull().alias("known"))
    rest = written(_map_distance(written(_far_pairs(far, t), "pairs"), reps).where(may_link).select("a", "b"), "pairs")
    if not rest.isEmpty():
        links = links.union(_compare(docs, rest, k, t, ball).where("linked").select("a", "b"))
    # An id whose rows hold different sets joins their classes.
    of_many = usable.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x <> y").select("id")
    held = usable.join(of_many, "id", "left_semi").select(F.col("id").alias("b"), "s1", "s2").join(classes.select(F.col("id").alias("a"), "s1", "s2"), ["s1", "s2"])
    labels = graph.components(links.union(held.select("a", "b")))

    named = written(classes.join(labels, "id", "left").select("s1", "s2", F.coalesce("label", "id").alias("component_id"), "copies"), "named")
    hot = hot_keys(named.select("s1", "s2", F.col("copies").alias("n")), ["s1", "s2"])
    light = sets.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "s1", "s2")
    linked = dealt_join(light.where("n_shingles > 0 and doc_id is not null"), named.drop("copies"), ["s1", "s2"], ["doc_id"], hot).select("doc_id", "n_shingles", "component_id")
    alone = light.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"))
    return linked.union(alone)


def representatives(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns, of the document with the smallest id of each group (rows with a null id stay; of a repeated id, one row)."""
    found = join(rows, doc_id, text, k, percent)
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias(doc_id)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if few else gone, doc_id, "left_anti").select(rows.columns)
    if rows.groupBy(doc_id).count().where(F.col(doc_id).isNotNull() & (F.col("count") > 1)).isEmpty():
        return kept
    return kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).union(kept.where(F.col(doc_id).isNull()))
