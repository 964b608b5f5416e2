"""Sorting of suffixes by hashes, over many small groups at once.

A suffix is a place in a buffer with an end. Prefix polynomial hashes tell in constant time whether two stretches are
equal, so a binary search finds the longest common extension of two suffixes, and a comparison costs a logarithm of
their length. What the search finds is then compared byte by byte: equal stretches have equal hashes, so a collision can only make an
extension too long, and the first byte that differs puts it right. The sort is a bottom-up mergesort in which every element finds its rank in the neighbouring run by binary search, for
all runs of all groups together.
"""

from __future__ import annotations

import numpy as np

from relgrid.llm.vec import U64, prefix_hash, span_hash


class Suffixes:
    """Suffixes buf[start:end], numbered as given."""

    def __init__(self, buf: np.ndarray, prefix: np.ndarray | None = None) -> None:
        self.buf = buf
        self.blocks = np.ndarray(len(buf), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place on
        self.prefix = prefix_hash(buf) if prefix is None else prefix

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of places a and b, at most `most`."""
        low, high = np.zeros(len(a), np.int64), np.maximum(most, 0)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = span_hash(self.prefix, a, a + mid) == span_hash(self.prefix, b, b + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        for k in self.unequal(a, b, low).tolist():
            low[k] = np.argmax(self.buf[a[k] : a[k] + low[k]] != self.buf[b[k] : b[k] + low[k]])
        return low

    def common_left(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the left of places a and b, at most `most`."""
        low, high = np.zeros(len(a), np.int64), np.maximum(most, 0)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = span_hash(self.prefix, a - mid, a) == span_hash(self.prefix, b - mid, b)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        for k in self.unequal(a - low, b - low, low).tolist():
            low[k] = np.argmax(self.buf[a[k] - low[k] : a[k]][::-1] != self.buf[b[k] - low[k] : b[k]][::-1])
        return low

    def unequal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which of the stretches of n bytes from places a and b are not equal, though their hashes are."""
        found = []
        for at in range(0, len(n), 20_000):
            size = n[at : at + 20_000]
            steps = -(-size // 8)
            which = np.repeat(np.arange(len(size)), steps)
            step = 8 * (np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps, steps))
            differ = self.blocks[a[at : at + 20_000][which] + step] ^ self.blocks[b[at : at + 20_000][which] + step]
            found.append(at + np.unique(which[differ << (U64(8) * (8 - np.minimum(size[which] - step, 8)).astype(U64)) != 0]))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def before(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, ties: bool | np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; `ties`: the answer for equal ones."""
        room = np.minimum(a_end - a, b_end - b)
        n = self.common(a, b, room)
        whole = n >= room
        x, y = self.buf[np.minimum(a + n, len(self.buf) - 1)], self.buf[np.minimum(b + n, len(self.buf) - 1)]
        longer = (a_end - a).astype(np.int64) - (b_end - b)
        return np.where(whole, np.where(longer == 0, ties, longer < 0), x < y)

    def sort(self, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
        """An order of the suffixes by group (given in ascending runs) and then by content."""
        n = len(start)
        order = np.arange(n)
        if not n:
            return order
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.append(first, n))
        base, length = np.repeat(first, size), np.repeat(size, size)
        within = np.arange(n) - base
        width, widest = 1, int(size.max())
        while width < widest:
            run = within // width
            other = (run ^ 1) * width  # where the neighbouring run begins, in the group
            other_size = np.clip(length - other, 0, width)
            low, high = np.zeros(n, np.int64), other_size.copy()
            left = (run & 1) == 0
            mine_s, mine_e = start[order], end[order]
            while (busy := np.flatnonzero(low < high)).size:
                mid = (low[busy] + high[busy]) >> 1
                theirs = order[base[busy] + other[busy] + mid]
                # Equal ones of the left run come first.
                lesser = self.before(start[theirs], end[theirs], mine_s[busy], mine_e[busy], ~left[busy])
                low[busy] = np.where(lesser, mid + 1, low[busy])
                high[busy] = np.where(lesser, high[busy], mid)
            target = base + (run & ~1) * width + (within - run * width) + low
            new = np.empty(n, np.int64)
            new[target] = order
            order = new
            width *= 2
        return order

    def neighbours(self, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix the longest extension that it shares with another of its group, and the number of one that shares it (-1: none)."""
        order = self.sort(start, end, group)
        best, who = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        if len(start) < 2:
            return best, who
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        a, b = a[same], b[same]
        shared = self.common(start[a], start[b], np.minimum(end[a] - start[a], end[b] - start[b]))
        for x, y in ((a, b), (b, a)):
            more = (shared > best[x]) | (who[x] < 0)
            best[x[more]], who[x[more]] = shared[more], y[more]
        return best, who
