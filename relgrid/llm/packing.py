"""Packing of tokenised documents into windows by minimum bin slack.

Each task tokenises its own rows and packs its own pieces, so nothing is shuffled and one text after another is in memory.
A document longer than a window gives whole windows and a rest. Rests and short documents wait in a buffer of `BUFFER`
pieces; a window takes the longest waiting piece and the multiset of other waiting lengths whose sum comes closest
to what is left: a subset-sum dynamic programme over a bitset (bit s: sum s can be reached), with copies of a length entered
in powers of two, and the counts found by walking the bitsets back. Where the closest sum leaves a slack, a waiting piece is cut to fill it.
What a task has left at its end, less than a window, goes to windows of the powers of two that make it up, which need no padding.

Defined results: a null or empty text is its end token alone. Rows with equal ids or texts are packed each by itself.
An empty table gives no pieces. Window ids are unique, not gapless: the task's number and a count.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgrid.llm.common import lean, small_batches
from relgrid.llm.vec import portions

WINDOW, END, BUFFER, CHECKED, AGAIN, LONG_WORD = 2048, 1, 1024, 50, 64, 2000


def _byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable bytes are themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in printable else next(rest)): b for b in range(256)}


class Tokens:
    """Ids of texts under a byte-level BPE file, as little-endian unsigned 32-bit bytes.

    What `tokenizers` gives for the file is the definition. The same file's vocabulary also makes a `tiktoken` encoder, which
    gives the same ids in a quarter of the time; the first texts of each process, and every 64th after them, are encoded by both, and if they ever
    differ, from there on, or for a text with what may be a special token or with a very long word, tokenizers does it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.fast, self.seen = self._fast(), 0

    def _fast(self) -> object | None:
        import public_tokenizers
        import tiktoken

        symbols = _byte_symbols()
        special = {t.content for t in self.encoder.get_added_tokens_decoder().values()}
        try:
            ranks = {bytes(symbols[c] for c in token): k for token, k in self.encoder.get_vocab().items() if token not in special}
            return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):  # not byte-level
            return None

    def _slow(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or "<|" in text or max(map(len, text.split(" "))) > LONG_WORD:
            return self._slow(text)
        out = np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        self.seen += 1
        if self.seen <= CHECKED or not self.seen % AGAIN:
            if out != (sure := self._slow(text)):
                self.fast = None
                return sure
        return out


_ready: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The tokeniser at the path, loaded once in a worker process."""
    if path not in _ready:
        _ready[path] = Tokens(path)
    return _ready[path]


def closest(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of a multiset of lengths (each at most counts[length] times) not over room, and the counts that make it."""
    full = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            grown = reach | ((reach << (length * take)) & full)
            if grown != reach:
                layers.append((reach, length, take))
                reach = grown
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = {}
    at = best
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return best, used


class Packer:
    """Takes pieces (key, start, length) and gives (key, start, length, window, offset)."""

    def __init__(self, first_window: int, window: int = WINDOW, buffer: int = BUFFER) -> None:
        self.window, self.buffer, self.next = window, buffer, first_window
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.counts: dict[int, int] = defaultdict(int)
        self.n = self.total = 0

    def _put(self, piece: tuple) -> None:
        self.waiting[piece[2]].append(piece)
        self.counts[piece[2]] += 1
        self.n += 1
        self.total += piece[2]

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.n -= 1
        self.total -= length
        return self.waiting[length].pop()

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, length in pieces:
            yield key, start, length, self.next, offset
            offset += length
        self.next += 1

    def _fill(self, size: int) -> Iterator[tuple]:
        """One window of exactly `size` from waiting pieces that hold as much at least."""
        chosen = []
        longest = max((x for x in self.counts if x <= size), default=0)
        if longest:
            chosen.append(self._take(longest))
        room = size - longest
        best, used = closest(self.counts, room)
        for length, times in used.items():
            chosen += [self._take(length) for _ in range(times)]
        if slack := room - best:
            key, start, length = self._take(min(x for x in self.counts if x > slack))
            chosen.append((key, start, slack))
            self._put((key, start + slack, length - slack))
        yield from self._emit(chosen)

    def add(self, key: object, length: int) -> Iterator[tuple]:
        start = 0
        while length - start >= self.window:
            yield from self._emit([(key, start, self.window)])
            start += self.window
        if length > start:
            self._put((key, start, length - start))
        while self.n >= self.buffer and self.total >= 2 * self.window:
            yield from self._fill(self.window)

    def finish(self) -> Iterator[tuple]:
        while self.total >= self.window:
            yield from self._fill(self.window)
        while self.total:
            yield from self._fill(1 << (self.total.bit_length() - 1))


OUT = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(rows: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids their ids (array<int>)."""
    kept = small_batches(rows).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([kept.schema["doc_id"], *T.StructType.fromDDL(OUT + (", ids array<int>" if with_ids else "")).fields])
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens(tokenizer), Packer(TaskContext.get().partitionId() << 33, window)
        live: dict[int, list] = {}  # ids of documents of which pieces wait: [bytes, id, tokens still to be placed]
        kind = None

        def finished(pieces: Iterator[tuple]) -> list[tuple]:
            out = []
            for key, start, length, sequence, offset in pieces:
                held = live[key]
                part = held[0][4 * start : 4 * (start + length)]
                out.append((held[1], start, length, zlib.crc32(part), len(held[0]) // 4, sequence, offset, *([np.frombuffer(part, "<u4").astype("i4")] if with_ids else [])))
                held[2] -= length
                if not held[2]:
                    del live[key]
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.list_(pa.int32())) for c in columns[7:])], names=schema.names)

        key, out = 0, []
        for batch in portions(batches):
            kind = batch.schema.field(0).type
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(value or "") + last
                live[key] = [ids, ident, len(ids) // 4]
                out += finished(packer.add(key, len(ids) // 4))
                key += 1
                if len(out) >= 4096:
                    yield batch_of(out)
                    out = []
        out += finished(packer.finish())
        if out:
            yield batch_of(out)

    return kept.mapInArrow(lean(run), schema)
