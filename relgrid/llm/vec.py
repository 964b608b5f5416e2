"""Vectorised text primitives over Arrow string buffers: words, hashes and shingles without a loop per word.

Words are hashed in blocks of eight bytes, each mixed into the state by a bijection, so that words of up to eight bytes never collide and
longer ones only by chance. Stretches of text are named by prefix polynomial hashes modulo 2^64 over a table of random byte values,
which can be cut anywhere; users of these verify what they find. All hashes depend on the bytes alone and agree on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Workers live on between tasks: buffers of the system's allocator go back to it when they are freed.
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2^64
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Masks of a block's first 0 to 8 bytes, and the longest words hashed block by block.
_BLOCK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_LONG = 64
_WORD_MIX = [U64(int(x) | 1) for x in _rng.integers(1, 2**63 - 1, 16, dtype=np.int64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
NON_WORD = np.zeros(256, bool)
NON_WORD[0:0x30] = NON_WORD[0x3A:0x61] = NON_WORD[0x7B:0x80] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i in 0..n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        inverse = pow(BASE, -1, 1 << 64)
        for k, base in enumerate((BASE, inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of value(buf[j]) * BASE^j for j < i."""
    power, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_VALUE[buf] * power[: len(buf)], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The position-free hash of each span buf[start:end] (not mixed)."""
    _, inverse = powers(len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each (one row at least), to bound memory."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, at = utf8(column)
        start = 0
        while start < len(column):
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): spans of all words in order, and for each document the index of its first word (n + 1 entries)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    blocks = np.ndarray(len(buf), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place on
    state = size.astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    some: np.ndarray | slice = slice(None)
    for at in range(0, min(_LONG, int(size.max())), 8):
        if at:
            some = np.flatnonzero((size > at) & (size <= _LONG))
        elif _LONG < size.max():
            some = np.flatnonzero(size <= _LONG)
        state[some] = mix(state[some] ^ blocks[start[some] + at] & _BLOCK[np.minimum(size[some] - at, 8)])
    for k in np.flatnonzero(size > _LONG).tolist():
        state[k] = xxhash.xxh3_64_intdigest(buf[start[k] : end[k]].tobytes())
    return mix(state + U64(0x9E3779B97F4A7C15))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, and n + 1 offsets; a document of 1 to k - 1 words has one of all its words."""
    counts = np.diff(first)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n_out, out=offsets[1:])
    if not offsets[-1]:
        return np.zeros(0, U64), offsets
    doc = np.repeat(np.arange(len(counts)), n_out)
    at = first[doc] + np.arange(offsets[-1]) - offsets[doc]
    length = np.minimum(counts[doc], k)
    total = np.zeros(len(at), U64)
    for j in range(k):
        has = length > j
        part = words[np.minimum(at + j, len(words) - 1)] * _WORD_MIX[j % 16]
        total += np.where(has, mix(part), U64(0))
    return mix(total + length.astype(U64)), offsets


def segments(sizes: np.ndarray) -> np.ndarray:
    """For group sizes, the group of each element."""
    return np.repeat(np.arange(len(sizes)), sizes)
