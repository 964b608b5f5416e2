import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from relgrid.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_closest_against_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.integers(1, 30, rng.integers(0, 9)).tolist()
        room = int(rng.integers(0, 80))
        counts = {x: lengths.count(x) for x in lengths}
        best, used = packing.closest(counts, room)
        sums = {sum(s) for k in range(len(lengths) + 1) for s in itertools.combinations(lengths, k)}
        assert best == max(s for s in sums if s <= room)
        assert sum(k * v for k, v in used.items()) == best and all(v <= counts[k] for k, v in used.items())


def test_tokens_are_those_of_the_tokenizer():
    encoder, tokens = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    assert tokens.fast is not None
    for text in ["a  b", " x\n\ny ", "tab\tq", "don't it's 123", "<|endoftext|> z", "héé  ", "", "日本語 text", "x" * 5000, "$$$ ### a.b,c"]:
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == encoder.encode(text, add_special_tokens=False).ids


def check(rows, texts):
    encoder = Tokenizer.from_file(PATH)
    ids = {i: [*encoder.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    fill, spots = defaultdict(int), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        spots[r.doc_id].append((r.start, r.length))
        fill[r.sequence_id] += r.length
    for i, t in ids.items():
        at = 0
        for start, length in sorted(spots[i]):
            assert start == at
            at += length
        assert at == len(t)
    for s in fill:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    padded = sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in fill.values())
    assert max(fill.values()) <= packing.WINDOW and padded <= 0.01 * sum(map(len, ids.values()))


def test_query(spark, sf_dir):
    rows = queries.op1_packing(spark, sf_dir).collect()
    check(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})


def test_odd_rows(odd, none):
    rows = packing.pack(odd, PATH, with_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2)) == 2
    assert [r.ids for r in rows if r.doc_id == 1] == [[1]]
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * packing.pack(odd.where("doc_id = 3"), PATH).first().doc_tokens
    assert packing.pack(none, PATH).count() == 0


def test_all_long_pieces_are_cut_to_fill():
    packer = packing.Packer(0)
    out = [x for k in range(2000) for x in packer.add(k, 1500)] + list(packer.finish())
    fill = defaultdict(int)
    for _, _, length, window, _ in out:
        fill[window] += length
    assert sum(fill.values()) == 2000 * 1500
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


@pytest.mark.parametrize("size", [1, 2047, 2048, 2049, 10_000])
def test_one_document(size):
    packer = packing.Packer(5)
    out = list(packer.add("d", size)) + list(packer.finish())
    assert sum(x[2] for x in out) == size and min(x[3] for x in out) == 5
