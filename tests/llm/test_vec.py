import numpy as np
import pyarrow as pa

from relgrid.llm import vec

TEXTS = ["", "one", "one two", "One two three four", None, "  lead  and\ttrail \n", "é è one two", "x" * 3000 + " y", "one two"]


def split(text, table):
    raw = (text or "").encode().translate(vec.LOWER.tobytes())
    return bytes(32 if table[b] else b for b in raw).split()


def test_words_and_shingles():
    for column in (pa.array(TEXTS), pa.array(["pad", *TEXTS])[1:], pa.chunked_array([pa.array(TEXTS[:4]), pa.array(TEXTS[4:])])):
        for table in (vec.SPACE, vec.NON_WORD):
            buf, offsets = vec.utf8(column)
            low = vec.LOWER[buf]
            start, end, first = vec.word_spans(low, offsets, table)
            found = [[low[a:b].tobytes() for a, b in zip(start[first[d] : first[d + 1]], end[first[d] : first[d + 1]], strict=True)] for d in range(len(TEXTS))]
            assert found == [split(t, table) for t in TEXTS]
            hashes = vec.word_hashes(low, start, end)
            flat = [w for words in found for w in words]
            assert len(set(hashes.tolist())) == len(set(flat))
            for k in (1, 3, 5):
                got, at = vec.shingle_hashes(hashes, first, k)
                want = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w) for w in found]
                assert np.diff(at).tolist() == [len(w) for w in want]
                names = [s for w in want for s in w]
                assert len(set(zip(names, got.tolist(), strict=True))) == len(set(names)) == len(set(got.tolist()))


def test_portions_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(TEXTS))), "text": TEXTS})
    cut = list(vec.portions(iter([batch]), limit=8))
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(len(TEXTS))) and len(cut) > 3
    assert list(vec.portions(iter([batch.slice(0, 0)]))) == []
