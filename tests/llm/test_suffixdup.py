import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from relgrid.llm import queries, suffixdup, suffixes, vec
from relgrid.llm.suffixes import Suffixes


def brute(texts, length=suffixdup.LENGTH):
    """{id: (bytes, removed, runs, sha256)} by counting all windows."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    windows = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if windows[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def digests(frame):
    rows = suffixdup.cut(suffixdup.removed(frame), "text", "n bigint, r bigint, s bigint, h string", queries._digest)
    return {r.doc_id: (r.n, r.r, r.s, r.h) for r in rows.collect()}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_suffixdup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(texts)


def test_made_texts(docs):
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage, base = make(350), make(900)
    texts = {0: base, 1: base, 2: base[:450] + "X" + base[450:], 3: base[:200] + "Y" + base[201:700], 4: make(300) + passage + make(100), 5: passage + make(210), 6: make(50) + passage, 7: "ab" * 400, 8: "z" * 199, 9: "z" * 199, 10: "q" * 201, 11: make(100) + base[300:499], 12: None, 13: "", 14: make(400)}
    for k in range(20, 60):
        at = rng.randrange(900)
        texts[k] = base[:at] + make(rng.randint(0, 3)) + base[at + rng.randint(0, 2) :]
    frame = docs([(i, t, None) for i, t in texts.items()]).repartition(4)
    assert digests(frame) == brute(texts)


def test_suffix_sort():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    suffixes = Suffixes(buf)
    start = rng.integers(0, 399, 150)
    end = np.minimum(400, start + rng.integers(1, 60, 150))
    group = np.sort(rng.integers(0, 6, 150))
    raw = buf.tobytes()
    texts = [raw[a:b] for a, b in zip(start, end, strict=True)]
    order = suffixes.sort(start, end, group)
    assert [(group[k], texts[k]) for k in order] == sorted((g, t) for g, t in zip(group, texts, strict=True))
    best, who = suffixes.neighbours(start, end, group)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for k in range(150):
        others = [j for j in range(150) if j != k and group[j] == group[k]]
        assert best[k] == max((common(texts[k], texts[j]) for j in others), default=0)
        assert not others or common(texts[k], texts[who[k]]) == best[k]


def contexts(rng):
    """(frames, low, high, group) of contexts in a few groups, different ones, edited here and there."""
    frame, length, reach, gram = suffixdup.FRAME, suffixdup.LENGTH, suffixdup.REACH, suffixdup.GRAM
    n, g = int(rng.integers(2, 30)), int(rng.integers(1, 4))
    group = np.sort(rng.integers(0, g, n))
    base = rng.integers(97, 100, (g, frame)).astype(np.uint8)
    frames = base[group].copy()
    for k in range(n):
        for _ in range(int(rng.integers(0, 3))):
            frames[k, rng.integers(0, frame)] = rng.integers(97, 100)
    frames[:, reach : reach + gram] = base[group][:, reach : reach + gram]
    low = rng.integers(0, 100, n) * (rng.random(n) < 0.5)
    high = np.maximum(low + length, frame - rng.integers(0, 100, n) * (rng.random(n) < 0.5))
    for k in range(n):
        frames[k, : low[k]] = frames[k, high[k] :] = 0
    keys = [(group[k], low[k], high[k], frames[k].tobytes()) for k in range(n)]
    keep = np.array([keys.index(x) == k for k, x in enumerate(keys)])
    return frames[keep], low[keep], high[keep], group[keep]


def shared(f, low, high, group, among):
    """(context, window) of those that another context holds."""
    length = suffixdup.LENGTH
    return {(k, o) for k in among for o in range(low[k], high[k] - length + 1) if any(j != k and group[j] == group[k] and low[j] <= o and o + length <= high[j] and (f[j, o : o + length] == f[k, o : o + length]).all() for j in among)}


@pytest.mark.parametrize("bits", [64, 10])
def test_windows_of_contexts(bits, monkeypatch):
    """With hashes of ten bits most are wrong, and what they say is put right."""
    if bits < 64:
        monkeypatch.setattr(suffixes, "span_hash", lambda *x: vec.mix(vec.span_hash(*x)) & vec.U64((1 << bits) - 1))
    rng = np.random.default_rng(bits)
    for _ in range(15):
        f, low, high, group = contexts(rng)
        ask = np.where(rng.random(len(f)) < 0.8, high - suffixdup.LENGTH, -1)
        found = {(int(k), o) for k, x, y in suffixdup.repeated_windows(f, low, high, group, low, ask) for o in range(x, y + 1)}
        assert found == {(k, o) for k, o in shared(f, low, high, group, range(len(f))) if ask[k] >= 0}


def test_splitting_by_pivots():
    rng = np.random.default_rng(5)
    for _ in range(15):
        f, low, high, group = contexts(rng)
        found = set()
        for g in set(group.tolist()):
            todo = [(np.flatnonzero(group == g), low[group == g], high[group == g] - suffixdup.LENGTH, 7)]
            while todo:
                who, a, b, number = todo.pop()
                if len(who) < 2:
                    continue
                p, rest = who[0], slice(1, None)
                x = who[rest]
                same = lambda v: np.repeat(v[p : p + 1], len(x), 0)  # noqa: B023, E731
                first, last, (i, code, na, nb) = suffixdup.against_pivots(f[x], low[x], high[x], a[rest], b[rest], np.full(len(x), number), same(f), same(low), same(high))
                for k, s, t in zip(range(len(x)), first, last, strict=True):
                    found |= {(int(x[k]), o) for o in range(max(s, a[rest][k]), min(t, b[rest][k]) + 1)} | {(int(p), o) for o in range(max(s, a[0]), min(t, b[0]) + 1)}
                todo += [(x[i[code == c]], na[code == c], nb[code == c], c) for c in set(code.tolist())]
        assert found == shared(f, low, high, group, range(len(f)))


def test_hot_groups(docs, monkeypatch):
    """A passage with different surroundings in more texts than one group's sort takes on."""
    monkeypatch.setattr(suffixdup, "SPLIT", 8)
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, edges = make(260), [make(40) for _ in range(3)]
    texts = {k: make(rng.randint(100, 250)) + rng.choice(edges)[rng.randint(0, 39) :] + passage + rng.choice(edges)[: rng.randint(0, 39)] + make(rng.randint(0, 250)) for k in range(90)}
    assert digests(docs([(i, t, None) for i, t in texts.items()]).repartition(3)) == brute(texts)


def test_odd_rows(odd, none):
    found = digests(odd)
    assert found[1][:3] == found[2][:3] == (0, 0, 0)
    assert found[4][:3] == (40_000, 40_000, 1)
    kept = suffixdup.cleaned(odd)
    assert kept.columns == odd.columns
    by = {r.doc_id: r for r in kept.collect()}
    assert by[1].text is None and by[4].text == "" and by[4].n_chars == 0 and by[3].text == "word" and by[None].text == "no id here"
    assert suffixdup.removed(none).count() == 0 == suffixdup.cleaned(none).count()
