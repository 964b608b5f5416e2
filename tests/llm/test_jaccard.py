import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from relgrid.llm import graph, jaccard, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(texts, k, percent):
    """{id: (size, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    lists = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in lists[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            lists[s].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_jaccard(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, 3, 90)


def near_copies(seed, n, words, edits):
    """A base, copies with edits, copies of copies, a passage in all, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(12)]
    made = [[word() for _ in range(words)] for _ in range(4)]
    for _ in range(n):
        text = list(rng.choice(made))
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = [word()]
        made.append(text)
    return {k: " ".join(t + passage * (rng.random() < 0.5)) for k, t in enumerate(made)}


@pytest.mark.parametrize(("k", "percent", "words", "edits"), [(3, 90, 60, 3), (5, 80, 80, 4), (3, 50, 20, 4), (2, 40, 30, 8)])
def test_near_copies(docs, k, percent, words, edits):
    texts = near_copies(k, 140, words, edits)
    rows = jaccard.join(docs([(i, t, None) for i, t in texts.items()]).repartition(5), k=k, percent=percent).collect()
    want = brute(texts, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({c for _, c in want.values()}) < len(texts)


@pytest.mark.parametrize("percent", [40, 59, 80])
def test_sizes_apart(docs, percent):
    """Parts of a text, each a bit longer than the one before, so that sizes differ by all that a link lets."""
    rng = random.Random(percent)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    texts = {k: " ".join(words[300 * g : 300 * g + n + 2]) for k, (g, n) in enumerate((g, n) for g in range(3) for n in (20, 21, 22, 36, 40, 55, 60, 100, 110, 111, 150, 200, 298))}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs([(i, t, None) for i, t in texts.items()]), percent=percent).collect()}
    assert found == brute(texts, 3, percent)


def test_long_words(docs):
    """Words that polynomial hashes modulo a power of two take for equal."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = {1: word, 2: other, 3: f"x {word} y z", 4: f"x {other} y z", 5: word, 6: word[:65], 7: other[:65]}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs([(i, t, None) for i, t in texts.items()])).collect()}
    assert found == brute(texts, 3, 90) and found[5][1] == 1 and found[2][1] == 2


def test_blocks_meet():
    """Whatever may link through a list is in a block that the member is joined with."""
    for t in (40, 60, 80, 90, 99):
        step = jaccard._size_step(t)
        size_class = lambda n: math.floor(math.log(n) / step)  # noqa: B023, E731
        width = lambda c: max(1, math.ceil(((math.exp((c + 1) * step) + 1) * (100 - t) / 100 + 1) / jaccard.POSITIONS))  # noqa: B023, E731
        for n in (1, 2, 3, 9, 10, 11, 50, 99, 100, 101, 977):
            for m in range(-(-n * t // 100), n * 100 // t + 1):
                most = (n + m) * (100 - t) // (100 + t)
                c = size_class(m)
                assert abs(c - size_class(n)) <= 1
                for pos in range(n - -(-n * t // 100) + 1):
                    furthest = min(most - pos, m - -(-m * t // 100))
                    if furthest >= 0:
                        largest = min(math.exp((c + 1) * step) + 1, n * 100 / t)
                        last = math.floor((math.floor((n + largest) * (100 - t) / (100 + t)) - pos) / width(c))
                        assert furthest // width(c) <= min(last, 2 * jaccard.POSITIONS)


def test_one_id_with_many_texts(docs):
    rows = docs([(1, "one text of some length", None), (0, "another text of some length", None), (1, "another text of some length", None), (2, "a third one", None)])
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(rows).collect()) == [(0, 0), (1, 0), (1, 0), (2, 2)]


def test_ball_links():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = set(range(100))
        sets = []
        for _ in range(int(rng.integers(2, 30))):
            k = int(rng.integers(0, 8))
            sets.append((base - set(rng.integers(0, 100, k).tolist())) | set((100 + rng.integers(0, 30, k)).tolist()))
        close = lambda a, b: 10 * len(a & b) >= 9 * len(a | b)
        diffs = [np.array(sorted(s ^ base), np.int64) for s in sets]
        linked = np.array([close(s, base) for s in sets])
        links = jaccard.ball_links(np.array([len(s) for s in sets]), np.concatenate(diffs), np.r_[0, np.cumsum([len(d) for d in diffs])], linked, np.ones(len(sets), bool), 90)
        assert all(close(sets[a], sets[b]) for a, b in links)
        star = [(i, len(sets)) for i in range(len(sets)) if linked[i]]
        every = [(i, j) for i in range(len(sets)) for j in range(i) if close(sets[i], sets[j])]
        assert parts(len(sets) + 1, star + links) == parts(len(sets) + 1, star + every)


def parts(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (200, 100)]
    found = {r.id: r.label for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102, 200), 100)}


def test_odd_rows(odd, none, docs):
    rows = jaccard.join(odd).collect()
    assert len(rows) == 7
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (1, 3) and by[4] == (1, 4) and by[None][1] is None
    assert jaccard.join(none).count() == 0
    kept = jaccard.representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5] and kept.where("doc_id is null").count() == 1
    copies = docs([(9, "same words in all of these", None), (8, "Same words  in all of these", None), (7, "other words stand in this one", None)])
    assert sorted(r.doc_id for r in jaccard.representatives(copies).collect()) == [7, 8]
