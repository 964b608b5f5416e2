import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from relgrid.llm import decontam, lmscore, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_lcs():
    rng = random.Random(0)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 30))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs(decontam._masks(a), len(a), b) == table[-1][-1]


def test_leaks_are_found(spark, sf_dir):
    """Recall of passages that stand in a document word for word, and no others but near ones."""
    flat = lambda t: " " + " ".join(words(t)) + " "
    docs = {r.doc_id: flat(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: flat(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t and len(x.split()) >= decontam.MIN_WORDS}
    rows = queries.op6_decontam(spark, sf_dir).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert exact and len(exact & found) >= 0.9 * len(exact)
    assert all(r.lcs >= decontam.LIKELY for r in rows) and len(found - exact) <= 0.1 * len(found) + 1


@pytest.fixture(scope="module")
def corpus(docs):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    item = text(40)
    paraphrase = item.split()
    for k in (5, 13, 21, 30):
        paraphrase[k] = "changed"
    made = [text(rng.randint(30, 200)) for _ in range(80)]
    made[10] = text(50) + " " + item + " " + text(50)
    made[20] = text(50) + " " + " ".join(paraphrase) + " " + text(30)
    return docs([(k, t, None) for k, t in enumerate(made)]), item, made


def test_paraphrases(spark, corpus):
    frame, item, _ = corpus
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, "never stands in any of these documents at all")], "item_id bigint, text string")
    rows = decontam.search(frame, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(10, 1), (20, 1)}
    kept = decontam.clean(frame, items)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(80)) - {10, 20}


def test_singular_values(corpus):
    """The one-pass values against those of the whole matrix."""
    frame, _, made = corpus
    space = decontam.fit(frame)
    hashes, first = decontam.words(decontam.pa.array(made))
    slot = decontam._slot(hashes)
    counts = np.bincount(slot, minlength=decontam.FEATURES)
    weight = np.log1p(counts.sum() / decontam.FITTED / (1.0 + counts))
    start, _ = decontam._blocks(first, decontam.FITTED)
    passage = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(slot))))
    used, column = np.unique(slot, return_inverse=True)
    a = np.zeros((len(start), len(used)))
    np.add.at(a, (passage, column), weight[slot])
    a /= np.sqrt(np.add.reduceat(weight[slot] ** 2, start))[:, None]
    true = np.linalg.svd(a, compute_uv=False)
    assert abs(space.singular[0] - true[0]) < 0.1 * true[0] and (space.singular <= true[: len(space.singular)] * 1.01).all()


def made_words(seed, sizes, distinct=30_000):
    """Texts of so many words each, some words frequent and most rare."""
    rng = np.random.default_rng(seed)
    made = np.minimum(rng.zipf(1.3, int(np.sum(sizes))), distinct)
    ends = np.cumsum(sizes)
    return [" ".join(f"w{k}" for k in made[end - n : end]) for n, end in zip(sizes, ends, strict=True)]


def products(spark, monkeypatch, texts):
    """The function that counts a task's part of A'(A Omega), as `fit` makes it, and what it gives for the texts."""
    batch = decontam.pa.RecordBatch.from_pydict({"text": decontam.pa.array(texts, decontam.pa.string())})
    fills = []

    def local(rows, fill, shape, **_):
        fills.append(fill)
        return fill(iter([batch])).reshape(shape)

    monkeypatch.setattr(decontam, "sum_tables", local)
    decontam.fit(spark.createDataFrame([("any",)], "text string"))
    return lambda: fills[1](iter([batch]))


def test_product_of_passages(spark, monkeypatch):
    """Against dense matrices: words that repeat often in a text and over texts, empty texts, and passages of every length."""
    texts = made_words(1, [*range(70), 5000, 0, 3]) + ["same " * 9000, "", None]
    out = products(spark, monkeypatch, texts)()
    hashes, first = decontam.words(decontam.pa.array(texts, decontam.pa.string()))
    slot = decontam._slot(hashes)
    weight = np.log1p(len(slot) / decontam.FITTED / (1.0 + np.bincount(slot, minlength=decontam.FEATURES)))
    start, _ = decontam._blocks(first, decontam.FITTED)
    passage = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(slot))))
    used, column = np.unique(slot, return_inverse=True)
    a = np.zeros((len(start), len(used)))
    np.add.at(a, (passage, column), weight[slot])
    a /= np.sqrt(np.add.reduceat(weight[slot] ** 2, start))[:, None]
    omega = np.random.default_rng(11).standard_normal((decontam.FEATURES, decontam.SKETCH)).astype(np.float32)
    true = a.T @ (a @ omega[used])
    assert np.abs(out[used] - true).max() < 1e-4 * np.abs(true).max() and not np.delete(out, used, 0).any()


def test_candidates_of_every_window(spark):
    """Against a loop over windows: texts of no words, of less than a window, and up to its end."""
    rng = random.Random(3)
    texts = made_words(2, [rng.choice([0, 1, 7, 8, 9, 15, 16, 17, 31, 40, 64, 65, 200]) for _ in range(120)], 300)
    long = [t for t in texts if len(t.split()) == 200]
    items = [" ".join(t.split()[8:][:n]) for t in long for n in (12, 30, 70)]
    index = decontam.Index(decontam.fit(spark.createDataFrame([(t,) for t in texts], "text string")), list(range(len(items))), items)
    hashes, first = decontam.words(decontam.pa.array(texts))
    true = {}
    for d in range(len(texts)):
        n = int(first[d + 1] - first[d])
        for scale, (owner, vectors) in index.parts.items():
            for at in range(0, n, decontam.STEP):
                if at == 0 or at + scale <= -(-n // decontam.STEP) * decontam.STEP:
                    own = hashes[first[d] + at : first[d] + min(n, at + scale)]
                    near = vectors @ decontam._unit(index.space.vectors[decontam._slot(own)].sum(0)[None])[0]
                    for k in np.flatnonzero(near >= decontam.COSINE - 1e-3):
                        true[d, int(owner[k]), at, scale] = max(float(near[k]), true.get((d, int(owner[k]), at, scale), 0))
    found = {}
    for *key, cosine in zip(*(c.tolist() for c in index.candidates(hashes, first)), strict=True):
        found[tuple(key)] = max(cosine, found.get(tuple(key), 0))
    assert len(found) > 100 and {k for k, c in true.items() if c >= decontam.COSINE + 1e-3} <= found.keys() <= true.keys()
    assert all(abs(found[k] - true[k]) < 1e-4 for k in found)


def test_costs(spark, monkeypatch):
    """CPU time of the fit's product and of the windows' cosines, as a multiple of that of hashing the same words (22 when sums were made by `reduceat` and from vectors in columns)."""
    texts = made_words(3, [200] * 3000)
    column = decontam.pa.array(texts)
    with monkeypatch.context() as patch:
        product = products(spark, patch, texts)
    index = decontam.Index(decontam.fit(spark.createDataFrame([(t,) for t in texts[:1000]], "text string")), list(range(200)), [" ".join(t.split()[:40]) for t in texts[:200]])
    hashes, first = decontam.words(column)

    def seconds(run):
        took = []
        for _ in range(3):
            before = time.thread_time()
            run()
            took.append(time.thread_time() - before)
        return min(took)

    ratio = (seconds(product) + seconds(lambda: index.candidates(hashes, first))) / seconds(lambda: decontam.words(column))
    print("times the cost of hashing", ratio)
    assert ratio < 14


def test_short_and_edited_items(spark, sf_dir):
    """Recall of items of every length from MIN_WORDS words on, as they are and with a fifth of the words replaced, in texts of the table."""
    rng = random.Random(9)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(words(r.text)) > 80]
    hashes, first = decontam.words(decontam.pa.array(texts))
    space = decontam.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    made = {}
    for n in (5, 6, 8, 10, 12, 15, 20, 30, 60):
        for edited in (False, True):
            for _ in range(40):
                seq = words(rng.choice(texts))
                at = rng.randrange(len(seq) - n + 1) if len(seq) > n else 0
                item = seq[at : at + n]
                leak = list(item)
                for k in rng.sample(range(len(item)), len(item) // 5 if edited else 0):
                    leak[k] = f"other{k}"
                host = words(rng.choice(texts))
                cut = rng.randrange(len(host))
                made[n, edited, len(made)] = " ".join(item), " ".join(host[:cut] + leak + host[cut:])
    index = decontam.Index(space, list(made), [item for item, _ in made.values()])
    hashes, first = decontam.words(decontam.pa.array([t for _, t in made.values()]))
    found = {(d, k) for d, k, *_ in index.matches(hashes, first)}
    hit = Counter((n, edited) for k, (n, edited, _) in enumerate(made) if (k, k) in found)
    print("recall", {key: x / 40 for key, x in sorted(hit.items())})
    assert all(hit[n, edited] >= 0.9 * 40 for n, edited, _ in made)


def test_against_all_pairs(spark, sf_dir):
    """Recall of edited items against the longest common subsequence with every stretch of every text."""
    rng = random.Random(12)
    rows = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(words(r.text)) > 30][:60]
    items = []
    for n in (6, 9, 14, 20, 40, 90) * 4:
        seq = words(rng.choice(rows))
        at = rng.randrange(max(1, len(seq) - n))
        seq = seq[at : at + n]
        for k in rng.sample(range(len(seq)), rng.randint(0, len(seq) // 4)):
            seq[k : k + rng.randint(0, 1)] = [f"other{k}"]
        items.append(" ".join(seq))
    column = decontam.pa.array(rows)
    index = decontam.Index(decontam.fit(spark.createDataFrame([(t,) for t in rows], "text string")), list(range(len(items))), items)
    hashes, first = decontam.words(column)
    found = {(d, k) for d, k, *_ in index.matches(hashes, first)}
    true = set()
    for k, item in enumerate(index.items):
        for d in range(len(rows)):
            seq = hashes[first[d] : first[d + 1]].tolist()
            for at in range(0, max(1, len(seq) - item.n), 3):
                region = seq[at : at + item.n + item.n // 8]
                share, answer = (decontam.lcs(m, n, region) / n for m, n in ((item.masks, item.n), (item.answer, item.answer_n)))
                if share >= decontam.SURE or share >= decontam.LIKELY and answer >= decontam.ANSWER:
                    true.add((d, k))
                    break
    print("recall", len(found & true) / len(true), len(true))
    assert len(true) > 20 and len(found & true) >= 0.95 * len(true)


def test_words_of_one_slot(spark):
    """An item of which many words share a slot is not taken to be absent, nor is the end of a long one."""
    pool = [f"w{k}" for k in range(60_000)]
    slot = decontam._slot(decontam.words(decontam.pa.array([" ".join(pool)]))[0])
    twins = [pool[k] for k in np.flatnonzero(np.bincount(slot, minlength=decontam.FEATURES)[slot] > 3)[:400]]
    twins.sort(key=lambda w: slot[pool.index(w)])
    long = [f"z{k}" for k in range(64 + 20)]
    rows = spark.createDataFrame([(1, "it says " + " ".join(twins[:16]) + " there"), (2, " ".join(long[64:]) + " only the end"), (3, "before " + " ".join(long) + " after")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(twins[:16])), (2, " ".join(long))], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.search(rows, items).collect()} == {(1, 1), (3, 2)}


@pytest.mark.parametrize("texts", [["the same seven words in every row"] * 2000, ["one row with a few words only"], ["", None, "!?"]])
def test_spaces_of_little(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS cosine")
    items = spark.createDataFrame([(1, "same seven words in every row"), (2, "row with a few words only"), (3, None)], "item_id bigint, text string")
    assert len(decontam.search(rows, items).collect()) == sum(t is not None and "words" in t for t in texts)


def test_space_of_many_copies(spark):
    """Over 10 000 rows, nearly all without words: the space comes from every row, so that the one leak is found."""
    item = "seven green ships sailed past nine old towers before dawn"
    rows = spark.range(12_000).selectExpr("id AS doc_id", f"CASE WHEN id = 77 THEN 'so it goes {item} and so on' ELSE '!' END AS text")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert decontam.fit(rows) is not None
    assert [(r.doc_id, r.item_id) for r in decontam.search(rows, items).collect()] == [(77, 1)]


def test_decontam_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "a a a a a a a a a a"), (2, "")], "item_id bigint, text string")
    assert {r.doc_id for r in decontam.search(odd, items).collect()} == {4}
    assert decontam.search(none, items).count() == 0 == decontam.search(odd, items.where("false")).count()
    assert decontam.clean(odd, items).count() == 6 and decontam.clean(none, items).count() == 0


def test_lm_scores(spark, docs):
    """Against dictionaries of the other documents' counts."""
    rng = random.Random(2)
    good, bad = "sun moon star sky".split(), "rust dust mud sun".split()
    texts = {k: " ".join(rng.choice(good if k % 2 else bad) for _ in range(rng.randint(1, 30))) for k in range(60)}
    texts |= {100: "", 101: None}
    target = {k for k in texts if k < 30 and k % 2}
    frame = docs([(k, t, None) for k, t in texts.items()]).repartition(3)
    ids = spark.createDataFrame([(k,) for k in target] + [(None,), (1,)], "doc_id bigint")
    rows = {r.doc_id: r for r in lmscore.score(frame, ids, keep=[frame.doc_id]).collect()}

    def model(chosen):
        single, pairs = Counter(), Counter()
        for k in chosen:
            seq = words(texts[k])
            single.update(seq)
            pairs.update(zip(seq, seq[1:], strict=False))
        total = sum(single.values()) + lmscore.UNSEEN * lmscore.VOCABULARY
        share = lambda w: (single[w] + lmscore.UNSEEN) / total

        def loss(seq):
            out = [-math.log2(share(seq[0]))]
            out += [-math.log2((pairs[a, b] + lmscore.PRIOR * share(b)) / (single[a] + lmscore.PRIOR)) for a, b in zip(seq, seq[1:], strict=False)]
            return sum(out) / len(seq)

        return loss

    for k, t in texts.items():
        r = rows[k]
        on_target, on_all = model(target - {k}), model(texts.keys() - {k})
        if not t:
            assert (r.n_words, r.target_loss, r.score) == (0, None, None)
            continue
        seq = words(t)
        assert r.n_words == len(seq) and math.isclose(r.target_loss, on_target(seq), rel_tol=1e-6) and math.isclose(r.score, on_target(seq) - on_all(seq), rel_tol=1e-6, abs_tol=1e-9)
    long = [k for k in range(60) if len(words(texts[k])) > 10]
    assert max(rows[k].score for k in long if k % 2) < min(rows[k].score for k in long if not k % 2)


def test_lm_scores_by_the_others(spark, docs):
    """A target document that no other is like scores as if it were in no target; one that occurs twice is known to the model."""
    rng = random.Random(8)
    text = lambda letter: " ".join(f"{letter}{rng.randrange(400)}" for _ in range(120))
    texts = {k: text("ab"[k % 2]) for k in range(200)} | {300: text("x"), 301: text("y")}
    texts[302] = texts[303] = text("z")
    frame = docs([(k, t, None) for k, t in texts.items()])
    ids = spark.createDataFrame([(k,) for k in range(0, 100, 2)] + [(300,)], "doc_id bigint")
    rows = {r.doc_id: r for r in lmscore.score(frame, ids, keep=[frame.doc_id]).collect()}
    assert abs(rows[300].score - rows[301].score) < 0.1 and rows[302].score == rows[303].score
    assert rows[302].background_loss < min(r.background_loss for k, r in rows.items() if k < 302) - 1
    outside = [rows[k].score for k in range(100, 200, 2)]  # like the target, not in it
    inside = [rows[k].score for k in range(0, 100, 2)]
    assert max(outside) < min(rows[k].score for k in range(1, 200, 2)) and abs(sum(outside) - sum(inside)) / 50 < 0.2


def test_lm_odd(spark, odd, none):
    ids = spark.createDataFrame([], "doc_id bigint")
    assert lmscore.score(odd, ids, keep=[odd.doc_id]).count() == 7 and lmscore.score(none, ids).count() == 0


def test_lm_many_words(spark, docs):
    """More words than smoothing allows for, and bigrams in chunks of several tasks: losses as by exact counts."""
    rng = random.Random(6)
    texts = {k: " ".join(f"w{rng.randrange(400_000)}" for _ in range(5000)) for k in range(160)}
    seqs = {k: t.split() for k, t in texts.items()}
    single, pairs = Counter(), Counter()
    for seq in seqs.values():
        single.update(seq)
        pairs.update(zip(seq, seq[1:], strict=False))
    assert len(single) > lmscore.VOCABULARY
    total = sum(single.values()) + lmscore.UNSEEN * len(single)
    frame = docs([(k, t, None) for k, t in texts.items()]).repartition(3)
    rows = lmscore.score(frame, spark.createDataFrame([], "doc_id bigint"), keep=[frame.doc_id]).collect()
    assert len(rows) == len(texts)
    for r in rows[:20]:
        seq = seqs[r.doc_id]
        own, pair = Counter(seq), Counter(zip(seq, seq[1:], strict=False))
        share = lambda w: (single[w] - own[w] + lmscore.UNSEEN) / (total - len(seq))  # noqa: B023, E731
        loss = -math.log2(share(seq[0])) - sum(math.log2((pairs[a, b] - pair[a, b] + lmscore.PRIOR * share(b)) / (single[a] - own[a] + lmscore.PRIOR)) for a, b in zip(seq, seq[1:], strict=False))
        assert r.n_words == len(seq) and math.isclose(r.background_loss, loss / len(seq), rel_tol=1e-6)
