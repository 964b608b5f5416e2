import re
import zlib

import numpy as np
import zstandard

from relgrid.llm import langid, quality, queries


def test_langid_held_out(spark, sf_dir):
    labels = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_langid(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(labels)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == labels[r.doc_id][0] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es"} for r in rows)
    assert np.mean([r.rejected for r in rows if len(labels[r.doc_id][1]) > 200]) < 0.02


def test_langid_odd(odd, none, docs):
    train = docs([(k, "the cat and the dog " * 5 + str(k), "en") for k in range(5)] + [(k, "le chat et le chien " * 5 + str(k), "fr") for k in range(5, 10)])
    model = langid.fit(train)
    assert sorted(model) == ["en", "fr"] and model == langid.fit(train.repartition(3))
    found = langid.classify(odd, model, keep=[odd.doc_id, odd.id]).collect()
    assert [r.lang_pred for r in found if r.doc_id in (1, 2)] == ["und", "und"] and len(found) == 7
    letterless = docs([(1, "123 !!! 456", None), (2, "the dog and the cat", None)])
    assert {r.doc_id: r.lang_pred for r in langid.classify(letterless, model, keep=[letterless.doc_id]).collect()} == {1: "und", 2: "en"}
    assert [r.doc_id for r in langid.accepted(letterless, model).collect()] == [2]
    assert langid.accepted(odd, model).columns == odd.columns
    assert langid.fit(none) == {} and langid.classify(none, model).count() == 0
    assert langid.classify(odd, {}).where("lang_pred <> 'und' or not rejected").count() == 0


def test_langid_long_texts(docs):
    """Languages whose labelled texts are all long have dictionaries, in which every sampled text has a part."""
    filler = {"en": "the cat and the dog are here ", "fr": "le chat et le chien sont ici "}
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{k:03d}") + "zq"
    train = docs([(k, f"{name(k)} {filler[lang]}" * 500, lang) for k in range(60) for lang in filler])
    model = langid.fit(train)
    assert sorted(model) == ["en", "fr"] and all(len(x) <= langid.DICTIONARY_BYTES for x in model.values())
    assert all(name(k).encode() in x for k in range(60) for x in model.values())
    found = docs([(1, "the dog and the cat are here", None), (2, "le chien et le chat sont ici", None)])
    assert {r.doc_id: r.lang_pred for r in langid.classify(found, model, keep=[found.doc_id]).collect()} == {1: "en", 2: "fr"}


def test_langid_against_a_plain_loop(spark, sf_dir):
    """Every text's language by compressing it with one dictionary after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    rows = docs.collect()
    known = {}
    for r in rows:
        if r.lang and r.text:
            known.setdefault(r.lang, set()).add(r.text)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    assert sorted(model) == sorted(known)
    for lang, texts in known.items():
        chosen = sorted(texts, key=hashes.get)[: langid.SAMPLE_ROWS]
        assert all(langid.plain(t[:40]).rsplit(b" ", 1)[0] in model[lang] for t in chosen if 40 < len(t) < 300)
    press = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=langid.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False) for k, d in model.items()}
    bare = zstandard.ZstdCompressor(level=langid.LEVEL, write_checksum=False, write_content_size=False)
    carriers = {k: [d[n * len(d) // langid.CARRIERS :][: langid.CARRIER_BYTES] for n in range(langid.CARRIERS)] for k, d in model.items()}
    found = {r.doc_id: r for r in langid.classify(docs, model, keep=[docs.doc_id]).collect()}
    finer = 0
    for r in rows:
        flat = " ".join(re.findall(r"[^\W\d_]+", (r.text or "").lower())).encode()
        sizes = {k: sum(len(p.compress(flat[a : a + langid.WINDOW])) for a in range(0, len(flat), langid.WINDOW)) for k, p in press.items()}
        got = found[r.doc_id]
        if not flat:
            assert (got.lang_pred, got.score, got.rejected) == ("und", 0, True)
            continue
        least, second = sorted(sizes.values())[:2]
        extra, slack = {k: v - least for k, v in sizes.items()}, langid.MARGIN * least
        rivals = [k for k, v in extra.items() if v < langid.RESOLUTION]
        if slack < langid.RESOLUTION and len(rivals) > 1:
            sums = {k: sum(len(bare.compress(c + b" " + flat)) - len(bare.compress(c)) for c in carriers[k]) for k in rivals}
            fewest, second = sorted(sums.values())[:2]
            extra |= {k: v - fewest for k, v in sums.items()}
            least, slack = fewest, langid.FINER * langid.MARGIN * max(fewest, 1)
            finer += 1
        assert got.lang_pred == min(k for k, v in extra.items() if v == 0) and got.rejected == (second - least < slack)
        assert abs(got.score - 1 / sum(2 ** (-v / 4) for v in extra.values())) < 1e-9
    assert finer


def test_langid_short_texts():
    """Texts without a match in any dictionary are told by their letters; a tie of those is rejected."""
    rng = np.random.default_rng(0)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    model = {k: " ".join(word(k, n) for n in rng.integers(3, 9, 9000)).encode() for k in ("abcdefghijklm", "nopqrstuvwxyz")}
    encoder = langid.Encoder(model)
    for k in model:
        for text in (word(k, n) for n in range(3, 12)):
            assert encoder.judge(f"{text}.", langid.MARGIN)[::2] == (k, False)
    same = langid.Encoder(dict.fromkeys(model, model["abcdefghijklm"]))
    assert same.judge("fade", langid.MARGIN) == ("abcdefghijklm", 0.5, True)
    assert langid.Encoder({"a": b"", "b": b"x"}).judge("fade", langid.MARGIN)[0] in ("a", "b")


def test_quality_against_a_plain_sum(spark, sf_dir):
    """Every text's score by looking up its bins one at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 AS score", "2 AS predicted", "3 AS y", "4 AS i")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    again = quality.train(docs.union(docs).union(docs), labels)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))
    found = {r.doc_id: r.score for r in quality.score(docs, model, keep=[docs.doc_id]).collect()}
    for r in docs.collect():
        x = quality.text_features(quality.pa.array([r.text]))[0]
        at = lambda edges, v: sum(e <= v for e in edges)
        total = model.bias + sum(t[at(e, v)] for t, e, v in zip(model.tables, model.edges, x, strict=True)) + sum(t[at(ea, x[a]), at(eb, x[b])] for a, b, ea, eb, t in model.pairs)
        assert abs(found[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_held_out(spark, sf_dir):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert held and np.mean([a == b for a, b in held]) > 0.85


def test_quality_model():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)  # only a pair of features tells
    model = quality.fit(x[:2000], y[:2000])
    assert (0, 3) in {(a, b) for a, b, *_ in model.pairs}
    assert np.mean((model.score(x[2000:]) >= 0.5) == y[2000:]) > 0.9
    assert (quality.fit(x, np.ones(len(x))).score(x) > 0.99).all()
    assert np.allclose(quality.fit(x[:0], y[:0]).score(x), 0.5)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model, keep=[odd.doc_id]).collect()
    assert len(rows) == 7 and {r.score for r in rows if r.doc_id == 1} == {r.score for r in rows if r.doc_id == 2}
    assert quality.score(none, quality.train(none, labels)).count() == 0
