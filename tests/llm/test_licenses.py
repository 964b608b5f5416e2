import re

from relgrid.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for k in range(len(words)) for phrase, label in BASE.items() if tuple(words[k : k + len(phrase)]) == phrase]
    return len(words), found


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_licenses(spark, sf_dir).collect():
        n, found = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not found)


def distance_at_most(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1] <= most


def test_edits_are_found_and_bounded():
    scanner = licenses.Scanner()
    for words, label, most in licenses.NOTICES:
        text = "some words " + words + " more words"
        assert label in {m.label for m in scanner.notices(licenses.plain(text))}
        broken = words[:3] + "q" + words[4:] if most else words
        found = [m for m in scanner.notices(licenses.plain("some words " + broken + " more words")) if m.label == label]
        assert found and found[0].edits <= most
        for m in found:
            span = " ".join(("some words " + broken + " more words").split()[m.start : m.start + m.words])
            assert any(distance_at_most(w, span, k) for w, x, k in licenses.NOTICES if x == m.label)
    assert not scanner.notices(licenses.plain("a licence is not public here and general rights are served"))


def test_base_phrases_side_by_side():
    flat = licenses.plain("MIT license, mit-License cc by CC BY by")
    assert licenses.Scanner().base(flat) == [(0, "mit"), (2, "mit"), (4, "cc-by"), (6, "cc-by")]


def test_odd_rows(odd, none):
    rows = {r.doc_id: r for r in licenses.scan(odd, keep=[odd.doc_id]).collect()}
    assert rows[1].n_words == rows[2].n_words == 0 and rows[1].base == rows[1].notices == [] and rows[4].n_words == 20_000
    assert licenses.scan(none).count() == 0
