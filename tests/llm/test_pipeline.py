from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from relgrid.llm import langid
from relgrid.plans.lineage import shared_dir
from tests.llm.test_jaccard import brute as components
from tests.llm.test_suffixdup import brute as repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        frames[name] = docs = spark.read.parquet(str(tmp_path / name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_array", "decontamination", "packing"]
    assert all(frames[n].columns == COLUMNS for n in list(frames)[:4])
    text = {n: {r.doc_id: r.text for r in f.collect()} for n, f in frames.items() if n != "packing"}

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoder = langid.Encoder(langid.fit(source))
    whole = {r.doc_id: r.text for r in source.collect()}
    assert set(text["language_id"]) == {i for i, t in whole.items() if not encoder.judge(t, langid.MARGIN)[2]}
    assert len(text["language_id"]) > 0.97 * len(whole)

    groups = components(text["language_id"], 5, 80)
    assert set(text["ngram_jaccard"]) == {i for i, (_, c) in groups.items() if c == i}

    want = repeats(text["ngram_jaccard"])
    assert set(want) == set(text["suffix_array"])
    for i, (size, gone, _, _) in want.items():
        assert abs(len(text["suffix_array"][i].encode()) - (size - gone)) <= 6 and (gone or text["suffix_array"][i] == text["ngram_jaccard"][i])

    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = text["decontamination"]
    assert set(left) <= set(text["suffix_array"]) and len(left) > 0.9 * len(text["suffix_array"])
    assert not any(x in " ".join(t.lower().split()) for t in left.values() for x in items if len(x.split()) >= 8)

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    packed = frames["packing"].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id: r[1] for r in packed} == tokens


def test_run(spark, sf_dir):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    rows = corpus_pipeline.run(spark, sf_dir)
    assert [p.name[:16] for p in set(folder.glob("*")) - before] == ["relgrid-pipeline"]  # no stage's intermediate tables
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0


def test_odd_tables(odd, none, spark, sf_dir, tmp_path):
    for label, frame in (("odd", odd), ("none", none)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert name == "packing" or out.columns == odd.columns
            out.write.parquet(str(tmp_path / label / name))
            frame = spark.read.schema(out.schema).parquet(str(tmp_path / label / name))
        assert label == "odd" or frame.count() == 0
