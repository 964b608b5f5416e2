"""A corpus pipeline: each stage works on the documents that the one before kept, as reread from Parquet.

Stages, in order: language ID (rejected documents go), n-gram Jaccard join (five words, 80 percent; the document with the smallest id of each
group stays), suffix-array deduplication (repeated strings are cut out of the texts), benchmark decontamination (documents
that hold or paraphrase an item go), packing (the rest as pieces of windows).

Defined results: null, empty and letterless texts are rejected by language ID. A document with a null id is in no group and stays.
Of rows that repeat an id, the Jaccard stage keeps one. An empty table passes through every stage as an empty table. Extra columns
are carried along as they are. A cut text has its n_chars (where there is such a column) counted anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relgrid.llm import decontam, jaccard, langid, packing, suffixdup
from relgrid.llm.common import scratch
from relgrid.llm.queries import documents, tokenizer_path
from relgrid.plans.lineage import temporary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs, k=5, percent=80)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixdup.cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array", suffix_array),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The rows depend on zstandard, on an approximate search and on BPE; tests/llm compares them with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and reread. A stage's own intermediate tables go when it is written."""
    docs = documents(spark, sf_dir)
    base = scratch(spark, "pipeline")
    for name, stage in STAGES:
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
