"""The queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgrid.llm import chat, decontam, jaccard, langid, licenses, lmscore, media, packing, quality, suffixdup
from relgrid.llm.common import documents

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir), keep=[F.col("doc_id")])
    base, notices = F.col("base"), F.col("notices")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"),
        joined(F.concat(base["label"], notices["label"])).alias("labels"),
        F.greatest(F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(notices["similarity"]), F.lit(0.0))).alias("score"),
        F.size(notices).cast("long").alias("n_notices"),
        F.to_json(notices).alias("spans"),
    )


def _digest(raw: bytes, runs: list, kept: bytes) -> tuple:
    return len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()


def op3_suffixdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = suffixdup.removed(documents(spark, sf_dir).select("doc_id", "text"))
    return suffixdup.cut(frame, "text", "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", _digest).drop("text")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(documents(spark, sf_dir))


#: The tools of op5_chat.
TOOLS = {"measure": {"type": "object", "properties": {"bytes": {"type": "integer"}, "unit": {"enum": ["byte"]}, "after": {"type": "string"}}, "required": ["bytes", "unit"], "additionalProperties": False}}


def tool_traffic(conversations: DataFrame) -> DataFrame:
    """The conversations, and a tool's part in each: every answer is measured by a call (turn 100 and on) that names the one before in its conversation, and a user's
    turn after an answer brings the call's result (turn 200 and on). Calls on texts whose length ends in 3 have a wrong unit, in 7 none, in 9 another tool."""
    n = F.octet_length("text")
    asked = conversations.where("role = 'assistant'").withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    unit = F.when(n % 10 == 3, F.lit("word")).when(n % 10 != 7, F.lit("byte"))
    arguments = F.struct(F.concat(F.lit("${c"), "before", F.lit("}")).alias("after"), n.alias("bytes"), unit.alias("unit"))
    call = F.struct(F.concat(F.lit("c"), "turn").alias("id"), F.when(n % 10 == 9, F.lit("weigh")).otherwise(F.lit("measure")).alias("name"), arguments.alias("arguments"))
    calls = asked.select("conv_id", (F.col("turn") + 100).alias("turn"), "role", F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    answered = conversations.where("role = 'user'").join(asked.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"], "left_semi")
    result = F.concat(F.lit(' {"content": "measured", "tool_call_id": "c'), F.col("turn") - 1, F.lit('"}'))
    results = answered.select("conv_id", (F.col("turn") + 200).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(calls).union(results)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(tool_traffic(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)


#: For conversations in which no message is a JSON object by itself, as in the tables.
OP5_SQL = """
WITH asked AS (
  SELECT conv_id, turn, strlen(text) AS n, lag(turn) OVER w AS before, row_number() OVER w - 1 AS depth
  FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), answered AS (
  SELECT a.conv_id, u.turn, a.depth FROM asked a JOIN conversations u ON u.role = 'user' AND u.conv_id = a.conv_id AND u.turn = a.turn + 1
), rows AS (
  SELECT conv_id, turn, role, 0 AS level, 0 AS n_calls, 0 AS n_linked, 0 AS n_invalid, to_json({'content': text, 'role': role, 'turn': turn})::VARCHAR AS message FROM conversations
  UNION ALL
  SELECT conv_id, turn + 100, 'assistant', depth, 1, (EXISTS (SELECT 1 FROM answered r WHERE r.conv_id = a.conv_id AND r.turn = a.turn + 1))::BIGINT, (n % 10 IN (3, 7, 9))::BIGINT,
    '{"content":null,"role":"assistant","tool_calls":[{"arguments":{' || coalesce('"after":"${c' || before || '}",', '') || '"bytes":' || n || CASE n % 10 WHEN 3 THEN ',"unit":"word"' WHEN 7 THEN '' ELSE ',"unit":"byte"' END || '},'
    || CASE n % 10 WHEN 3 THEN '"errors":["$.unit: not one of the values"],' WHEN 7 THEN '"errors":["$.unit: missing"],' WHEN 9 THEN '"errors":["$: no such tool"],' ELSE '' END
    || '"id":"c' || turn || '","name":"' || CASE n % 10 WHEN 9 THEN 'weigh' ELSE 'measure' END || '"}],"turn":' || turn + 100 || '}'
  FROM asked a
  UNION ALL
  SELECT conv_id, turn + 200, 'tool', depth + 1, 0, 1, 0, '{"content":"measured","role":"tool","tool_call_id":"c' || turn - 1 || '","turn":' || turn + 200 || '}' FROM answered
)
SELECT conv_id, turn, role, level::INTEGER AS level, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) - 1 AS position, n_calls::BIGINT AS n_calls, n_linked::BIGINT AS n_linked, n_invalid::BIGINT AS n_invalid, message FROM rows
"""


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    return lmscore.score(documents(spark, sf_dir), good, keep=[F.col("doc_id")])


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held & F.col("doc_id").isNotNull()))
    return langid.classify(docs, model, keep=[F.col("doc_id"), held.alias("held_out")])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(langid.fold("doc_id", 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    return quality.score(docs, quality.train(docs, labels), keep=[F.col("doc_id"), held.alias("held_out")])


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_licenses, op3_suffixdup, op4_media, op5_chat, op6_decontam, op7_lmscore, op8_langid, op9_quality, op10_jaccard)}
SQL: dict[str, str] = {"op5_chat": OP5_SQL}
