"""Tool-call linking in conversations.

An assistant's message that is a JSON object with a list `tool_calls` ([{id, name, arguments}]) makes calls; a message of role `tool`
that is a JSON object with `tool_call_id` is a result. Results are joined to calls by (conversation, id); an id that was called
twice belongs to its first call. A call depends on the calls that its arguments name as "${id}". Levels put every message after what
it depends on: a plain message or a call without dependencies has level 0, a call one more than what it names, a result one more
than its call; `position` numbers a conversation's messages in that order (by level, what depends on a ring last, and by turn). Arguments are
checked against the tools' schemas, and every message is written as canonical JSON (sorted keys, no spaces).

What is JSON is decided by one parser, Python's, once for each message that begins with a brace after white space.

Defined results: texts that are not such JSON, null and empty texts are plain messages. A result without a call, or a call without a result,
is counted as unlinked and stays at level 0. Calls that depend on each other in a ring, or on such calls, get level -1, and so do their results. Repeated rows
are a row each, linked alike. A message with a null conversation is never linked and has no position. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from relgrid.llm.common import small_batches, written

#: Dependencies of a conversation that one task settles; those of longer ones are settled in rounds.
SETTLED = 50_000
_BRACE, _NAMED = re.compile(r"[ \t\r\n]*\{"), re.compile(r"\$\{([^}]+)\}")
PARSED = "calls array<struct<call: string, needs: array<string>>>, answers string"


def parse(text: str | None) -> dict | None:
    """The JSON object that a text is, or None."""
    if not text or not _BRACE.match(text):
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _name(value: object) -> str | None:
    """An id as text; only texts and whole numbers are ids."""
    return str(value) if isinstance(value, str | int) and not isinstance(value, bool) else None


def _parts(role: str | None, text: str | None) -> tuple[list[dict] | None, str | None]:
    """(calls with what they need, id of the call that is answered) of a message."""
    found = parse(text) if role in ("assistant", "tool") else None
    if found is None:
        return None, None
    if role == "tool":
        return None, _name(found.get("tool_call_id"))
    if not isinstance(found.get("tool_calls"), list):
        return None, None
    calls = []
    for call in found["tool_calls"]:
        call = call if isinstance(call, dict) else {}
        given = call.get("arguments")
        ident = _name(call.get("id"))
        calls.append({"call": ident, "needs": sorted(set(_NAMED.findall(given if isinstance(given, str) else json.dumps(given, ensure_ascii=False))) - {ident})})
    return calls, None


def schema_errors(value: object, schema: dict, path: str = "$") -> list[str]:
    """What doesn't fit a JSON schema (type, enum, required, properties, additionalProperties, items)."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
    out = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(isinstance(value, kinds[n]) and not (isinstance(value, bool) and n in ("integer", "number")) for n in names):
            return [f"{path}: not {' or '.join(names)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += schema_errors(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            out += schema_errors(v, schema["items"], f"{path}[{k}]")
    return out


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _rendered(turn: int | None, role: str | None, text: str | None, tools: dict[str, dict]) -> tuple[int, str]:
    """(calls with invalid arguments, canonical JSON) of a message."""
    body: dict = {"role": role, "turn": turn}
    parsed = parse(text)
    invalid = 0
    if role == "assistant" and parsed is not None and isinstance(parsed.get("tool_calls"), list):
        calls = []
        for call in parsed["tool_calls"]:
            call = call if isinstance(call, dict) else {"id": None, "name": None, "arguments": call}
            given = call.get("arguments")
            if isinstance(given, str):
                try:
                    given = json.loads(given)
                except ValueError:
                    pass
            name = call.get("name")
            errors = schema_errors(given, tools[name]) if isinstance(name, str) and name in tools else ([] if not tools else ["$: no such tool"])
            invalid += bool(errors)
            calls.append({"id": call.get("id"), "name": name, "arguments": given, **({"errors": errors} if errors else {})})
        body |= {"tool_calls": calls, "content": parsed.get("content")}
    elif role == "tool" and parsed is not None and "tool_call_id" in parsed:
        body |= {"tool_call_id": parsed["tool_call_id"], "content": parsed.get("content")}
    else:
        body["content"] = text
    return invalid, canonical(body)


def _settle(table: pa.Table) -> pa.Table:
    """Levels of one conversation's calls (conv, call, needs) in the order of what they need; -1 for what depends on a ring."""
    needs: dict[str, list[str]] = {}
    users: dict[str, list[str]] = {}
    for call, need in zip(table["call"].to_pylist(), table["needs"].to_pylist(), strict=True):
        needs.setdefault(call, []).append(need)
        users.setdefault(need, []).append(call)
    level = {n: 0 for n in users if n not in needs}
    waiting, ready = {c: len(n) for c, n in needs.items()}, list(level)
    for done in ready:
        for call in users.get(done, ()):
            waiting[call] -= 1
            if not waiting[call]:
                level[call] = 1 + max(level[n] for n in needs[call])
                ready.append(call)
    calls = list(needs)
    return pa.table({"conv": table["conv"].slice(0, 1).combine_chunks().take(pa.array([0] * len(calls))), "call": pa.array(calls, pa.string()), "level": pa.array([level.get(c, -1) for c in calls], pa.int32())})


def _levels(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(conv, call, level) of calls with dependencies (conv, call, needs); -1 in a ring. A conversation of up to SETTLED dependencies is
    settled in one task, longer ones level by level in rounds until nothing changes."""
    known = written(links.join(calls.select("conv", F.col("call").alias("needs")), ["conv", "needs"], "left_semi").select("conv", "call", "needs"), "needs")
    free = calls.join(known, ["conv", "call"], "left_anti").select("conv", "call", F.lit(0).alias("level"))
    schema = T.StructType([T.StructField("conv", calls.schema["conv"].dataType), *T.StructType.fromDDL("call string, level int").fields])
    sizes = written(known.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    long = sizes.where(F.col("n") > SETTLED)
    if long.isEmpty():
        return written(free.union(known.groupBy("conv").applyInArrow(_settle, schema)), "levels")
    few = known.join(sizes.where(F.col("n") <= SETTLED), "conv", "left_semi")
    settled = written(free.union(few.groupBy("conv").applyInArrow(_settle, schema)), "levels")
    many = F.broadcast(long.select("conv"))  # one row for every SETTLED dependencies at most
    todo, done = written(known.join(many, "conv", "left_semi"), "todo"), [settled]
    levels = written(settled.join(many, "conv", "left_semi"), "round")
    while True:
        met = todo.join(levels.withColumnRenamed("call", "needs"), ["conv", "needs"], "left")
        new = written(met.groupBy("conv", "call").agg(F.count("*").alias("n"), F.count("level").alias("m"), F.max("level").alias("top")).where("n = m").select("conv", "call", (F.col("top") + 1).alias("level")), "round")
        if new.isEmpty():
            rings = todo.select("conv", "call").distinct().withColumn("level", F.lit(-1))
            return reduce(DataFrame.union, [*done, rings])
        done.append(new)
        todo, levels = written(todo.join(new, ["conv", "call"], "left_anti"), "todo"), written(levels.union(new), "round")


def _numbered(messages: DataFrame, at: list[str]) -> DataFrame:
    """The messages with their `position` in their conversation by the columns `at`. Ranges of the order are numbered apart and then
    set off by the counts of those before them, so a long conversation is dealt over tasks."""
    ranged = written(messages.repartitionByRange("conv", *at).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("conv", "part", F.coalesce("before", F.lit(0)).alias("before"))  # a row for each range
    inner = ranged.withColumn("row", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*at)))
    return inner.join(before, ["conv", "part"], "left").withColumn("position", F.col("before") + F.col("row") - 1).drop("part", "row", "before")


def link(messages: DataFrame, tools: dict[str, dict] | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, level, position, n_calls, n_linked (calls with a result, or 1 for a result with its call), n_invalid, message."""
    tools = tools or {}
    base = small_batches(messages).select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).cast("string").alias("text"))
    kind = T.StructType([*base.schema.fields, *T.StructType.fromDDL(PARSED).fields])
    added = to_arrow_schema(T.StructType.fromDDL(PARSED))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parts(r, x) for r, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [pa.array([f[k] for f in found], added.field(k).type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "calls", "answers"])

    parsed = written(base.mapInArrow(read, kind), "messages")
    made = parsed.where("calls is not null and conv is not null").select("conv", "turn", F.posexplode("calls").alias("pos", "c")).where("c.call is not null")
    calls = made.groupBy("conv", F.col("c.call").alias("call")).agg(F.min(F.struct("turn", "pos", F.col("c.needs").alias("needs"))).alias("f"))
    calls = written(calls.select("conv", "call", F.col("f.turn").alias("call_turn"), F.col("f.needs").alias("needs")), "calls")
    level = _levels(calls, calls.select("conv", "call", F.explode("needs").alias("needs")))
    results = written(parsed.where("answers is not null and conv is not null").groupBy("conv", F.col("answers").alias("call")).agg(F.count("*").alias("results")), "results")
    known = written(calls.drop("needs").join(level, ["conv", "call"], "left").join(results, ["conv", "call"], "left"), "known")
    of_calls = known.groupBy("conv", F.col("call_turn").alias("turn")).agg(F.max("level").alias("cl"), F.min("level").alias("ring"), F.count("results").alias("cn"))
    of_results = known.where("results is not null").select("conv", F.col("call").alias("answers"), F.when(F.col("level") >= 0, F.col("level") + 1).otherwise(-1).alias("rl"))
    joined = parsed.join(of_calls, ["conv", "turn"], "left").join(of_results, ["conv", "answers"], "left")
    calling = F.col("calls").isNotNull()
    plain = joined.select(
        "conv",
        "turn",
        "role",
        "text",
        F.coalesce(F.when(calling, F.when(F.col("ring") < 0, -1).otherwise(F.col("cl"))), "rl", F.lit(0)).cast("int").alias("level"),
        F.when(calling, F.size("calls")).otherwise(0).cast("long").alias("n_calls"),
        F.coalesce(F.when(calling, F.col("cn")), F.when(F.col("rl").isNotNull(), 1), F.lit(0)).cast("long").alias("n_linked"),
    )
    ordered = plain.withColumn("last", F.col("level") < 0)
    plain = _numbered(ordered, ["last", "level", "turn", "role", "text"]).select(*plain.columns, "position")
    fields = plain.schema
    out = T.StructType([T.StructField("conv_id", fields["conv"].dataType), T.StructField("turn", fields["turn"].dataType), *T.StructType.fromDDL("role string, level int, position bigint, n_calls bigint, n_linked bigint, n_invalid bigint, message string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            found = [_rendered(*row, tools) for row in rows]
            invalid, message = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), batch.column(7), batch.column(5), batch.column(6), pa.array(invalid, pa.int64()), pa.array(message, pa.string())], names=out.names)

    return plain.mapInArrow(run, out)
