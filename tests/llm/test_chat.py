import json

import duckdb

from relgrid.llm import chat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TOOLS = {"get": {"type": "object", "properties": {"city": {"type": "string"}, "n": {"type": "integer"}}, "required": ["city"], "additionalProperties": False}}


def calls(*made):
    return json.dumps({"content": "on it", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in made]})


def result(ident, content):
    return json.dumps({"tool_call_id": ident, "content": content})


def test_linking(spark):
    rows = [
        (1, 0, "user", "what is it like?"),
        (1, 1, "assistant", calls(("c1", "get", {"city": "Köln", "n": 2}), ("c2", "get", {"town": "x"}))),
        (1, 2, "tool", result("c1", "rain")),
        (1, 3, "assistant", calls(("c3", "get", {"city": "${c1}"}))),
        (1, 4, "assistant", calls(("c4", "get", {"city": "${c3} and ${c1}"}))),
        (1, 5, "tool", result("c4", {"b": 1, "a": [2]})),
        (1, 6, "tool", result("lost", "?")),
        (2, 0, "assistant", calls(("r1", "get", {"city": "${r2}"}), ("r2", "get", {"city": "${r1}"}))),
        (2, 1, "tool", result("c1", "of another conversation")),
        (2, 2, "assistant", "{ not json"),
        (None, 0, "assistant", calls(("c1", "get", {"city": "x"}))),
        (3, None, None, None),
        (3, 1, "user", ""),
        (3, 1, "user", ""),
        (4, 0, "assistant", calls(("d", "get", {"city": "1"}), ("d", "nope", {}))),
        (4, 1, "tool", result("d", "first")),
    ]
    found = chat.link(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()
    assert len(found) == len(rows)
    by = {(r.conv_id, r.turn): r for r in found}
    level = lambda c, t: by[c, t].level
    assert [level(1, t) for t in range(7)] == [0, 0, 1, 1, 2, 3, 0]
    assert (by[1, 1].n_calls, by[1, 1].n_linked, by[1, 1].n_invalid) == (2, 1, 1)
    assert (by[1, 2].n_linked, by[1, 6].n_linked, by[2, 1].n_linked, by[4, 1].n_linked) == (1, 0, 0, 1)
    assert level(2, 0) == -1 and by[4, 0].n_invalid == 1 and by[None, 0].n_linked == 0
    message = json.loads(by[1, 1].message)
    assert message["tool_calls"][1]["errors"] == ["$.city: missing", "$.town: unknown"] and "Köln" in by[1, 1].message
    assert by[1, 5].message == '{"content":{"a":[2],"b":1},"role":"tool","tool_call_id":"c4","turn":5}'
    assert by[2, 2].message == '{"content":"{ not json","role":"assistant","turn":2}' and by[3, None].message == '{"content":null,"role":null,"turn":null}'
    assert all(chat.canonical(json.loads(r.message)) == r.message for r in found)
    assert chat.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain(spark):
    """A chain of more calls than any number of rounds that one would run, with a ring beside it."""
    rows = [(1, k, "assistant", calls((f"c{k}", "get", {"city": f"${{c{k - 1}}}" if k else "x"}))) for k in range(300)]
    rows += [(1, 300, "tool", result("c299", "y")), (1, 301, "assistant", calls(("a", "get", {"city": "${b}"}), ("b", "get", {"city": "${a}"})))]
    found = {r.turn: r.level for r in chat.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {**{k: k for k in range(301)}, 301: -1}


def test_levels_in_rounds(spark, monkeypatch):
    """Conversations with more dependencies than one task settles."""
    monkeypatch.setattr(chat, "SETTLED", 3)
    rows = [(1, k, "assistant", calls((f"c{k}", "get", {"city": f"${{c{k - 1}}} ${{c{k // 2}}}" if k else "x"}))) for k in range(6)]
    rows += [(1, 10, "assistant", calls(("a", "get", {"city": "${b}"}), ("b", "get", {"city": "${a}"}))), (1, 11, "assistant", calls(("d", "get", {"city": "${a} ${c2}"})))]
    rows += [(2, 0, "assistant", calls(("x", "get", {}))), (2, 1, "assistant", calls(("y", "get", {"n": "${x}"})))]
    found = {(r.conv_id, r.turn): (r.level, r.position) for r in chat.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {**{(1, k): (k, k) for k in range(6)}, (1, 10): (-1, 6), (1, 11): (-1, 7), (2, 0): (0, 0), (2, 1): (1, 1)}


def test_one_rule_for_json(spark):
    """White space before the brace, single quotes, other values than objects, clashing columns, a long conversation."""
    rows = [(1, 0, "assistant", " \n" + calls(("c", "get", {"city": "x"}))), (1, 1, "tool", "\t" + result("c", 1)), (1, 2, "assistant", "{'tool_calls': []}"), (1, 3, "assistant", "[1]"), (1, 4, "tool", '{"tool_call_id": 7}'), (1, 5, "assistant", '{"tool_calls": [{"id": 7, "arguments": "{\\"n\\": \\"${c}\\"}"}, 3]}')]
    rows += [(2, k, "user", "word " * 50) for k in range(500)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS level", "2 AS call", "3 AS conv", "4 AS position")
    found = {(r.conv_id, r.turn): r for r in chat.link(frame).collect()}
    one = [found[1, k] for k in range(6)]
    assert [(r.level, r.n_calls, r.n_linked) for r in one] == [(0, 1, 1), (1, 0, 1), (0, 0, 0), (0, 0, 0), (2, 0, 1), (1, 2, 1)]
    assert [r.position for r in one] == [0, 3, 1, 2, 5, 4] and json.loads(one[2].message)["content"] == "{'tool_calls': []}"
    assert [found[2, k].position for k in range(500)] == list(range(500))


def test_schema_checks():
    schema = {"type": "object", "properties": {"xs": {"type": "array", "items": {"type": ["integer", "null"]}}, "k": {"enum": ["a", "b"]}}}
    assert chat.schema_errors({"xs": [1, None], "k": "a", "more": 1}, schema) == []
    assert chat.schema_errors({"xs": [True], "k": "c"}, schema) == ["$.xs[0]: not integer or null", "$.k: not one of the values"]
    assert chat.schema_errors([], schema) == ["$: not object"]


def test_query(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    frame = queries.op5_chat(spark, sf_dir)
    want = c.sql(queries.SQL["op5_chat"])
    assert frame.columns == want.columns
    found = frame.collect()
    assert sorted(tuple(r) for r in found) == sorted(want.fetchall())
    assert all(len({getattr(r, c) for r in found}) > 1 for c in ("level", "position", "n_calls", "n_linked", "n_invalid"))
