import json

from pyspark.sql import functions as F

from shelfmark.llm import chat

SF = "/root/testdata/sf0.001"
SCHEMA = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}}}}


def linked(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, tool string, arguments string, after array<string>").withColumn("level", F.lit(9))
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").withColumn("status", F.lit("x"))
    return chat.link(c, r, SCHEMA).collect()


def test_links_orders_and_checks(spark):
    calls = [(1, "c", 5, "f", '{"a": 3}', ["b", "zz"]), (1, "b", 3, "f", '{"a": 2}', ["a"]), (1, "a", 1, "f", '{ "a" : 1 }', []), (1, "a", 9, "f", "{}", []),
             (2, "p", 1, "f", '{"a": 1}', ["q"]), (2, "q", 2, "f", '{"a": 1}', ["p"]), (2, "r", 2, "f", '{"a": 1}', None), (3, None, 1, "f", "{}", []),
             (4, "x", 1, "f", "{}", []), (4, "y", 2, "g", '{"a":1}', []), (4, "z", 3, "f", None, []), (4, "w", 4, "f", '{"a": 0, "b": 1}', [])]
    results = [(1, "a", 2, "ra"), (1, "b", 4, "rb"), (1, "c", 6, "rc"), (1, "gone", 7, "r"), (4, "x", 2, "r"), (4, "y", 3, "é"), (4, "z", 4, None), (4, "w", 5, "r"), (5, None, 1, "r")]
    got = {(r.conv_id, r.call_id, r.turn): r for r in linked(spark, calls, results)}
    assert {k: (r.status, r.level) for k, r in got.items()} == {
        (1, "a", 1): ("ok", 0), (1, "b", 3): ("ok", 1), (1, "c", 5): ("ok", 2), (1, "gone", None): ("no_call", None), (2, "p", 1): ("cycle", None), (2, "q", 2): ("cycle", None),
        (2, "r", 2): ("no_result", 0), (3, None, 1): ("no_id", None), (4, "x", 1): ("bad_arguments", 0), (4, "y", 2): ("bad_arguments", 0), (4, "z", 3): ("bad_arguments", 0),
        (4, "w", 4): ("bad_arguments", 0), (5, None, None): ("no_id", None)}
    assert got[1, "a", 1].repeats == 2 and got[1, "c", 5].missing == 1
    assert got[1, "a", 1].line == '{"arguments":{"a":1},"id":"a","name":"f","result":"ra"}'
    assert got[4, "x", 1].errors == "$.a: missing" and got[4, "w", 4].errors == "$.a: below 1; $.b: unknown" and got[4, "z", 3].errors == "$: not JSON"
    assert '"result":"é"' in got[4, "y", 2].line


def test_empty(spark):
    assert linked(spark, [], []) == []


def test_schema_words():
    v = chat.violations
    assert v(1.0, {"type": "integer"}) == [] and v(True, {"type": "integer"}) == ["$: not integer"] and v(None, {"type": "null"}) == []
    assert v(["a", 1], {"type": "array", "items": {"type": "string"}}) == ["$[1]: not string"]
    assert v("abc", {"enum": ["x"], "maxLength": 2}) == ["$: not in enum", "$: longer than 2"]


def test_query_against_brute_force(spark):
    import duckdb
    turns = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    calls, results = {}, {}
    for c, t, role, text in turns:
        if role == "assistant":
            calls[f"{c}-{t}"] = (c, t, chat.TOOLS[t % 3], {"query": text, "limit": len(text) % 97}, f"{c}-{t - 2}" if (t + c) % 3 else None)
        else:
            results[f"{c}-{t - 1}"] = text
    level = lambda k: 0 if calls[k][4] not in calls else 1 + level(calls[k][4])
    want = {}
    for k in calls.keys() | results.keys():
        if k not in calls:
            want[k] = ("no_call", None, None)
            continue
        _, _, tool, arguments, _ = calls[k]
        bad = chat.violations(arguments, chat.SCHEMAS[tool])
        line = json.dumps({"arguments": arguments, "id": k, "name": tool, "result": results.get(k)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        want[k] = ("no_result" if k not in results else "bad_arguments" if bad else "ok", level(k), line)
    got = {r.call_id: (r.status, r.level, r.line if r.turn is not None else None) for r in chat.op3_tool_calls(spark, SF).collect()}
    assert got == want


def test_turns_without_role_or_number_have_a_row(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "hello there"), (1, 2, None, "answer"), (1, 4, None, "lone"), (1, None, "user", "when"), (1, None, "assistant", "what")],
                                  "conv_id long, turn long, role string, text string")
    rows = chat.link(*chat.from_turns(turns), chat.SCHEMAS).collect()
    assert sorted((str(r.call_id), r.status) for r in rows) == [("1-1", "ok"), ("1-3", "no_call"), ("None", "no_id"), ("None", "no_id")]
    assert [r.line for r in rows if r.call_id == "1-1"][0].endswith('"result":"answer"}')


def test_every_turn_is_in_a_row_with_its_whole_text(spark):
    long = "very " * 300_000
    turns = [(1, 0, "system", "be kind"), (1, 1, "assistant", long), (1, 2, "user", None), (2, 0, "user", ""), (None, 1, "assistant", "lost"), (None, 2, "user", "too")]
    rows = chat.link(*chat.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), chat.SCHEMAS).collect()
    got = {(r.conv_id, r.turn, r.result_turn): r for r in rows}
    assert {k: r.status for k, r in got.items()} == {
        (1, None, 0): "no_call", (1, 1, 2): "ok", (2, None, 0): "no_call", (None, 1, None): "no_id", (None, None, 2): "no_id"}
    assert json.loads(got[1, 1, 2].line)["arguments"]["query"] == long and json.loads(got[1, None, 0].line)["result"] == "be kind"


def test_arguments_that_have_no_json_text(spark):
    broken = ['{"a": 1e999}', '{"a": "\\ud800"}', "[" * 100_000, "{", '{"a": NaN}', ""]
    rows = linked(spark, [(1, f"c{i}", i, "f", x, []) for i, x in enumerate(broken)], [])
    assert len(rows) == len(broken) and {r.errors for r in rows} == {"$: not JSON"} and {r.status for r in rows} == {"no_result"}
    assert {json.loads(r.line)["arguments"] for r in rows} == set(broken)
