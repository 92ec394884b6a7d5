"""Tool-call linking for chat data.

Calls and results are hash-joined by (conversation, call id). Calls are put in
topological order of the calls they build on: a call's level is one more than the
highest level among these, found level by level with equi-joins, so no conversation
is ever gathered in one task. Arguments are parsed and checked against the tool's
schema, and each linked call is written as one line of canonical JSON (sorted keys,
no blanks, UTF-8). Lines sort by (conversation, level, turn, call id).

Defined cases: a call or result without an id or a conversation is never linked (``no_id``); of
repeated ids the one with the smallest turn counts and ``repeats`` says how many
there were; a call without result is ``no_result``, a result without call
``no_call``; a dependency on an unknown call is ignored and counted in
``missing``; calls on a cycle have a null level and status ``cycle``; null, empty or
broken arguments, numbers beyond a double and halves of surrogate pairs among them, are an
error of the arguments and go into the line as they came; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfmark.llm.common import carried, table, written

carried(__name__)

KEY = ["conv_id", "call_id"]
# The schema keywords that are checked: type, enum, minimum, maximum, maxLength, required, properties, additionalProperties, items.
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    return isinstance(value, TYPES[kind])


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema, in order of the schema's keywords."""
    if "type" in schema and not _is(value, schema["type"]):
        return [f"{at}: not {schema['type']}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        out.append(f"{at}: longer than {schema['maxLength']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


def _line(call_id: str | None, tool: str | None, arguments: str | None, content: str | None, schemas: dict) -> tuple[str, str]:
    """Canonical JSON of a linked call, and the errors of its arguments."""
    try:
        parsed = json.loads(arguments or "", parse_constant=lambda _: 1 / 0)
        errors = violations(parsed, schemas[tool]) if tool in schemas else [f"$: no schema for {tool}"]
        canonical(parsed).encode()  # numbers beyond a double and halves of surrogate pairs have no JSON text in UTF-8
    except (ValueError, ZeroDivisionError, RecursionError):
        parsed, errors = arguments, ["$: not JSON"]
    return canonical({"id": call_id, "name": tool, "arguments": parsed, "result": content}), "; ".join(errors)


def _lines(schemas: dict) -> Column:
    @F.pandas_udf(T.StructType().add("line", T.StringType()).add("errors", T.StringType()))
    def write(ids: pd.Series, tools: pd.Series, arguments: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = zip(*(s.where(s.notna(), None) for s in (ids, tools, arguments, contents)))
        return pd.DataFrame([_line(*r, schemas) for r in rows], columns=["line", "errors"])

    return write("call_id", "tool", "arguments", "content")


def first_of(rows: DataFrame, values: list[str]) -> DataFrame:
    """One row per (conversation, id): the one with the smallest turn (then values); combined on the map side."""
    least = rows.filter("call_id is not null and conv_id is not null").groupBy(*KEY).agg(F.min(F.struct("turn", *values)).alias("v"), F.count("*").alias("repeats"))
    return least.select(*KEY, "v.*", "repeats")


def levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(level of each call that is on no cycle, number of unknown dependencies)."""
    edges = calls.select(*KEY, F.explode(F.array_distinct("after")).alias("parent")).filter("parent is not null")
    known = calls.select("conv_id", F.col("call_id").alias("parent"))
    missing = edges.join(known, ["conv_id", "parent"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("missing"))
    open_edges = written(edges.join(known, ["conv_id", "parent"]), "edges")
    now = written(calls.select(*KEY).join(open_edges, KEY, "left_anti").withColumn("level", F.lit(0)), "level")
    done = now
    while True:  # once per level of the deepest chain
        parents = now.select("conv_id", F.col("call_id").alias("parent"))
        touched = open_edges.join(parents, ["conv_id", "parent"], "left_semi").select(*KEY).distinct()
        open_edges = written(open_edges.join(parents, ["conv_id", "parent"], "left_anti"), "edges")
        level = touched.join(open_edges, KEY, "left_anti")
        now = written(level.withColumn("level", F.lit(now.first()["level"] + 1) if not now.isEmpty() else F.lit(0)), "level")
        if now.isEmpty():
            return done, missing
        done = done.union(now)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Linked calls with status, level and canonical line.

    ``calls``: conv_id, call_id, turn, tool, arguments, after (ids it builds on).
    ``results``: conv_id, call_id, turn, content. ``schemas``: tool name to schema.
    """
    made = written(first_of(calls, ["tool", "arguments", "after"]), "calls")
    got = first_of(results, ["content"]).select(*KEY, F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"))
    level, missing = levels(made)
    both = made.withColumn("called", F.lit(True)).join(got, KEY, "full_outer").join(level, KEY, "left").join(missing, KEY, "left")
    nameless = calls.filter("call_id is null or conv_id is null").select(*KEY, "turn", "tool", "arguments").unionByName(
        results.filter("call_id is null or conv_id is null").select(*KEY, F.col("turn").alias("result_turn"), "content"), allowMissingColumns=True)
    rows = both.drop("after").unionByName(nameless, allowMissingColumns=True).withColumn("w", _lines(schemas))
    status = (F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "no_id").when(F.col("called").isNull(), "no_call").when(F.col("level").isNull(), "cycle")
              .when(F.col("answered").isNull(), "no_result").when(F.col("w.errors") != "", "bad_arguments").otherwise("ok"))
    return rows.select(*KEY, "turn", "result_turn", "tool", "level", F.coalesce("repeats", F.lit(0)).alias("repeats"),
                       F.coalesce("missing", F.lit(0)).alias("missing"), status.alias("status"),
                       F.when(F.col("called").isNotNull(), F.col("w.errors")).alias("errors"), F.col("w.line").alias("line"))


TOOLS = ("search", "lookup", "sum")
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "maxLength": 1200}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "lookup": {"type": "object", "required": ["query", "limit"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 5}}},
    "sum": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "number", "maximum": 90}}},
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that follow from plain conversations.

    Each assistant turn makes a call whose arguments are its first words and its length;
    the next turn, if it is another's or nobody's (null role), is the result. Two of three
    calls build on the call two turns before. A turn without a number has no call id.
    """
    name = lambda turn: F.concat("conv_id", F.lit("-"), turn)
    size = F.length(F.coalesce("text", F.lit("")))
    said = turns.filter("role = 'assistant'")
    calls = said.select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.element_at(F.array(*map(F.lit, TOOLS)), (F.pmod("turn", F.lit(3)) + 1).cast("int")).alias("tool"),
        F.to_json(F.struct(F.col("text").alias("query"), F.pmod(size, F.lit(97)).alias("limit"))).alias("arguments"),
        F.when(F.pmod(F.col("turn") + F.col("conv_id"), F.lit(3)) > 0, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = turns.filter("coalesce(role, '') <> 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op3_tool_calls(spark, sf_dir):
    """Every call and result of all conversations, linked, ordered, checked and serialised."""
    return link(*from_turns(table(spark, sf_dir, "conversations")), SCHEMAS)
