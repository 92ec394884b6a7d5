"""Registry of checks, table access and small builders for the SQL side."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.text import WHITESPACE
from shelfmark.sources.tables import stored_bytes

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"duplicate check {name}")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Stored bytes of documents for one task.
TASK_BYTES = 8_000_000


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, dealt out because the checks on them are CPU-heavy and small tables are one split.

    Every slot gets a part; a larger table has more parts, not larger ones.
    """
    parts = ceil(stored_bytes(spark, f"{sf}/documents.parquet") / TASK_BYTES)
    return table(spark, sf, "documents").repartition(max(spark.sparkContext.defaultParallelism, parts))


# Expressions that both engines read the same way (no backslashes, no casts of kind).
BOOK_TEXT = "concat('# Document ', cast(doc_id as varchar(20)), chr(10), chr(10), replace(text, chr(10), chr(10) || chr(10)))"


def md_text(spark: SparkSession, sf: str) -> DataFrame:
    """One book per document: short lines become headings, lines become paragraphs."""
    docs = documents(spark, sf)
    headed = F.regexp_replace("text", r"(?dm)^(.{1,60})$", "# $1")
    return docs.select(
        "doc_id", F.concat(F.lit("doc"), "doc_id").alias("book_id"), F.col("source").alias("author"),
        F.concat(F.lit("Title "), "lang").alias("title"), "lang", "source",
        F.replace(headed, F.lit("\n"), F.lit("\n\n")).alias("text"))


MD_SQL = r"""
books as (
  select doc_id, 'doc' || doc_id as book_id, source as author, 'Title ' || lang as title, lang, source,
         replace(regexp_replace(text, '(?m)^(.{1,60})$', '# \1', 'g'), chr(10), chr(10) || chr(10)) as text
  from documents)
"""

# White space as a character class for the SQL side, whose own \s is ASCII only.
SP = r"\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
IN_LINE = r"[\t\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"\p{L}\p{N}_"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_sub(x: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(replacement)}, 'g')"


def d_strip(x: str) -> str:
    return f"trim({x}, {quote(WHITESPACE)})"


def d_squeeze(x: str) -> str:
    return d_strip(d_sub(x, f"[{SP}]+", " "))


def d_lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def d_title(x: str) -> str:
    runs = rf"regexp_extract_all({x}, '(\p{{L}}+|[^\p{{L}}]+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda r: case when r[1] = 'ß' then 'Ss' else upper(r[1]) end || lower(r[2:])), '')"


def d_clean_heading(x: str) -> str:
    return d_squeeze(d_sub(d_sub(x, r"\{[^}]*\}"), r"\[([^\]]*)\]", r"\1"))


def d_paragraphs(x: str) -> str:
    parts = f"regexp_split_to_array({d_strip(x)}, '\\n\\n+')"
    return f"list_filter(list_transform({parts}, lambda p: {d_strip('p')}), lambda p: p <> '')"


def d_tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^{SP}]+'))"


def d_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
