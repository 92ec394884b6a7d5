"""Result rows as terminal text, JSON objects and note sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.numbers import round_exact
from shelfmark.functions.text import notes_preview, pretty_preview, query_slug

# Field order of a JSON result and the columns they come from.
JSON_FIELDS = (
    ("score", None), ("book_id", "book_id"), ("author", "author"), ("title", "title"),
    ("chapter_number", "chapter_number"), ("chapter_title", "chapter_title"), ("text", "text"),
    ("char_start", "char_start"), ("char_end", "char_end"), ("parent_id", "id"),
)


def score(df: DataFrame) -> Column:
    """Fused score, else the single-list score, else 0; a zero counts as absent."""
    options = []
    if "_rrf_score" in df.columns:
        options.append(F.nullif(F.col("_rrf_score"), F.lit(0.0)))
    if "_score" in df.columns:
        options.append(F.col("_score"))
    return F.coalesce(*options, F.lit(0.0))


def four_places(c: Column) -> Column:
    """Four decimals of the exact value, ties to even."""
    return F.format_string("%.4f", round_exact(c, 4))


def _known(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("?"))


def pretty(df: DataFrame) -> Column:
    book = _known(F.col("book_id"))
    head = F.concat(
        F.lit("["), four_places(score(df)), F.lit("] "), _known(F.col("author")), F.lit(" — "),
        F.coalesce(F.col("title"), book), F.lit(", Ch. "), _known(F.col("chapter_number")), F.lit(": "),
        _known(F.col("chapter_title")),
    )
    body = F.concat(F.lit("  "), pretty_preview(F.coalesce(F.col("text"), F.lit(""))), F.lit("..."))
    return F.concat_ws("\n", head, body, F.concat(F.lit("  → markdown/"), book, F.lit(".md")), F.lit(""))


def json_fields(df: DataFrame) -> list[Column]:
    return [(score(df) if source is None else F.col(source)).alias(name) for name, source in JSON_FIELDS]


def json_object(df: DataFrame) -> Column:
    return F.to_json(F.struct(*json_fields(df)), {"ignoreNullFields": "false"})


def note_section(df: DataFrame, place: Column) -> Column:
    book = _known(F.col("book_id"))
    head = F.concat(
        F.lit("## "), place.cast("string"), F.lit(". ("), four_places(score(df)), F.lit(") "),
        _known(F.col("author")), F.lit(" — *"), F.coalesce(F.col("title"), book), F.lit("*, Ch. "),
        _known(F.col("chapter_number")),
    )
    quote = F.concat(F.lit("> "), notes_preview(F.coalesce(F.col("text"), F.lit(""))))
    link = F.concat(F.lit("Source: [["), book, F.lit("#"), _known(F.col("chapter_title")), F.lit("]]"))
    blank = F.lit("")
    return F.concat_ws("\n", head, blank, quote, blank, link, blank, F.lit("---"), blank)


def note_header(query: Column, now: Column, hits: Column) -> Column:
    stamp = F.concat(F.lit("*Generated "), F.date_format(now, "yyyy-MM-dd HH:mm"), F.lit(" | "),
                     hits.cast("string"), F.lit(" results*"))
    blank = F.lit("")
    return F.concat_ws("\n", F.concat(F.lit("# Query: "), query), stamp, blank, F.lit("---"), blank)


def note_file_name(query: Column, now: Column) -> Column:
    return F.concat_ws("-", query_slug(query), F.date_format(now, "yyyyMMdd"))


def notes(results: DataFrame, query: str, now: Column) -> DataFrame:
    """One row (filename, content) for a result list of at most k rows."""
    sections = results.select("place", note_section(results, F.col("place")).alias("section"))
    folded = sections.agg(F.array_sort(F.collect_list(F.struct("place", "section"))).alias("s"))
    body = F.concat(F.array(note_header(F.lit(query), now, F.size("s"))),
                    F.transform("s", lambda x: x["section"]))
    return folded.select(note_file_name(F.lit(query), now).alias("filename"),
                         F.array_join(body, "\n").alias("content"))
