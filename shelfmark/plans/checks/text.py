"""Checks of scalar text, number and formatting functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import render, text as X
from shelfmark.functions.numbers import round_exact
from shelfmark.plans.checks.registry import (
    SP, WORD, check, d_clean_heading, d_squeeze, d_strip, d_sub, d_title, d_tokens, documents, quote, table,
)

# A file name per document, shared by both engines: mixed case, brackets, marks.
NAME = ("concat(source, ' - ', upper(lang), ' ', replace(text, chr(10), ' '), '!_', "
        "case when doc_id % 3 = 0 then ' (2020)' else '' end, "
        "case when doc_id % 4 = 0 then '.EPUB' when doc_id % 4 = 1 then '.pdf' when doc_id % 4 = 2 then '.txt' else '' end)")


def names(spark, sf):
    return documents(spark, sf).select("doc_id", F.expr(NAME).alias("name"), "text", "lang", "source")


NAMES_SQL = f"with named as (select doc_id, {NAME} as name, text, lang, source from documents) "
D_STEM = "regexp_replace(regexp_extract(name, '([^/]*)$', 1), '(?s)^(.+)\\.[^.]+$', '\\1')"
D_SUFFIX = "lower(regexp_extract(name, '(?s).(\\.[^./]+)$', 1))"


@check("txt_14_book_slug", NAMES_SQL + "select doc_id, trim(" + d_sub(d_sub(d_sub(
    d_strip("lower(" + d_sub(D_STEM, rf"[{SP}]*\(.*?\)[{SP}]*$") + ")"),
    rf"[^{WORD}{SP}-]"), rf"[{SP}_]+", "-"), "-+", "-") + ", '-') as slug from named")
def book_slug(spark, sf):
    return names(spark, sf).select("doc_id", X.book_slug(F.col("name")).alias("slug"))


@check("txt_15_query_slug", "with q as (select item_id as id, text from benchmark union all select doc_id + 1000000, text from documents) "
       "select id, rtrim(left(" + d_sub(d_sub(d_strip("lower(text)"), rf"[^{WORD}{SP}-]"), rf"[{SP}_]+", "-")
       + ", 60), '-') as slug from q")
def query_slug(spark, sf):
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    both = bench.unionByName(documents(spark, sf).select((F.col("doc_id") + 1000000).alias("id"), "text"))
    return both.select("id", X.query_slug(F.col("text")).alias("slug"))


BOOK_ID = "concat(lower(lang), case when doc_id % 5 = 0 then '' else '-' end, replace(lower(text), ' ', '-'))"


@check("txt_16_slug_names", f"with b as (select doc_id, {BOOK_ID} as book_id from documents) select doc_id, "
       + d_title("string_split(book_id, '-')[1]") + " as author, case when instr(book_id, '-') > 0 then "
       + d_title("replace(substr(book_id, instr(book_id, '-') + 1), '-', ' ')") + " else book_id end as title from b")
def slug_names(spark, sf):
    b = documents(spark, sf).select("doc_id", F.expr(BOOK_ID).alias("book_id"))
    return b.select("doc_id", X.slug_author(F.col("book_id")).alias("author"),
                    X.slug_title(F.col("book_id")).alias("title"))


@check("txt_13_clean_heading", "with h as (select doc_id, '[' || text || ']{.title}  x' || chr(9) || ' {#a' || doc_id || '}' as h from documents) "
       "select doc_id, " + d_clean_heading("h") + " as heading from h")
def clean_heading(spark, sf):
    h = F.concat(F.lit("["), F.col("text"), F.lit("]{.title}  x\t {#a"), F.col("doc_id"), F.lit("}"))
    return documents(spark, sf).select("doc_id", X.clean_heading(h).alias("heading"))


@check("txt_17_previews", "select doc_id, replace(left(text, 300), chr(10), ' ') as pretty, left("
       + d_strip("text") + ", 500) || case when length(" + d_strip("text")
       + ") > 500 then '...' else '' end as note from documents")
def previews(spark, sf):
    return documents(spark, sf).select("doc_id", X.pretty_preview(F.col("text")).alias("pretty"),
                                       X.notes_preview(F.col("text")).alias("note"))


@check("txt_18_safe_file_name", "select doc_id, case when s = '' then 'output.epub' else s || '.epub' end as file_name from (select doc_id, "
       + d_strip(d_sub("case when doc_id % 7 = 0 then '!?' else text end", r"[^\p{L}\p{N} _-]")) + " as s from documents)")
def safe_file_name(spark, sf):
    title = F.expr("case when doc_id % 7 = 0 then '!?' else text end")
    return documents(spark, sf).select("doc_id", X.safe_file_name(title).alias("file_name"))


@check("txt_19_suffix", NAMES_SQL + f"select doc_id, {D_SUFFIX} as suffix, {D_STEM} as stem from named")
def name_suffix(spark, sf):
    return names(spark, sf).select("doc_id", X.suffix(F.col("name")).alias("suffix"),
                                   X.stem(F.col("name")).alias("stem"))


@check("txt_20_delivery_label", "select doc_id, case when doc_id % 2 = 0 then source else source || ' — ' || lang end as label from documents")
def delivery_label(spark, sf):
    author = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))
    return documents(spark, sf).select("doc_id", X.delivery_label(F.col("source"), author).alias("label"))


FENCED = ("case when doc_id % 4 = 0 then '```markdown' || chr(10) || text || chr(10) || '```' "
          "when doc_id % 4 = 1 then '``` ' || text when doc_id % 4 = 2 then text || ' ```' else text end")


@check("txt_22_code_fences", f"with f as (select doc_id, {FENCED} as t from documents), "
       "a as (select doc_id, case when starts_with(t, '```markdown') then " + d_strip("substr(t, 12)") + " else t end as t from f), "
       "b as (select doc_id, case when starts_with(t, '```') then " + d_strip("substr(t, 4)") + " else t end as t from a) "
       "select doc_id, case when ends_with(t, '```') then " + d_strip("left(t, length(t) - 3)") + " else t end as body from b")
def code_fences(spark, sf):
    return documents(spark, sf).select("doc_id", X.strip_code_fences(F.expr(FENCED)).alias("body"))


@check("txt_23_has_h1", "select doc_id, starts_with(t, '# ') or contains(t, chr(10) || '# ') as has_h1 from "
       "(select doc_id, case when doc_id % 2 = 0 then replace(text, chr(10), chr(10) || '# ') else text end as t from documents)")
def has_h1(spark, sf):
    t = F.expr("case when doc_id % 2 = 0 then replace(text, chr(10), chr(10) || '# ') else text end")
    return documents(spark, sf).select("doc_id", X.starts_with_heading(t).alias("has_h1"))


@check("txt_24_sha256", "select doc_id, sha256(text) as sha256 from documents")
def sha256(spark, sf):
    return documents(spark, sf).select("doc_id", X.sha256_hex(F.col("text")).alias("sha256"))


@check("txt_25_base64", "select page_id, base64(encode(html)) as body from pages")
def base64(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.base64_text(F.col("html").cast("binary")).alias("body"))


@check("flt_4_escape_literal", "select doc_id, replace(replace(text, ' ', ''''), '''', '''''') as escaped from documents")
def escape_literal(spark, sf):
    quoted = F.replace(F.col("text"), F.lit(" "), F.lit("'"))
    return documents(spark, sf).select("doc_id", X.escape_literal(quoted).alias("escaped"))


@check("chk_1_token_count", f"select doc_id, cast({d_tokens('text')} as bigint) as tokens from documents")
def token_count(spark, sf):
    return documents(spark, sf).select("doc_id", X.whitespace_token_count(F.col("text")).cast("bigint").alias("tokens"))


@check("mth_1_half_even", "select event_id, cast(printf('%.1f', value) as double) as v1, cast(printf('%.3f', value / 7) as double) as v3 from events")
def half_even(spark, sf):
    return table(spark, sf, "events").select("event_id", round_exact(F.col("value"), 1).alias("v1"),
                                             round_exact(F.col("value") / 7, 3).alias("v3"))


RESULT_SQL = ("with r as (select doc_id, cast(doc_id as varchar) as id, source as book_id, lang as author, "
              "case when doc_id % 3 = 0 then null else 'T' || doc_id end as title, cast(doc_id % 9 as int) as chapter_number, "
              "case when doc_id % 4 = 0 then null else 'C ' || lang end as chapter_title, text, doc_id * 10 as char_start, "
              "doc_id * 10 + n_chars as char_end, case when doc_id % 5 = 0 then 0.0 else n_chars / 4096.0 end as _rrf_score, "
              "n_chars / 1024.0 as _score from documents), s as (select *, cast(coalesce(nullif(_rrf_score, 0), _score, 0) as double) as score from r) ")


def results(spark, sf):
    """Every document as a result row; the scores are exact binary fractions."""
    return documents(spark, sf).select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("book_id"), F.col("lang").alias("author"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("T"), "doc_id")).alias("title"),
        (F.col("doc_id") % 9).cast("int").alias("chapter_number"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("C "), "lang")).alias("chapter_title"), "text",
        (F.col("doc_id") * 10).alias("char_start"), (F.col("doc_id") * 10 + F.col("n_chars")).alias("char_end"),
        F.when(F.col("doc_id") % 5 == 0, 0.0).otherwise(F.col("n_chars") / 4096.0).alias("_rrf_score"),
        (F.col("n_chars") / 1024.0).alias("_score"))


@check("flt_13_score_fallback", RESULT_SQL + "select doc_id, score from s")
def score_fallback(spark, sf):
    r = results(spark, sf)
    return r.select("doc_id", render.score(r).alias("score"))


@check("fmt_1_pretty", RESULT_SQL + "select doc_id, '[' || printf('%.4f', score) || '] ' || author || ' — ' || coalesce(title, book_id) || ', Ch. ' "
       "|| chapter_number || ': ' || coalesce(chapter_title, '?') || chr(10) || '  ' || replace(left(text, 300), chr(10), ' ') || '...' "
       "|| chr(10) || '  → markdown/' || book_id || '.md' || chr(10) as line from s")
def pretty(spark, sf):
    r = results(spark, sf)
    return r.select("doc_id", render.pretty(r).alias("line"))


@check("fmt_2_json_fields", RESULT_SQL + "select score, book_id, author, title, chapter_number, chapter_title, text, char_start, char_end, id as parent_id from s")
def json_fields(spark, sf):
    """The record projection of the JSON output, one row per result."""
    r = results(spark, sf)
    return r.select(*render.json_fields(r))


@check("fmt_2_json", RESULT_SQL + "select doc_id, json_extract_string(j, '$.parent_id') as parent_id, json_extract_string(j, '$.title') as title, "
       "json_extract_string(j, '$.text') as text, cast(json_extract(j, '$.score') as double) as score, "
       "'score,book_id,author,title,chapter_number,chapter_title,text,char_start,char_end,parent_id' as names from ("
       "select doc_id, to_json({score: score, title: title, text: text, parent_id: id}) as j from s)")
def json_object(spark, sf):
    """The JSON text of each result, read back: names, order and values survive."""
    r = results(spark, sf)
    j = r.select("doc_id", render.json_object(r).alias("j"))
    return j.select("doc_id", *[F.get_json_object("j", f"$.{n}").alias(n) for n in ("parent_id", "title", "text")],
                    F.get_json_object("j", "$.score").cast("double").alias("score"),
                    F.array_join(F.json_object_keys("j"), ",").alias("names"))


@check("fmt_3_note_section", RESULT_SQL + "select doc_id, '## ' || (doc_id + 1) || '. (' || printf('%.4f', score) || ') ' || author || ' — *' || coalesce(title, book_id) "
       "|| '*, Ch. ' || chapter_number || chr(10) || chr(10) || '> ' || left(" + d_strip("text") + ", 500) || case when length("
       + d_strip("text") + ") > 500 then '...' else '' end || chr(10) || chr(10) || 'Source: [[' || book_id || '#' || coalesce(chapter_title, '?') || ']]' "
       "|| chr(10) || chr(10) || '---' || chr(10) as section from s")
def note_section(spark, sf):
    r = results(spark, sf)
    return r.select("doc_id", render.note_section(r, F.col("doc_id") + 1).alias("section"))


@check("fmt_4_note_header", "select event_id, '# Query: ' || event_type || chr(10) || '*Generated ' || strftime(ts, '%Y-%m-%d %H:%M') || ' | ' || (event_id % 7) "
       "|| ' results*' || chr(10) || chr(10) || '---' || chr(10) as header, event_type || '-' || strftime(ts, '%Y%m%d') as filename from events")
def note_header(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", render.note_header(F.col("event_type"), F.col("ts"), F.col("event_id") % 7).alias("header"),
                    render.note_file_name(F.col("event_type"), F.col("ts")).alias("filename"))
