"""Checks of chapters, paragraphs, chunks and book records."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import chunk_table, structure as S
from shelfmark.plans.checks.registry import (
    MD_SQL, SP, check, d_clean_heading, d_paragraphs, d_strip, d_tokens, documents, md_text,
)
from shelfmark.schemas import CHILD_TOKENS, OVERLAP_TOKENS, PARENT_TOKENS

# Chapters: cut before every heading, number them, add up the lengths before each.
CHAPTERS_SQL = MD_SQL + r""",
cut as (
  select doc_id, book_id, author, title,
         list_transform(string_split(text, chr(10) || '# '), lambda p, i: case when i = 1 then p else '# ' || p end) as ps
  from books),
numbered as (
  select doc_id, book_id, author, title, unnest(range(1, len(ps) + 1)) as n, unnest(ps) as text from cut),
offsets as (
  select *, sum(length(text) + 1) over (partition by doc_id order by n) - length(text) - 1 as char_start from numbered),
chapters as (
  select doc_id, book_id, author, title, cast(n as int) as chapter_number, text, cast(char_start as bigint) as char_start,
         case when starts_with(text, '# ') and STRIPPED <> '' then STRIPPED else 'Untitled' end as chapter_title
  from offsets)
""".replace("STRIPPED", d_strip("substr(string_split(text, chr(10))[1], 3)"))


def greedy_sql(source: str, key: str, out: str, target: int, overlap: int) -> str:
    """Recursive form of the token-budget chunker over paragraph prefix sums.

    A chunk is a run of paragraphs; it closes before the paragraph that would
    exceed the target, and the next one starts at the earliest paragraph whose
    tokens up to there fit the overlap.
    """
    return f"""
{out}_p as (
  select {key}, ps, list_transform(ps, lambda p: {d_tokens('p')}) as ns, list_transform(ps, lambda p: length(p) + 2) as ws
  from (select {key}, {d_paragraphs('text')} as ps from {source}) where len(ps) > 0),
{out}_s as (
  select {key}, unnest(range(1, len(ps) + 1)) as i, unnest(ns) as n, unnest(ws) as w from {out}_p),
{out}_c as (
  select {key}, i, sum(n) over (partition by {key} order by i) as tok, sum(w) over (partition by {key} order by i) - w as pos
  from {out}_s),
{out}_q as (
  select {key}, list(tok order by i) as tok, list(pos order by i) as pos from {out}_c group by {key}),
{out}_r(key, i, st, c) as (
  select {key}, 1, 1, 0 from {out}_q
  union all
  select r.key, r.i + 1,
         case when q.tok[r.i + 1] - (case when r.st = 1 then 0 else q.tok[r.st - 1] end) > {target}
              then coalesce(list_filter(range(r.st, r.i + 1), lambda j: q.tok[r.i] - (case when j = 1 then 0 else q.tok[j - 1] end) <= {overlap})[1], r.i + 1)
              else r.st end,
         case when q.tok[r.i + 1] - (case when r.st = 1 then 0 else q.tok[r.st - 1] end) > {target} then r.c + 1 else r.c end
  from {out}_r r join {out}_q q on r.key = q.{key} where r.i < len(q.tok)),
{out}_g as (
  select key, c, min(st) as st, max(i) as en from {out}_r group by key, c),
{out} as (
  select g.key as {key}, cast(g.c as int) as c, array_to_string(p.ps[g.st:g.en], chr(10) || chr(10)) as text, cast(q.pos[g.st] as bigint) as off
  from {out}_g g join {out}_p p on g.key = p.{key} join {out}_q q on g.key = q.{key})
"""


@check("chk_2_chapters", "with " + CHAPTERS_SQL + "select book_id, chapter_number, chapter_title, char_start, text from chapters")
def chapters(spark, sf):
    ch = md_text(spark, sf).select("book_id", F.posexplode(S.chapters(F.col("text"))).alias("i", "c"))
    return ch.select("book_id", (F.col("i") + 1).alias("chapter_number"), F.col("c.title").alias("chapter_title"),
                     F.col("c.char_start").alias("char_start"), F.col("c.text").alias("text"))


@check("rnk_9_chapter_numbers", "with " + CHAPTERS_SQL + f"select book_id, chapter_number from chapters where len({d_paragraphs('text')}) > 0")
def chapter_numbers(spark, sf):
    """Numbers count every chapter; empty ones drop out afterwards and leave gaps."""
    ch = md_text(spark, sf).select("book_id", F.posexplode(S.chapters(F.col("text"))).alias("i", "c"))
    return ch.where(F.size(S.paragraphs(F.col("c.text"))) > 0).select("book_id", (F.col("i") + 1).alias("chapter_number"))


@check("chk_3_paragraphs", "with " + MD_SQL + "select book_id, unnest(range(0, len(ps))) as n, unnest(ps) as paragraph from "
       f"(select book_id, {d_paragraphs('text')} as ps from books)")
def paragraphs(spark, sf):
    """Paragraph split; blank and unstripped pieces (FLT-9) drop out."""
    p = md_text(spark, sf).select("book_id", F.posexplode(S.paragraphs(F.col("text"))).alias("n", "paragraph"))
    return p.select("book_id", F.col("n").cast("bigint").alias("n"), "paragraph")


def _chunk_rows(spark, sf, target, overlap):
    c = md_text(spark, sf).select("doc_id", F.posexplode(
        S.chunks(S.paragraphs(F.col("text")), target, overlap)).alias("c", "k"))
    return c.select("doc_id", "c", F.col("k.text").alias("text"), F.col("k.char_start_offset").alias("off"))


@check("chk_4_chunks", "with recursive " + MD_SQL + "," + greedy_sql("books", "doc_id", "chunks", 120, 0) + "select doc_id, c, text, off from chunks")
def chunks_plain(spark, sf):
    return _chunk_rows(spark, sf, 120, 0)


@check("chk_4_chunks_overlap", "with recursive " + MD_SQL + "," + greedy_sql("books", "doc_id", "chunks", 60, 20) + "select doc_id, c, text, off from chunks")
def chunks_overlap(spark, sf):
    return _chunk_rows(spark, sf, 60, 20)


@check("chk_4_chunk_table", "with recursive " + MD_SQL + "," + greedy_sql("books", "doc_id", "chunks", 60, 20) + "select doc_id, c, text, off from chunks")
def chunks_as_table(spark, sf):
    """The same chunks from the table function, called from SQL."""
    chunk_table.register(spark)
    md_text(spark, sf).select("doc_id", "text").createOrReplaceTempView("shelfmark_books")
    rows = spark.sql("select * from chunk_text(table(shelfmark_books), 'text', 60, 20)")
    return rows.select("doc_id", F.col("chunk").alias("c"), F.col("chunk_text").alias("text"), F.col("char_start_offset").alias("off"))


PARENTS_SQL = CHAPTERS_SQL + ", keyed as (select *, book_id || '::ch' || chapter_number as k from chapters)," + greedy_sql(
    "keyed", "k", "pc", PARENT_TOKENS, 0) + """,
parents as (
  select k.k || '::parent' || p.c as id, k.book_id, k.author, k.title, k.chapter_number, k.chapter_title, p.c as parent_index,
         k.char_start + greatest(0, p.off) as char_start, k.char_start + greatest(0, p.off) + length(p.text) as char_end, p.text
  from pc p join keyed k on p.k = k.k)
"""


@check("chk_5_parents", "with recursive " + PARENTS_SQL + "select * from parents")
def parents(spark, sf):
    """Parent records with ids, indices and character spans (CHK-7, RNK-10)."""
    return S.build_parents(md_text(spark, sf))


@check("chk_5_children", "with recursive " + PARENTS_SQL + "," + greedy_sql("parents", "id", "cc", CHILD_TOKENS, OVERLAP_TOKENS) + """
select c.id || '::child' || c.c as id, c.id as parent_id, p.book_id, p.author, c.c as chunk_index, c.text,
       'Author: ' || p.author || ' | Title: ' || p.title || ' | Chapter: ' || p.chapter_title || chr(10) || chr(10) || c.text as context_text
from cc c join parents p on c.id = p.id""")
def children(spark, sf):
    """Child records with their context prefix (CHK-6)."""
    return S.build_children(S.build_parents(md_text(spark, sf)))


@check("agg_3_book_counts", "with recursive " + PARENTS_SQL + "," + greedy_sql("parents", "id", "cc", CHILD_TOKENS, OVERLAP_TOKENS) + """
select p.book_id, count(distinct p.id) as parents, count(*) as children from parents p join cc c on c.id = p.id group by p.book_id""")
def book_counts(spark, sf):
    """Parents and children per book from one pass: additive counts, no distinct."""
    p = S.build_parents(md_text(spark, sf))
    c = S.build_children(p)
    return c.groupBy("book_id").agg(
        F.sum(F.when(F.col("chunk_index") == 0, 1).otherwise(0)).alias("parents"), F.count("*").alias("children"))


# H1 dividers and H2 chapters planted at the lines of each document.
LEVELED = ("concat(case when doc_id % 3 = 0 then concat('# Part ', cast(doc_id as varchar(20)), chr(10)) "
           "when doc_id % 3 = 1 then concat('# [Intro]{.x}', chr(10)) else '' end, "
           "case when doc_id % 2 = 0 then '## Chapter 0' else '## Notes' end, chr(10), "
           "replace(text, chr(10), concat(chr(10), case when doc_id % 2 = 0 then '## Chapter 1 ' else '## ' end)))")


def leveled(spark, sf):
    return documents(spark, sf).select("doc_id", F.expr(LEVELED).alias("text"))


H1 = "regexp_extract_all(text, '(?m)^# (.+)$', 1)"
H2 = "regexp_extract_all(text, '(?m)^## (.+)$', 1)"
PART = rf"(?i)^[IVX]+[\.{SP}]|part[{SP}]|preliminar|appendix|glossary|reference|notes[{SP}]+for"
CHAP = rf"(?i)chapter|ch\.[{SP}]*\p{{Nd}}|^[{SP}]*\p{{Nd}}+[\.\):]"
LEVEL_SQL = (
    f"with t as (select doc_id, {LEVELED} as text from documents), heads as (select doc_id, text, {H1} as h1, {H2} as h2 from t), "
    "counts as (select doc_id, text, cast(len(h1) as int) as h1, cast(len(h2) as int) as h2, "
    f"cast(len(list_filter(h1, lambda h: regexp_matches({d_clean_heading('h')}, '{PART}'))) as int) as h1_part, "
    f"cast(len(list_filter(h2, lambda h: regexp_matches({d_clean_heading('h')}, '{CHAP}'))) as int) as h2_chapter from heads), "
    "levels as (select *, case when h2 = 0 then 1 when (h2_chapter >= h2 * 0.4 and h1_part >= h1 * 0.3) or (h2 > h1 * 2 and h2_chapter >= 3) then 2 else 1 end as level from counts) ")


@check("agg_10_heading_counts", LEVEL_SQL + "select doc_id, h1, h2, h1_part, h2_chapter from levels")
def heading_counts(spark, sf):
    return leveled(spark, sf).select("doc_id", S.heading_counts(F.col("text")).alias("n")).select("doc_id", "n.*")


@check("chk_8_chapter_level", LEVEL_SQL + "select doc_id, level from levels")
def chapter_level(spark, sf):
    return leveled(spark, sf).select("doc_id", S.chapter_level(F.col("text")).alias("level"))


@check("chk_9_chapters_at_level", LEVEL_SQL + """, cut as (
  select doc_id, unnest(list_transform(string_split(chr(10) || text, chr(10) || m), lambda p, i: {i: i, t: m || p})) as u, m from (
    select doc_id, text, case when level = 2 then '## ' else '# ' end as m from levels)),
parts as (select doc_id, u.t as text, string_split(u.t, chr(10))[1] as head, m from cut where u.i > 1)
select doc_id, """ + d_strip("substr(head, length(m) + 1)") + " as heading, text from parts where "
       + d_clean_heading(d_strip("substr(head, length(m) + 1)")) + " <> '' and length(text) - length(head) > 200")
def chapters_at_level(spark, sf):
    """Level-aware split; preamble and spacer chapters (FLT-10) drop out."""
    t = leveled(spark, sf)
    c = t.select("doc_id", F.explode(S.chapters_at(F.col("text"), S.chapter_level(F.col("text")))).alias("c"))
    return c.select("doc_id", "c.heading", "c.text")
