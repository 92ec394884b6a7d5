"""Checks of book maps: metadata, prompts, assembly, validation, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import truncate_for_map
from shelfmark.operators import bookmaps as B
from shelfmark.plans.checks.registry import check, d_clean_heading, d_strip, d_title, documents, table
from shelfmark.plans.checks.structure import LEVEL_SQL, LEVELED

BOOK = "concat(source, '-', lang, '-', cast(doc_id as varchar(20)))"
BOOKS_SQL = f"books as (select doc_id, {BOOK} as book_id, text from documents)"
MAPS_SQL = ("maps as (select source || '-' || lang || '-' || doc_id as id, case when toxic = 1 then null else upper(lang) end as author, "
            "case when quality = 0 then null else 'The ' || source end as title, text as summary, "
            "string_split(text, ' ') as key_themes from documents join labels using (doc_id))")


def books(spark, sf):
    return documents(spark, sf).select("doc_id", F.expr(BOOK).alias("book_id"), "text")


def maps(spark, sf):
    d = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.expr(BOOK).alias("id"), F.when(F.col("toxic") != 1, F.upper("lang")).alias("author"),
                    F.when(F.col("quality") != 0, F.concat(F.lit("The "), "source")).alias("title"),
                    F.col("text").alias("summary"), F.split("text", " ", -1).alias("key_themes"))


@check("src_5_book_metadata", f"with {BOOKS_SQL}, {MAPS_SQL} select doc_id, b.book_id, case when m.id is not null then coalesce(m.author, 'Unknown') else "
       + d_title("string_split(b.book_id, '-')[1]") + " end as author, case when m.id is not null then coalesce(m.title, b.book_id) else "
       + d_title("replace(substr(b.book_id, instr(b.book_id, '-') + 1), '-', ' ')") + " end as title from books b left join maps m on m.id = b.book_id")
def metadata(spark, sf):
    """Author and title from the map, else from the book id (JON-3)."""
    return B.book_metadata(books(spark, sf).select("doc_id", "book_id"), maps(spark, sf))


@check("jon_8_delivery_metadata", f"with {BOOKS_SQL}, {MAPS_SQL} select doc_id, case when m.id is not null then coalesce(m.title, 'file ' || doc_id) else 'file ' || doc_id end as title, "
       "coalesce(m.author, '') as author, coalesce(m.summary, '') as description, coalesce(array_to_string(m.key_themes[1:5], '|'), '') as subjects from books b left join maps m on m.id = b.book_id")
def delivery_metadata(spark, sf):
    staged = books(spark, sf).select("doc_id", "book_id", F.concat(F.lit("file "), "doc_id").alias("fallback_title"))
    return B.delivery_metadata(staged, maps(spark, sf)).select(
        "doc_id", "title", "author", "description", F.array_join("subjects", "|").alias("subjects"))


@check("snk_14_delivery_route", f"with {BOOKS_SQL}, {MAPS_SQL}, j as (select doc_id, coalesce(m.title, 'file ' || doc_id) as title, coalesce(m.author, '') as author, doc_id % 2 = 0 as epub from books b left join maps m on m.id = b.book_id), "
       "s as (select *, " + d_strip("regexp_replace(title, '[^\\p{L}\\p{N} _-]', '', 'g')") + " as kept from j) "
       "select doc_id, case when epub then 'original' else 'rebuilt' end as route, case when epub then 'source.epub' when kept = '' then 'output.epub' else kept || '.epub' end as file_name, "
       "case when author = '' then title else title || ' — ' || author end as subject from s")
def delivery_route(spark, sf):
    """What is sent for every book: the original EPUB or one rebuilt from the text."""
    from shelfmark.operators.delivery import route
    staged = books(spark, sf).select("doc_id", "book_id", F.concat(F.lit("file "), "doc_id").alias("fallback_title"),
                                     F.when(F.col("doc_id") % 2 == 0, "epub").otherwise("pdf").alias("file_type"))
    return route(B.delivery_metadata(staged, maps(spark, sf))).select("doc_id", "route", "file_name", "subject")


@check("chk_10_truncated", "select doc_id, left(t, 100000) || chr(10) || chr(10) || '[...truncated...]' as t from (select doc_id, repeat(text, 40) as t from documents)")
def truncated(spark, sf):
    """Truncation of long books that have no chapters."""
    long = F.repeat("text", F.lit(40))
    return documents(spark, sf).select("doc_id", truncate_for_map(long, 100_000).alias("t"))


@check("txt_27_chapter_prompts", LEVEL_SQL + """, cut as (
  select doc_id, unnest(list_transform(string_split(chr(10) || text, chr(10) || m), lambda p, i: {i: i, t: m || p})) as u, m from (
    select doc_id, text, case when level = 2 then '## ' else '# ' end as m from levels)),
parts as (select doc_id, u.i as i, u.t as text, """ + d_strip("substr(string_split(u.t, chr(10))[1], length(m) + 1)") + """ as heading, string_split(u.t, chr(10))[1] as head from cut where u.i > 1),
kept as (select *, row_number() over (partition by doc_id order by i) as number from parts where """ + d_clean_heading("heading") + """ <> '' and length(text) - length(head) > 200)
select doc_id, cast(number as int) as number, 'Describe one chapter as JSON.' || chr(10) || 'Number ' || number || ', titled: ' || """ + d_clean_heading("heading")
       + " || chr(10) || 'Its text follows.' || chr(10) || chr(10) || text as prompt from kept")
def chapter_prompts(spark, sf):
    """Prompt of every chapter, numbered over the kept chapters."""
    from shelfmark.operators import structure as S
    t = documents(spark, sf).select("doc_id", F.expr(LEVELED).alias("text"))
    c = t.select("doc_id", F.posexplode(S.chapters_at(F.col("text"), S.chapter_level(F.col("text")))).alias("i", "c"))
    return c.select("doc_id", (F.col("i") + 1).alias("number"),
                    B.chapter_prompt(F.col("i") + 1, F.col("c.heading"), F.col("c.text")).alias("prompt"))


@check("txt_27_book_prompt", "select doc_id, 'Map this book as JSON.' || chr(10) || 'Book id: doc' || doc_id || chr(10) || 'Its text follows.' || chr(10) || chr(10) || text as prompt from documents")
def book_prompt(spark, sf):
    return documents(spark, sf).select("doc_id", B.book_prompt(F.concat(F.lit("doc"), "doc_id"), F.col("text")).alias("prompt"))


CALLS_SQL = ("lines as (select doc_id, lang, unnest(string_split(text, chr(10))) as text, unnest(range(0, len(string_split(text, chr(10))))) as number from documents), "
             "calls as (select *, length(text) as prompt_tokens, length(lang) as completion_tokens from lines)")


@check("jsn_2_assembled_maps", f"with {CALLS_SQL} select 'doc' || doc_id as id, coalesce(max(case when number = 0 and length(text) % 2 = 0 then lang end), 'Unknown') as author, "
       "'doc' || doc_id as title, 'source/doc' || doc_id || '.epub' as source_epub, 'markdown/doc' || doc_id || '.md' as source_md, "
       "coalesce(max(case when number = 0 then text end), '') as summary, "
       "string_agg(case when number > 0 then number || ':' || case when length(text) % 3 = 0 then '[Error: boom]' else text end end, '|' order by number) as chapters, "
       "cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens from calls group by doc_id")
def assembled(spark, sf):
    """Answers of all calls of a book put together: defaults, placeholders, chapter order (JSN-3, JSN-5, RNK-13)."""
    c = documents(spark, sf).select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    n = F.col("n")
    overview = F.to_json(F.struct(F.when(F.length("text") % 2 == 0, F.col("lang")).alias("author"), F.col("text").alias("summary")))
    chapter = F.to_json(F.struct(F.lit("t").alias("title"), F.col("text").alias("summary")))
    failed = (n > 0) & (F.length("text") % 3 == 0)
    answers = c.select(
        F.concat(F.lit("doc"), "doc_id").alias("book_id"), F.when(n == 0, "overview").otherwise("chapter").alias("kind"),
        n.alias("number"), F.lit("h").alias("heading"), F.when(~failed, F.when(n == 0, overview).otherwise(chapter)).alias("answer"),
        F.when(failed, "boom").alias("error"), F.length("text").cast("bigint").alias("prompt_tokens"),
        F.length("lang").cast("bigint").alias("completion_tokens"))
    m = B.assemble(answers)
    listed = F.array_join(F.transform("chapters", lambda ch: F.concat(ch["number"], F.lit(":"), ch["summary"])), "|")
    return m.select("id", "author", "title", "source_epub", "source_md", "summary",
                    F.when(F.size("chapters") > 0, listed).alias("chapters"), "prompt_tokens", "completion_tokens")


MAP_JSON = ("concat('{', case when n_chars % 3 = 0 then '' else '\"author\":\"a\",' end, case when n_chars % 5 = 0 then '' else '\"title\":\"t\",' end, "
            "case when n_chars % 7 = 0 then '' else '\"summary\":\"\",' end, case when n_chars % 2 = 0 then '' else '\"key_themes\":[],' end, "
            "case when n_chars % 11 = 0 then '\"x\":1}' when n_chars % 11 = 1 then '\"chapters\":\"none\"}' when n_chars % 11 = 2 then '\"chapters\":[]}' "
            "when n_chars % 11 < 6 then '\"chapters\":[{\"title\":\"\",\"key_arguments\":[\"k\"]},{\"title\":\"b\",\"key_arguments\":[]}]}' "
            "else '\"chapters\":[{\"title\":\"a\",\"key_arguments\":[\"k\"]},{\"number\":2}]}' end)")


@check("jsn_4_map_warnings", f"with j as (select doc_id, {MAP_JSON} as j from documents), "
       "k as (select doc_id, json_keys(j) as ks, json_type(j, '$.chapters') as ct, case when json_type(j, '$.chapters') = 'ARRAY' then json_extract(j, '$.chapters[*]') else []::json[] end as chs from j), "
       "w as (select doc_id, list_concat(list_transform(list_filter(['author', 'title', 'summary', 'key_themes', 'chapters'], lambda f: not list_contains(ks, f)), lambda f: 'missing ''' || f || ''''), "
       "list_concat(case when ct is null then [] when ct <> 'ARRAY' then ['''chapters'' is not a list'] when len(chs) = 0 then ['''chapters'' is empty'] else [] end, "
       "flatten(list_transform(chs, lambda c, i: list_filter([case when coalesce(json_extract_string(c, '$.title'), '') = '' then 'chapter ' || i || ' missing title' end, "
       "case when coalesce(json_array_length(c, '$.key_arguments'), 0) = 0 then 'chapter ' || i || ' missing key_arguments' end], lambda x: x is not null))))) as ws from k) "
       "select doc_id, array_to_string(ws, '; ') as warnings from w")
def map_warnings(spark, sf):
    """Missing fields and chapter faults of maps held as JSON text (JSN-1)."""
    return documents(spark, sf).select("doc_id", F.array_join(B.json_warnings(F.expr(MAP_JSON)), "; ").alias("warnings"))


@check("agg_5_token_cost", "select cast(sum(p) as bigint) as prompt_tokens, cast(sum(c) as bigint) as completion_tokens, round(sum(p) / 1e6 * 0.10 + sum(c) / 1e6 * 0.20, 9) as cost from "
       "(select cast(floor(value * 100) as bigint) as p, user_id as c from events)")
def token_cost(spark, sf):
    """Tokens and price over the usage of every call (JSN-6)."""
    u = table(spark, sf, "events").select(F.floor(F.col("value") * 100).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return B.token_cost(u).withColumn("cost", F.round("cost", 9))
