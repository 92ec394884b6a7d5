"""Checks of the keyword index, vector ranking, fusion and retrieval modes.

Documents stand for parent chunks (book = source, author = language) and
embedding rows for their child chunks, two per parent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import render
from shelfmark.operators import fusion, keyword
from shelfmark.plans.checks.registry import check, d_words, documents, table
from shelfmark.session import shared_dir

QUERY = "The tion, thering der!"
K = 20

PARENTS_SQL = """parents as (
  select cast(doc_id as varchar) as id, source as book_id, lang as author, 'T ' || lang as title, cast(doc_id % 9 as int) as chapter_number,
         'C' || lang as chapter_title, doc_id as char_start, doc_id + n_chars as char_end, text from documents)"""
CHILDREN_SQL = """children as (
  select cast(vec_id as varchar) as id, cast(vec_id // 2 as varchar) as parent_id, 'src' || (vec_id // 2 % 20) as book_id,
         case when label % 2 = 0 then 'Even Author' else 'Odd_Author' end as author, embedding as vector from embeddings)"""


def parents(spark, sf, heavy=True):
    """Parents from documents; plain lookups skip the spreading that text work wants."""
    d = documents(spark, sf) if heavy else table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("book_id"), F.col("lang").alias("author"),
        F.concat(F.lit("T "), "lang").alias("title"), (F.col("doc_id") % 9).cast("int").alias("chapter_number"),
        F.concat(F.lit("C"), "lang").alias("chapter_title"), F.col("doc_id").alias("char_start"),
        (F.col("doc_id") + F.col("n_chars")).alias("char_end"), "text")


def children(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("id"), F.expr("cast(vec_id div 2 as string)").alias("parent_id"),
        F.expr("concat('src', vec_id div 2 % 20)").alias("book_id"),
        F.when(F.col("label") % 2 == 0, "Even Author").otherwise("Odd_Author").alias("author"),
        F.col("embedding").alias("vector"))


def query_vector(spark, sf):
    """The embedding of row 0 plays the embedded question."""
    row = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding]


def terms_sql(text: str) -> str:
    return f"(select distinct unnest({d_words(text)}) as term)"


def bm25_sql(terms: str, where: str = "true") -> str:
    return f"""
terms as (select term from {terms}),
words as (select id, len(ws) as dl, ws from (select id, {d_words('text')} as ws from parents)),
corpus as (select count(*) as n, avg(dl) as avgdl from words),
tf as (select id, dl, term, count(*) as tf from (select id, dl, unnest(ws) as term from words) where term in (select term from terms) group by id, dl, term),
df as (select term, count(*) as df from tf group by term),
scored as (
  select tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as _score
  from tf join df using (term), corpus where tf.id in (select id from parents where {where}) group by tf.id)"""


def nearest_sql(n: int, where: str = "true") -> str:
    return f"""
q as (select embedding::double[] as v from embeddings where vec_id = 0),
near as (
  select id, parent_id, power(list_distance(vector::double[], (select v from q)), 2) as _distance from children where {where}
  order by _distance, id limit {n}),
vlist as (select *, row_number() over (order by round(_distance, 12), id) as rn from near)"""


def keyword_list_sql(n: int) -> str:
    return f"""
klist as (select id, _score, row_number() over (order by round(_score, 9) desc, id) as rn from
  (select * from scored order by round(_score, 9) desc, id limit {n}))"""


def fused_sql(k: int) -> str:
    return f"""
votes as (select parent_id as id, 0 as src, rn from vlist union all select id, 1, rn from klist),
tally as (select id, sum(1.0::double / (60 + rn)) as _rrf_score, min(src * 1000000 + rn) as first from votes group by id),
top as (select *, row_number() over (order by round(_rrf_score, 12) desc, first) as place from tally
        order by round(_rrf_score, 12) desc, first limit {k})"""


QUERY_TERMS = terms_sql(f"'{QUERY}'")
BASE = f"with {PARENTS_SQL}, {CHILDREN_SQL}, {bm25_sql(QUERY_TERMS)}, {nearest_sql(2 * K)}, {keyword_list_sql(2 * K)}, {fused_sql(K)} "
PARENT_COLUMNS = "p.id, p.book_id, p.author, p.title, p.chapter_number, p.chapter_title, p.char_start, p.char_end, p.text"


def rounded(df, *names, digits=9):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


_indexes: dict[tuple[str, str], tuple] = {}


def build_index(spark, sf) -> str:
    """Write posting blocks, term and corpus statistics of the documents; returns their folder."""
    root = shared_dir(spark, "check-index")
    # every file is an index of its own documents, in order of terms; a frequent term is spread over all of them
    blocks = keyword.in_blocks(keyword.placed_postings(parents(spark, sf)))
    blocks.sortWithinPartitions("term", "block").write.parquet(f"{root}/blocks")
    keyword.block_stats(spark.read.parquet(f"{root}/blocks")).sort("term").write.parquet(f"{root}/terms")
    keyword.corpus_stats(parents(spark, sf)).write.parquet(f"{root}/corpus")
    return root


def stored_index(spark, sf):
    """Blocks, term and corpus statistics, stored once per session and data folder; the bench times the build by itself."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        root = build_index(spark, sf)
        _indexes[key] = tuple(spark.read.parquet(f"{root}/{name}") for name in ("blocks", "terms", "corpus"))
    return _indexes[key]


def ranked(spark, sf, question: str, n: int):
    """(id, _score, place) of the ``n`` best parents of one question."""
    asked = spark.createDataFrame([(0, question)], "qid int, text string")
    blocks, *rest = stored_index(spark, sf)
    # the terms are pushed to the scan as well
    wanted = blocks.where(F.col("term").isin(keyword.query_terms(question)))
    return keyword.BlockRanking(wanted, *rest, asked, n).best().drop("qid")


def lists(spark, sf, n=2 * K):
    near = fusion.numbered(fusion.nearest(children(spark, sf), query_vector(spark, sf), n), "_distance", "id")
    return parents(spark, sf, heavy=False), near, ranked(spark, sf, QUERY, n).withColumnRenamed("place", "rn")


@check("snk_2_postings", f"with {PARENTS_SQL} select id, term, cast(count(*) as int) as tf, cast(dl as int) as dl from "
       f"(select id, len(ws) as dl, unnest(ws) as term from (select id, {d_words('text')} as ws from parents)) group by id, term, dl")
def postings(spark, sf):
    return keyword.postings(parents(spark, sf), ("id",))


@check("snk_2_term_stats", f"with {PARENTS_SQL} select term, count(distinct id) as df from (select id, unnest({d_words('text')}) as term from parents) group by term")
def term_stats(spark, sf):
    return keyword.term_stats(keyword.postings(parents(spark, sf), ("id",)))


@check("agg_12_corpus_stats", f"with {PARENTS_SQL} select book_id, count(*) as n, cast(sum(len({d_words('text')})) as bigint) as total_dl from parents group by book_id")
def corpus_stats(spark, sf):
    return keyword.corpus_stats(parents(spark, sf), "book_id")


@check("rnk_5_bm25", f"with {PARENTS_SQL}, {bm25_sql(QUERY_TERMS)} select id, round(_score, 6) as _score from scored")
def bm25(spark, sf):
    """Scores of every matching parent, straight from the texts."""
    s = keyword.score_texts(parents(spark, sf), keyword.query_terms(QUERY))
    return rounded(s.select("id", "_score"), "_score", digits=6)


@check("rnk_5_bm25_postings", f"with {PARENTS_SQL}, {bm25_sql(QUERY_TERMS)} select id, round(_score, 6) as _score from scored")
def bm25_postings(spark, sf):
    """The same scores from the stored inverted index."""
    blocks, *rest = stored_index(spark, sf)
    s = keyword.score_postings(keyword.entries(blocks), *rest, keyword.query_terms(QUERY))
    return rounded(s, "_score", digits=6)


@check("rnk_5_block_max", f"with {PARENTS_SQL}, {bm25_sql(QUERY_TERMS)}, {keyword_list_sql(K)} select id, round(_score, 6) as _score, cast(rn as int) as place from klist")
def block_max(spark, sf):
    """The best of these scores, by bounds of posting blocks: blocks that cannot reach the list are not scored."""
    return rounded(ranked(spark, sf, QUERY, K), "_score", digits=6)


@check("snk_2_block_bounds", f"""with {PARENTS_SQL}, words as (select id, len(ws) as dl, unnest(ws) as term from (select id, {d_words('text')} as ws from parents)),
  tf as (select id, dl, term, count(*) as tf from words group by id, dl, term)
  select term, count(*) as n, cast(max(tf) as int) as max_tf, cast(min(dl) as int) as min_dl from tf group by term""")
def block_bounds(spark, sf):
    """What the blocks say of each term, over all of them."""
    blocks = stored_index(spark, sf)[0]
    return blocks.groupBy("term").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))


BENCH_TERMS = terms_sql("(select text from benchmark where item_id = 0)")


@check("rnk_6_keyword_mode", f"with {PARENTS_SQL}, {bm25_sql(BENCH_TERMS)}, {keyword_list_sql(K)} select {PARENT_COLUMNS}, round(_score, 6) as _score, "
       "cast(rn as int) as place from klist join parents p using (id)")
def keyword_mode(spark, sf):
    """Keyword mode with a whole benchmark item as the question."""
    question = table(spark, sf, "benchmark").where("item_id = 0").first().text
    top = ranked(spark, sf, question, K)
    return rounded(parents(spark, sf, heavy=False).join(fusion.small(top, K), "id"), "_score", digits=6)


ALL_QUESTIONS_SQL = f"""with {PARENTS_SQL},
asked as (select item_id as qid, unnest(list_distinct({d_words('text')})) as term from benchmark),
words as (select id, len(ws) as dl, ws from (select id, {d_words('text')} as ws from parents)),
corpus as (select count(*) as n, avg(dl) as avgdl from words),
tf as (select id, dl, term, count(*) as tf from (select id, dl, unnest(ws) as term from words) where term in (select term from asked) group by id, dl, term),
df as (select term, count(*) as df from tf group by term),
scored as (select qid, tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as _score
  from tf join df using (term) join asked using (term), corpus group by qid, tf.id)
select qid, id, round(_score, 6) as _score, cast(place as int) as place from
  (select *, row_number() over (partition by qid order by round(_score, 9) desc, id) as place from scored) where place <= {K}"""


@check("rnk_6_all_questions", ALL_QUESTIONS_SQL)
def all_questions(spark, sf):
    """Keyword mode with every benchmark item as a question, in one scan of the texts and with the stored statistics."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    _, *stored = stored_index(spark, sf)
    s = keyword.score_questions(parents(spark, sf), *stored, asked, K)
    return rounded(s, "_score", digits=6)


@check("flt_2_keyword_author_filter", f"with {PARENTS_SQL}, {bm25_sql(QUERY_TERMS, "lower(author) like '%e_%'")}, {keyword_list_sql(K)} "
       "select id, round(_score, 6) as _score from klist")
def keyword_author(spark, sf):
    """Author filter before the cut; the underscore is a wildcard."""
    s = keyword.score_texts(parents(spark, sf), keyword.query_terms(QUERY), author="E_")
    return rounded(keyword.top_scores(s.select("id", "_score"), K), "_score", digits=6)


@check("flt_1_book_filter", f"with {PARENTS_SQL} select id, book_id, author from parents where book_id = 'src3'")
def book_filter(spark, sf):
    return keyword.apply_filters(parents(spark, sf), book_id="src3").select("id", "book_id", "author")


@check("flt_2_author_filter", f"with {CHILDREN_SQL} select id, author from children where lower(author) like '%d_a%'")
def author_filter(spark, sf):
    return keyword.apply_filters(children(spark, sf), author="D_A").select("id", "author")


@check("flt_3_both_filters", f"with {CHILDREN_SQL}, {nearest_sql(K, "book_id = 'src7' and lower(author) like '%even%'")} "
       "select id, parent_id, round(_distance, 6) as _distance from near")
def both_filters(spark, sf):
    near = fusion.nearest(children(spark, sf), query_vector(spark, sf), K, "src7", "Even")
    return rounded(near, "_distance", digits=6)


@check("jon_9_distances", f"with {CHILDREN_SQL}, q as (select embedding::double[] as v from embeddings where vec_id = 0) "
       "select id, round(power(list_distance(vector::double[], (select v from q)), 2), 6) as _distance from children")
def distances(spark, sf):
    """The question against every child vector, as a literal, not a join."""
    from shelfmark.functions.similarity import squared_l2
    d = squared_l2(F.col("vector"), query_vector(spark, sf))
    return children(spark, sf).select("id", F.round(d, 6).alias("_distance"))


@check("rnk_4_nearest", f"with {CHILDREN_SQL}, {nearest_sql(2 * K)} select id, parent_id, round(_distance, 6) as _distance, cast(rn as int) as rn from vlist")
def nearest(spark, sf):
    near = fusion.nearest(children(spark, sf), query_vector(spark, sf), 2 * K)
    return rounded(fusion.numbered(near, "_distance", "id"), "_distance", digits=6)


@check("rnk_4_all_questions", f"""with {CHILDREN_SQL}, q as (select vec_id as qid, embedding::double[] as v from embeddings where vec_id % 20 = 0),
  near as (select qid, id, parent_id, power(list_distance(vector::double[], v), 2) as d from children, q),
  ranked as (select *, row_number() over (partition by qid order by round(d, 12), id) as rn from near)
  select qid, id, parent_id, round(d, 6) as _distance, cast(rn as int) as rn from ranked where rn <= {K}""")
def nearest_of_all(spark, sf):
    """The nearest children of a table of questions (every twentieth vector asks), against all children in blocks."""
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return rounded(fusion.nearest_many(children(spark, sf), asked, K), "_distance", digits=6)


@check("rnk_1_shares", BASE + "select id, cast(src as int) as src, cast(rn as int) as rn, round(1.0::double / (60 + rn), 12) as share from votes")
def shares(spark, sf):
    """Reciprocal-rank share of every list position."""
    _, near, hits = lists(spark, sf)
    votes = near.select(F.col("parent_id").alias("id"), F.lit(0).alias("src"), "rn").unionByName(
        hits.select("id", F.lit(1).alias("src"), "rn"))
    return votes.withColumn("share", F.round(fusion.rank_share(F.col("rn")), 12))


@check("agg_1_fused_scores", BASE + "select id, round(_rrf_score, 12) as _rrf_score, cast(place as int) as place from top")
def fused(spark, sf):
    """Summed shares, ties in order of first appearance, cut at k (RNK-2, RNK-3)."""
    _, near, hits = lists(spark, sf)
    return rounded(fusion.fuse(near, hits, K), "_rrf_score", digits=12)


@check("jon_1_hybrid_mode", BASE + f"select {PARENT_COLUMNS}, round(_rrf_score, 12) as _rrf_score, cast(place as int) as place from top join parents p using (id)")
def hybrid_mode(spark, sf):
    p, near, hits = lists(spark, sf)
    return rounded(fusion.hybrid(near, hits, p, K), "_rrf_score", digits=12)


@check("jon_1_hybrid_missing_parents", BASE + "select p.id, round(_rrf_score, 12) as _rrf_score, cast(place as int) as place from top join (select * from parents where author <> 'en') p using (id)")
def hybrid_missing(spark, sf):
    """A fused parent that the table lacks drops out after the cut, leaving fewer than k."""
    p, near, hits = lists(spark, sf)
    kept = fusion.hybrid(near, hits, p.where("author <> 'en'"), K)
    return rounded(kept.select("id", "_rrf_score", "place"), "_rrf_score", digits=12)


SEMANTIC = f"""with {PARENTS_SQL}, {CHILDREN_SQL}, {nearest_sql(2 * K)},
best as (select parent_id as id, min(rn) as place, arg_min(_distance, rn) as d from vlist group by parent_id) """


@check("rnk_7_best_child", SEMANTIC + "select id, cast(place as int) as place, round(1 - d, 6) as _score from best")
def best_child(spark, sf):
    """First child per parent and its score ``1 - distance`` (RNK-8)."""
    near = fusion.numbered(fusion.nearest(children(spark, sf), query_vector(spark, sf), 2 * K), "_distance", "id")
    return rounded(fusion.best_children(near), "_score", digits=6)


@check("jon_2_semantic_mode", SEMANTIC + f"select {PARENT_COLUMNS}, cast(place as int) as place, round(1 - d, 6) as _score from best "
       f"join (select * from parents where author <> 'fr') p using (id) order by place limit {K}")
def semantic_mode(spark, sf):
    """Missing parents never take a place here: the cut comes after the lookup."""
    near = fusion.numbered(fusion.nearest(children(spark, sf), query_vector(spark, sf), 2 * K), "_distance", "id")
    return rounded(fusion.semantic(near, parents(spark, sf, heavy=False).where("author <> 'fr'"), K, 2 * K), "_score", digits=6)


@check("flt_5_key_filter", BASE + "select id, book_id from parents where id in (select id from top)")
def key_filter(spark, sf):
    """Parents of the fused ids by semi join, no literal id list."""
    p, near, hits = lists(spark, sf)
    return p.join(fusion.small(fusion.fuse(near, hits, K), K), "id", "left_semi").select("id", "book_id")


@check("snk_10_hybrid_json", BASE + "select cast(place as int) as place, round(_rrf_score, 9) as score, p.book_id, p.author, p.title, p.chapter_number, p.chapter_title, p.text, p.char_start, p.char_end, p.id as parent_id "
       "from top join parents p using (id)")
def hybrid_json(spark, sf):
    """Hybrid results as JSON lines, all ten fields read back."""
    p, near, hits = lists(spark, sf)
    r = fusion.hybrid(near, hits, p, K)
    fields = ("score double, book_id string, author string, title string, chapter_number int, chapter_title string, "
              "text string, char_start bigint, char_end bigint, parent_id string")
    j = r.select("place", F.from_json(render.json_object(r), fields).alias("j"))
    return rounded(j.select("place", "j.*"), "score")


@check("snk_11_hybrid_notes", BASE + f"""select 'the-tion-thering-der-20240102' as filename, '# Query: {QUERY}' || chr(10) || '*Generated 2024-01-02 03:04 | ' || count(*) || ' results*'
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg('## ' || place || '. (' || printf('%.4f', _rrf_score) || ') ' || author || ' — *' || title || '*, Ch. ' || chapter_number
  || chr(10) || chr(10) || '> ' || left(trim(text, chr(10) || ' '), 500) || case when length(trim(text, chr(10) || ' ')) > 500 then '...' else '' end || chr(10) || chr(10)
  || 'Source: [[' || book_id || '#' || chapter_title || ']]' || chr(10) || chr(10) || '---' || chr(10), chr(10) order by place) as content from top join parents p using (id)""")
def hybrid_notes(spark, sf):
    """The whole note of a result list (FMT-3)."""
    p, near, hits = lists(spark, sf)
    return render.notes(fusion.hybrid(near, hits, p, K), QUERY, F.lit("2024-01-02 03:04:05").cast("timestamp"))


def flagship(spark, sf):
    """Hybrid search end to end, rendered for the terminal (SNK-9)."""
    p, near, hits = lists(spark, sf, 10)
    r = fusion.hybrid(near, hits, p, 5)
    return r.select("place", render.pretty(r).alias("line"))


@check("snk_9_hybrid_pretty", f"with {PARENTS_SQL}, {CHILDREN_SQL}, {bm25_sql(QUERY_TERMS)}, {nearest_sql(10)}, {keyword_list_sql(10)}, {fused_sql(5)} "
       "select cast(place as int) as place, '[' || printf('%.4f', _rrf_score) || '] ' || author || ' — ' || title || ', Ch. ' || chapter_number || ': ' || chapter_title || chr(10) || '  ' "
       "|| replace(left(text, 300), chr(10), ' ') || '...' || chr(10) || '  → markdown/' || book_id || '.md' || chr(10) as line from top join parents p using (id)")
def hybrid_pretty(spark, sf):
    return flagship(spark, sf)
