"""One key holding a third of all rows: results stay whole and plans stay combinable."""

from collections import Counter

from pyspark.sql import functions as F

from shelfmark.operators import conversion, fusion, keyword, staging as G, triage as T

N = 30_000


def hot(column="id"):
    """Every third row gets key 0, the others spread out."""
    return F.when(F.col(column) % 3 == 0, 0).otherwise(F.col(column))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_one_file(spark):
    prints = spark.range(N).select(hot().cast("string").alias("sha256"), F.format_string("p%06d", N - F.col("id")).alias("path"),
                                   F.col("id").alias("modification_time"), F.lit("n.epub").alias("name"))
    kept = T.first_copies(prints)
    assert plan_of(kept).count("partial_min_by") >= 1
    rows = {r.sha256: r.modification_time for r in kept.collect()}
    assert len(rows) == N - N // 3 + 1 and rows["0"] == 0


def test_change_log_of_one_folder(spark):
    log = spark.range(N).select(hot().alias("folder_id"), F.lit("f").alias("field"), F.col("id").alias("value"),
                                F.col("id").alias("at"), F.col("id").alias("seq"))
    folded = G.fold_log(log)
    assert "partial_max_by" in plan_of(folded)
    row = folded.where("folder_id = 0").first()
    assert (row.value, row.created_at, row.updated_at) == (N - 3, 0, N - 3)


def test_one_huge_file_is_probed_by_pages(spark):
    pages = spark.range(N).select(hot().cast("string").alias("file"), F.when(F.col("id") % 3 == 0, F.expr("id div 3")).otherwise(0).alias("page_no"),
                                  F.col("id").alias("n_chars"))
    row = T.probe_pages(pages).where("file = '0'").first()
    picks = [int(i * (10_000 / 5)) for i in range(5)]
    assert (row.total_pages, row.sampled_pages, row.avg_chars_per_page) == (10_000, 5, sum(3 * p for p in picks) / 5)


def test_one_long_document_is_put_together_in_groups(spark):
    parts = spark.range(N).select(hot().cast("string").alias("file"), F.expr("cast(id div 3 as int)").alias("part"),
                                  F.col("id").cast("string").alias("text"))
    text = conversion.ordered_text(parts, "file", "part", "text", ",").where("file = '0'").first().text
    assert text == ",".join(str(i) for i in range(0, N, 3))


def test_a_term_in_every_parent(spark):
    parents = spark.range(5_000).select(F.col("id").cast("string").alias("id"), F.lit("b").alias("book_id"), F.lit("a").alias("author"),
                                        F.concat(F.lit("common "), F.when(F.col("id") % 1000 == 0, "rare ").otherwise(""), F.repeat(F.lit("common "), (F.col("id") % 3).cast("int"))).alias("text"))
    index = keyword.postings(parents)
    scored = keyword.score_postings(index, keyword.term_stats(index), keyword.corpus_stats(parents), ["common", "rare"])
    assert scored.count() == 5_000
    assert {int(r.id) % 1000 for r in keyword.top_scores(scored, 5).collect()} == {0}


def test_many_children_of_one_parent(spark):
    near = spark.range(1, 201).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("parent_id"),
                                      F.col("id").cast("int").alias("rn"))
    words = spark.createDataFrame([], "id string, rn int")
    top = fusion.fuse(near, words, 1).first()
    expected = Counter()
    for i in range(1, 201):
        expected["hot" if i % 3 == 0 else f"p{i}"] += 1 / (60 + i)
    assert (top.id, top._rrf_score) == ("hot", expected["hot"])
