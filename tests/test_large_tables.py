"""What one task reads or holds does not grow with the tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import postings
from shelfmark.models import Embedder
from shelfmark.operators import keyword
from shelfmark.plans import library
from shelfmark.plans.checks import registry
from shelfmark.sources import tables


@pytest.fixture
def conf(spark):
    """Set session options and put the old ones back."""
    old = {}

    def put(**options):
        for name, value in options.items():
            key = name.replace("__", ".")
            old.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def text_rows(spark, n, parts=8):
    words = F.transform(F.sequence(F.lit(0), (F.col("i") % 7).cast("int")), lambda x: F.concat(F.lit("w"), F.hash("i", x) % 50))
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "i").select(
        F.format_string("p%05d", "i").alias("id"), F.lit("b").alias("book_id"), F.lit("a").alias("author"), F.array_join(words, " ").alias("text"))


def test_a_large_bucket_is_dealt_to_several_tasks(spark, tmp_path, conf):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="100k")
    rows = spark.range(0, 40_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(0).alias("bucket"))
    tables.write_segment(rows, str(tmp_path), "x", ["id"])
    files = list(Path(tmp_path, "batch=x", "bucket=0").glob("*.parquet"))
    got = spark.read.parquet(str(tmp_path))
    assert len(files) > 4 and (got.count(), got.select("id").distinct().count()) == (40_000, 40_000)


def test_documents_are_dealt_by_size(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    assert registry.documents(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(registry, "TASK_BYTES", 10_000)
    assert registry.documents(spark, sf).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_postings_of_a_batch_are_made_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(library, "TASK_BYTES", 2_000)
    lib = library.Library(spark, str(tmp_path), Embedder(dims=8), buckets=2)
    books = spark.range(200).select(F.concat(F.lit("b"), "id").alias("book_id"), F.concat(F.lit("# One\n\nshared word"), "id").alias("text"))
    assert lib.add_books(books) == 200
    assert len(list(Path(tmp_path, "postings").rglob("*.parquet"))) > 4
    assert lib.postings().where("term = 'shared'").count() == 200
    assert {r.book_id for r in lib.search("word77", 3, "keyword").collect()} == {"b77"}


def test_no_posting_is_shuffled_into_blocks(spark):
    assert shuffles(keyword.in_blocks(keyword.placed_postings(text_rows(spark, 100)))) == 0


@pytest.mark.parametrize("words", [3, 1_000_000])
def test_blocks_across_batches_and_pieces(spark, monkeypatch, conf, words):
    conf(spark__sql__execution__arrow__maxRecordsPerBatch="5")
    monkeypatch.setattr(postings, "WORDS_AT_ONCE", words)
    parents = text_rows(spark, 300, 3)
    blocks = keyword.in_blocks(keyword.placed_postings(parents)).cache()
    assert blocks.count() == blocks.select("term", "block").distinct().count()
    names = ("term", "id", "book_id", "author", "tf", "dl")
    assert sorted(map(tuple, keyword.entries(blocks).select(*names).collect())) == sorted(map(tuple, keyword.postings(parents).select(*names).collect()))
    blocks.unpersist()


@pytest.mark.parametrize("rows, questions", [(512, 1024), (7, 2)])
def test_many_questions_rank_like_one(spark, monkeypatch, rows, questions):
    """Every text stands there seven times or more, so ties go by id wherever the copies are."""
    monkeypatch.setattr(postings, "ROWS_AT_ONCE", rows)
    monkeypatch.setattr(keyword, "QUESTIONS", questions)
    parents = text_rows(spark, 400).unionByName(spark.createDataFrame([("none", "b", "a", None), ("empty", "b", "a", "")], "id string, book_id string, author string, text string"))
    index = keyword.postings(parents)
    stats = keyword.term_stats(index), keyword.corpus_stats(parents)
    asked = [(0, "w1 w2 W2 w-3"), (1, "unknown"), (2, ""), (3, None), (4, "w7 unknown w-7"), (5, "w10 w11 w12 w13 w14 w15")]
    got = keyword.score_questions(parents, *stats, spark.createDataFrame(asked, "qid int, text string"), 6)
    assert shuffles(got) == 1  # the best of each task; no join, no pair
    for qid, text in asked:
        s = keyword.score_postings(index, *stats, keyword.query_terms(text or ""))
        want = s.withColumn("_score", F.round("_score", 9)).orderBy(F.desc("_score"), "id").limit(6).collect()
        found = got.where(F.col("qid") == qid).orderBy("place").collect()
        assert [r.id for r in found] == [r.id for r in want] and [r._score for r in found] == pytest.approx([r._score for r in want], abs=1e-8)
