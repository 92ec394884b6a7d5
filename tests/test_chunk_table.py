"""The table function cuts as the column form does, and in time in proportion to the text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import chunk_table as C, structure as S


def test_same_chunks_as_the_column_form(spark):
    rng = random.Random(6)
    part = lambda: " ".join("wé"[:rng.randint(1, 2)] for _ in range(rng.choice([0, 1, 2, 5, 30]))) + rng.choice(["", " ", "\t", "\x1c", " "])
    texts = ["".join(part() + rng.choice(["\n", "\n\n", "\n\n\n", "\n \n"]) for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["", "\n\n", None, "one", " x\n\ny "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, body string").withColumn("more", F.struct(F.lit(1).alias("a")))
    for target, overlap in ((10, 0), (10, 4), (30, 30), (1, 0), (7, 100)):
        cols = df.select("i", F.posexplode(S.chunks(S.paragraphs(F.col("body")), target, overlap)).alias("c", "k")).select("i", "c", "k.*")
        want = sorted(map(tuple, cols.collect()))
        got = C.chunk_table(df, "body", target, overlap)
        assert got.columns == ["i", "more", "chunk", "chunk_text", "char_start_offset"]
        assert sorted((r.i, r.chunk, r.chunk_text, r.char_start_offset) for r in got.collect()) == want, (target, overlap)


def test_sql_and_wrong_arguments(spark):
    C.register(spark)
    spark.sql("select 7 as id, 'a b\n\nc d\n\ne' as t").createOrReplaceTempView("some_texts")
    rows = spark.sql("select * from chunk_text(table(some_texts), 't', 3, 2) order by chunk").collect()
    assert [tuple(r) for r in rows] == [(7, 0, "a b", 0), (7, 1, "a b\n\nc d", 0), (7, 2, "c d\n\ne", 5)]
    for bad in ("'absent', 3, 0", "'t', 0, 0", "'t', 3, -1"):
        with pytest.raises(Exception):
            spark.sql(f"select * from chunk_text(table(some_texts), {bad})").collect()
    with pytest.raises(Exception):
        spark.sql("select * from chunk_text(table(select 1 as chunk, 'x' as t), 't', 3, 0)").collect()


def test_linear_in_the_text():
    def seconds(n):
        text = ("some words of a paragraph that is short " * 3 + "\n\n") * n
        begin = time.perf_counter()
        count = sum(1 for _ in C.cut(text, 256, 50))
        return time.perf_counter() - begin, count, len(text)

    seconds(1000)
    small, _, _ = seconds(40_000)
    large, count, size = seconds(400_000)
    assert size > 48_000_000 and count > 10_000 and large < 25 * small


def test_one_very_long_text(spark):
    df = spark.range(1).select(F.col("id"), F.repeat(F.lit("many short words here\n\n"), 400_000).alias("t"))
    row = C.chunk_table(df, "t", 800, 50).agg(F.count("*").alias("n"), F.max("char_start_offset").alias("last")).first()
    assert row.n > 1900 and row.last > 8_000_000
