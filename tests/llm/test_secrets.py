import random

from pyspark.sql import functions as F

from shelfmark.llm import secrets

COLUMNS = "doc_id long, path string, text string"


def corpus(seed, n=150):
    """Texts with issued keys, and long words, numbers and names beside them."""
    rng = random.Random(seed)
    words = ["winter", "garden", "stone", "river", "table", "letter", "window", "morning", "harvest", "bridge"]
    rows, keys = [], set()
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(20))
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        if i % 3 == 0:
            keys.add(key)
            text += f' token = "{key}" ' + rng.choice(words)
        elif i % 3 == 1:
            text += " see " + "".join(rng.choice(words) for _ in range(4)) + " " + "4" * 16
        else:
            text += " path/to/" + "_".join(rng.choice(words) for _ in range(3)) + " now"
        rows.append((i, f"src/{rng.choice(['main', 'test'])}/{i}.txt", text))
    return rows, keys


def test_held_out_accuracy(spark):
    rows, _ = corpus(1)
    train = spark.createDataFrame(rows, COLUMNS)
    found = secrets.features(secrets.candidates(train), secrets.dictionary(train))
    model = secrets.train(secrets.labelled_by_format(found))
    fresh, keys = corpus(2)
    df = spark.createDataFrame(fresh, COLUMNS)
    judged = secrets.score(secrets.features(secrets.candidates(df), secrets.dictionary(df)), model).collect()
    right = sum((r.probability >= 0.5) == (r.value in keys) for r in judged)
    assert keys <= {r.value for r in judged} and right >= 0.98 * len(judged)


def test_whole_table(spark):
    rows = secrets.op2_forest(spark, "/root/testdata/sf0.01").collect()
    import duckdb
    import re
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    planted = sorted(d for d, t in docs for _ in re.findall(r"(?i)(?<![A-Za-z0-9+/=_-])[0-9a-f]{40}(?![A-Za-z0-9+/=_-])", t))
    assert planted and sorted(r.doc_id for r in rows if r.secret) == planted
    want = sorted((d, i, len(v)) for d, t in docs for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", t)) for v in re.findall(secrets.CANDIDATE, w))
    assert sorted((r.doc_id, r.at, r.length) for r in rows) == want


def test_edge_cases(spark):
    key = "ab" * 10 + "0123456789" * 2
    rows = [(1, None, None), (2, "p", ""), (3, None, key), (3, None, key), (None, "p", f"({key}) y"), (4, "p", "w " * 50_000 + key)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("value", F.lit(0)).withColumn("near", F.lit("x"))
    out = secrets.scan(df.select("doc_id", "path", "text")).collect()
    assert sorted(str(r.doc_id) for r in out) == ["3", "3", "4", "None"] and not any(r.secret for r in out)  # one kind only: no forest
    assert {(r.near, r.after) for r in out if r.doc_id == 3} == {("", "")}
    assert secrets.scan(spark.createDataFrame([], COLUMNS)).count() == 0
