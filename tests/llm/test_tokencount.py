import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import tokencount

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(text, sizes, rule):
    """Tokens per section, from the tokenizer's own offsets."""
    bounds, at = [], 0
    for n in sizes:
        bounds.append((at, at + n))
        at += n
    out = [0] * len(sizes)
    for a, b in TOKENIZER.encode(text or "", add_special_tokens=False).offsets:
        if rule == "first":
            b = a + 1
        if rule == "last":
            a = b - 1
        share = [max(0, min(b, y) - max(a, x)) for x, y in bounds]
        if any(share):
            out[share.index(max(share))] += 1
    return out


def test_query(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = {}
    for r in tokencount.op7_offset_counts(spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.tokens
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        lines = text.split("\n")
        sizes = [len(x) + (k < len(lines) - 1) for k, x in enumerate(lines)]
        assert [got[i][k] for k in range(len(sizes))] == brute(text, sizes, "majority")


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_boundary_rules(spark, rule):
    docs = [(1, "internationalization matters", [3, 0, 9, 16]), (2, "naïve café 漢字", [2, 1, 12]), (3, None, [0]), (4, "", []), (5, "one two three", [4])]
    df = spark.createDataFrame(docs, "doc_id long, text string, sizes array<int>").withColumn("section", F.lit("x"))
    got = {}
    for r in tokencount.count(df, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.tokens
    for i, text, sizes in docs:
        want = brute(text, sizes, rule)
        assert [got.get(i, {}).get(k) for k in range(len(sizes))] == want
        total = len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)
        assert sum(got.get(i, {}).values()) == total  # section -1 holds the rest


def test_rejects_unknown_rules_and_takes_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, sizes array<int>")
    assert tokencount.count(df).count() == 0
    with pytest.raises(ValueError):
        tokencount.count(df, "none")
