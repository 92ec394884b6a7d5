import random

from pyspark.sql import functions as F

from shelfmark.models import arrow_token_counter
from shelfmark.operators import structure as S

BOOK = ("pre\n# One\n\nalpha beta gamma\n\ndelta\n\n# \n\n\n# Two\n\n" + "\n\n".join(f"p{i} " + "w " * i for i in range(12)) + "\n")


def brute_chunks(paras, target, overlap):
    """Independent restatement: walk paragraph indices, keep whole trailing ones for the overlap."""
    tokens = [len(p.split()) for p in paras]
    starts = [sum(len(q) + 2 for q in paras[:i]) for i in range(len(paras))]
    out, held = [], []
    for i, n in enumerate(tokens):
        if held and sum(tokens[j] for j in held) + n > target:
            out.append(held)
            keep = []
            for j in reversed(held):
                if sum(tokens[k] for k in keep) + tokens[j] > overlap:
                    break
                keep.insert(0, j)
            held = keep
        held = held + [i]
    if held:
        out.append(held)
    return [("\n\n".join(paras[j] for j in h), starts[h[0]]) for h in out]


def test_chapters(apply):
    got = apply(S.chapters, "", "\n# A", "# \nx\n# B\ny", "pre\n# C\n## D\n#E")
    assert [[(c.title, c.text, c.char_start) for c in g] for g in got] == [
        [("Untitled", "", 0)], [("Untitled", "", 0), ("A", "# A", 1)],
        [("Untitled", "# \nx", 0), ("B", "# B\ny", 5)], [("Untitled", "pre", 0), ("C", "# C\n## D\n#E", 4)]]


def test_chapter_offsets_point_at_headings(apply):
    (got,) = apply(S.chapters, BOOK)
    assert all(BOOK[c.char_start:].startswith(c.text) for c in got)


def test_paragraphs(apply):
    assert apply(S.paragraphs, "a\n\nb\n\n\n\nc\n", "  \n\n ", "x") == [["a", "b", "c"], [], ["x"]]


def test_chunks_against_brute_force(spark):
    rng = random.Random(11)
    cases = [["w " * rng.randint(1, 12) + "x" for _ in range(rng.randint(1, 25))] for _ in range(60)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ps array<string>")
    for target, overlap in ((20, 0), (20, 6), (10, 50), (3, 2)):
        got = rows.select("i", S.chunks(F.col("ps"), target, overlap).alias("c")).orderBy("i").collect()
        for r, case in zip(got, cases):
            assert [(k.text, k.char_start_offset) for k in r.c] == brute_chunks(case, target, overlap)


def test_chunks_with_injected_tokenizer(spark):
    counter = arrow_token_counter(lambda t: list(t))
    rows = spark.createDataFrame([(["abc", "de", "f"],), (["x" * 9],)], "ps array<string>")
    got = rows.select(S.chunks(F.col("ps"), 5, 0, counter).alias("c")).collect()
    assert [[k.text for k in r.c] for r in got] == [["abc\n\nde", "f"], ["x" * 9]]


def test_records(spark):
    books = spark.createDataFrame([("bk", "Au", "Ti", BOOK)], "book_id string, author string, title string, text string")
    parents = S.build_parents(books, target=20).cache()
    rows = {r.id: r for r in parents.collect()}
    # The heading with no text counts as a chapter of its own.
    assert sorted({r.chapter_number for r in rows.values()}) == [1, 2, 3, 4]
    assert all(r.char_end - r.char_start == len(r.text) for r in rows.values())
    kids = S.build_children(parents, target=8, overlap=4).collect()
    assert kids and all(k.parent_id in rows and k.id.startswith(k.parent_id + "::child") for k in kids)
    assert all(k.context_text.startswith("Author: Au | Title: Ti | Chapter: ") and k.context_text.endswith("\n\n" + k.text) for k in kids)
    joined = " ".join(r.text for r in rows.values())
    assert "alpha beta gamma" in joined and "p11" in joined


def test_empty_chapter_leaves_a_number_gap(spark):
    books = spark.createDataFrame([("b", "a", "t", "\n# One\n\ntext")], "book_id string, author string, title string, text string")
    (row,) = S.build_parents(books).collect()
    assert row.chapter_number == 2 and row.id == "b::ch2::parent0"


def test_chapter_level(apply):
    parts = "# Part I\n" + "".join(f"## Chapter {i}\n" for i in range(4))
    assert apply(S.chapter_level, "# A\n# B", parts, "## Chapter 1\nx", "# A\n## Notes\n## Other",
                 "# Foo\n" + "".join(f"## {i}. T\n" for i in range(1, 4)) + "## A\n## B\n## C\n## D\n## E") == [1, 2, 2, 1, 2]


def test_chapters_at_level(spark):
    text = "intro\n# Long {#x}\n" + "y" * 201 + "\n# Short\nz\n# {#only}\n" + "q" * 300
    rows = spark.createDataFrame([(text,)], "t string")
    got = rows.select(S.chapters_at(F.col("t"), F.lit(1)).alias("c")).first().c
    assert [c.heading for c in got] == ["Long {#x}"] and got[0].text.startswith("# Long")
