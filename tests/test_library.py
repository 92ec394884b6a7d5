import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import render
from shelfmark.functions.similarity import squared_l2
from shelfmark.models import Embedder, hashed_embedding
from shelfmark.operators import fusion, keyword
from shelfmark.plans.library import IndexNotBuilt, Library

EMBED = Embedder(name="tiny", dims=16)
BOOKS = [
    ("miller-bread", "# Liberty\n\n" + "\n\n".join(f"inherited liberty paragraph {i} of ancient rights" for i in range(40))),
    ("keeper-bees", "# Community\n\n" + "\n\n".join(f"community and association number {i}" for i in range(40)) + "\n\n# Power\n\nthe state and liberty"),
    ("plain", "no heading here, only trees and rivers"),
]


def books(spark, rows=BOOKS):
    return spark.createDataFrame(rows, "book_id string, text string")


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("lib")), EMBED, buckets=4)
    assert lib.add_books(books(spark)) == 3
    return lib


def brute_bm25(parents, query):
    docs = {p.id: re.findall(r"[^\W_]+", p.text.lower()) for p in parents}
    avg = sum(map(len, docs.values())) / len(docs)
    scores = Counter()
    for term in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())):
        df = sum(term in d for d in docs.values())
        for pid, words in docs.items():
            tf = words.count(term)
            if tf:
                scores[pid] += math.log(1 + (len(docs) - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(words) / avg))
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def brute_distance(a, b):
    return sum((float(x) - float(y)) ** 2 for x, y in zip(a, b))


def test_guard(spark, tmp_path):
    with pytest.raises(IndexNotBuilt):
        Library(spark, str(tmp_path / "none"), EMBED).search("x")
    lib = Library(spark, str(tmp_path / "none"), EMBED)
    for bad in (dict(k=0), dict(mode="other")):
        with pytest.raises(ValueError):
            lib.search("x", **bad)


def test_keyword_mode_matches_brute_force(library):
    query = "liberty of the community"
    expected = brute_bm25(library.parents().collect(), query)
    got = library.search(query, k=50, mode="keyword").collect()
    assert [(r.id, round(r._score, 9)) for r in got] == [(i, round(s, 9)) for i, s in expected]
    top = library.search(query, k=2, mode="keyword").collect()
    assert [r.id for r in top] == [i for i, _ in expected[:2]]


def test_stored_and_direct_scores_agree(library):
    stored = {r.id: r._score for r in library.search("ancient rights", 50, "keyword").collect()}
    direct = keyword.score_texts(library.parents(), keyword.query_terms("ancient rights")).collect()
    assert stored.keys() == {r.id for r in direct}
    assert all(abs(stored[r.id] - r._score) < 1e-9 for r in direct)


def test_semantic_mode_matches_brute_force(library):
    query = "community association"
    vector = EMBED.embed_query(query)
    kids = sorted(((brute_distance(c.vector, vector), c.id, c.parent_id) for c in library.children().collect()))[:6]
    expected = list(dict.fromkeys(p for _, _, p in kids))[:3]
    got = library.search(query, 3, "semantic").collect()
    assert [r.id for r in got] == expected
    assert abs(got[0]._score - (1 - kids[0][0])) < 1e-6


def test_hybrid_mode_matches_brute_force(library):
    query, k = "liberty community rivers", 3
    vector = EMBED.embed_query(query)
    near = sorted(((brute_distance(c.vector, vector), c.id, c.parent_id) for c in library.children().collect()))[:2 * k]
    scores, order = {}, {}
    for src, ids in ((0, [p for _, _, p in near]), (1, [i for i, _ in brute_bm25(library.parents().collect(), query)[:2 * k]])):
        for rank, pid in enumerate(ids):
            scores[pid] = scores.get(pid, 0) + 1 / (61 + rank)
            order.setdefault(pid, (src, rank))
    expected = sorted(scores, key=lambda p: (-scores[p], order[p]))[:k]
    got = library.search(query, k).collect()
    assert [r.id for r in got] == expected and [r.place for r in got] == [1, 2, 3]
    assert [r._rrf_score for r in got] == [scores[p] for p in expected]


def test_filters(library):
    assert {r.book_id for r in library.search("liberty", 20, "keyword", book_id="miller-bread").collect()} == {"miller-bread"}
    assert {r.author for r in library.search("liberty", 20, "hybrid", author="KEE").collect()} == {"Keeper"}
    assert {r.author for r in library.search("liberty", 20, "keyword", author="m_ller").collect()} == {"Miller"}
    assert library.search("liberty", 20, "keyword", author="%").count() > 0
    assert library.search("liberty", 20, "keyword", book_id="keeper-bees", author="miller").count() == 0
    assert library.search("liberty", 5, "keyword", author="o'brien").count() == 0
    assert library.search("liberty", 5, "keyword", author="a\\b").count() == library.search("liberty", 5, "keyword", author="a\\").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(library):
    words = plan_of(library.keyword_list("liberty of rights", 5, "miller-bread", None))
    assert "In(term, [liberty,of,rights])" in words and any("bucket" in x.split("]")[0] for x in words.split("PartitionFilters: [")[1:])
    near = plan_of(library.vector_list(EMBED.embed_query("x"), 3, None, None))
    assert "TakeOrderedAndProject" in near and "context_text" not in near
    assert "Join" not in near  # nothing was replaced, so nothing has to be hidden


def contents(lib):
    return (sorted(tuple(r) for r in lib.counts().collect()), sorted(r.id for r in lib.parents().collect()),
            sorted(r.id for r in lib.children().collect()), sorted((r.id, r.term) for r in lib.postings().collect()))


STEPS = ("parents", "children", "postings", "terms", "corpus", "books", "log")


@pytest.mark.parametrize("step", STEPS)
def test_a_run_that_dies_loses_and_doubles_nothing(spark, tmp_path, step):
    whole = Library(spark, str(tmp_path / "whole"), EMBED, buckets=2)
    whole.add_books(books(spark))
    lib = Library(spark, str(tmp_path / "lib"), EMBED, buckets=2)
    lib.add_books(books(spark, BOOKS[:1]))
    before, real = contents(lib), (lib._segment_of, lib._commit)

    def dies(name, *a):
        if name == step:
            raise RuntimeError("executor lost")
        return real[0](name, *a)

    def commit(*a, **k):
        raise RuntimeError("driver lost")

    lib._segment_of = dies
    if step == "log":
        lib._commit = commit
    with pytest.raises(RuntimeError):
        lib.add_books(books(spark))
    assert contents(Library(spark, lib.root, EMBED)) == before
    again = Library(spark, lib.root, EMBED)
    assert again.add_books(books(spark)) == 2
    assert contents(again) == contents(whole)


def test_adding_one_book_writes_only_its_own_rows(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), EMBED, buckets=2)
    lib.add_books(books(spark))
    files = lambda: {p for p in (tmp_path / "lib").rglob("*.parquet")}
    before = files()
    lib.add_books(books(spark, [("extra", "# E\n\nmountains and lakes")]))
    fresh = [str(p) for p in files() - before if "/log/" not in str(p) and "/arrivals/" not in str(p)]
    assert before <= files() and {r.book_id for r in spark.read.parquet(*(p for p in fresh if "/parents/" in p)).collect()} == {"extra"}
    assert [(r.books, r.replaced, r.parents) for r in lib.run_counters().orderBy("seq").collect()][1] == (1, 0, 1)


def test_compaction_keeps_answers(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), EMBED, buckets=2)
    lib.add_books(books(spark))
    lib.add_books(books(spark, [("plain", "# New\n\nfresh oceans of liberty")]), force=True)
    ask = lambda: [(r.id, r._score) for r in lib.search("liberty oceans rivers", 9, "keyword").collect()]
    assert [(i, round(x, 9)) for i, x in ask()] == [(i, round(x, 9)) for i, x in brute_bm25(lib.parents().collect(), "liberty oceans rivers")]
    before, answers = contents(lib), ask()
    lib.compact()
    assert contents(lib) == before and ask() == answers and len(lib.log()) == 1
    lib.vacuum()
    assert contents(lib) == before and ask() == answers
    assert len(list((tmp_path / "lib" / "parents").iterdir())) == 1


def test_semantic_mode_gives_k_parents(spark, tmp_path):
    """One parent with many close children does not crowd the others out."""
    lib = Library(spark, str(tmp_path / "lib"), EMBED, buckets=2)
    near = "# One\n\n" + "\n\n".join(" ".join(["bees hive honey"] * 60) for _ in range(4))
    lib.add_books(books(spark, [("near", near), ("b", "# B\n\nrocks"), ("c", "# C\n\nstars")]))
    assert lib.children().where("book_id = 'near'").count() > 2
    assert {r.book_id for r in lib.search("bees hive honey", 3, "semantic").collect()} >= {"near"}
    assert lib.search("bees hive honey", 3, "semantic").count() == 3
    assert lib.search("bees hive honey", 50, "semantic").count() == lib.parents().count()


def test_incremental_and_replace(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), EMBED, buckets=2)
    lib.add_books(books(spark))
    before = {r.book_id: (r.parents, r.children) for r in lib.counts().collect()}
    assert lib.add_books(books(spark)) == 0  # all known already
    assert lib.add_books(books(spark, [("plain", "# New\n\nfresh oceans"), ("extra", "# E\n\nmountains")]), force=True) == 2
    ids = [r.id for r in lib.parents().collect()]
    assert len(ids) == len(set(ids))  # replaced, not appended
    after = {r.book_id: (r.parents, r.children) for r in lib.counts().collect()}
    assert after["miller-bread"] == before["miller-bread"] and after["extra"] == (1, 1)
    assert lib.search("rivers", 5, "keyword").count() == 0
    assert [r.book_id for r in lib.search("oceans", 5, "keyword").collect()] == ["plain"]
    assert lib.add_books(books(spark, [("plain", "  ")]), force=True) == 1  # a book may become empty
    assert "plain" not in {r.book_id for r in lib.indexed_books().collect()}
    assert lib.search("oceans", 5, "keyword").count() == 0


def test_embedder_must_match_the_index(spark, library):
    with pytest.raises(ValueError):
        Library(spark, library.root, Embedder(name="other", dims=16))


def test_metadata_from_maps(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), EMBED, buckets=2)
    maps = spark.createDataFrame([("plain", "A. Writer", None)], "id string, author string, title string")
    lib.add_books(books(spark), maps)
    named = {r.book_id: (r.author, r.title) for r in lib.parents().collect()}
    assert named == {"plain": ("A. Writer", "plain"), "miller-bread": ("Miller", "Bread"), "keeper-bees": ("Keeper", "Bees")}


def ranked(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fused(spark, vector, words, k):
    v = ranked(spark, [(p, i + 1) for i, p in enumerate(vector)], "parent_id string, rn int")
    w = ranked(spark, [(p, i + 1) for i, p in enumerate(words)], "id string, rn int")
    return [(r.id, r._rrf_score) for r in fusion.fuse(v, w, k).orderBy("place").collect()]


def test_fusion(spark):
    assert [i for i, _ in fused(spark, [], ["a", "b"], 5)] == ["a", "b"]
    got = fused(spark, ["x"], ["x", "y"], 5)
    assert got[0] == ("x", 1 / 61 + 1 / 61) and round(got[0][1], 4) == 0.0328
    assert len(fused(spark, [], [f"p{i}" for i in range(10)], 3)) == 3
    # Equal scores: the vector list comes first; repeated children add up.
    assert [i for i, _ in fused(spark, ["v"], ["w"], 2)] == ["v", "w"]
    assert fused(spark, ["a", "b", "b"], [], 2)[0] == ("b", 1 / 62 + 1 / 63)


def test_missing_parent(spark):
    parents = spark.createDataFrame([("b", "t"), ("c", "t")], "id string, text string")
    near = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.2), ("b", 3, 0.3), ("c", 4, 0.4)], "parent_id string, rn int, _distance double")
    words = spark.createDataFrame([], "id string, rn int")
    assert [r.id for r in fusion.hybrid(near, words, parents, 2).collect()] == ["b"]  # "a" took a place
    assert [(r.id, round(r._score, 3)) for r in fusion.semantic(near, parents, 2, 4).collect()] == [("b", 0.8), ("c", 0.6)]


def test_distance_and_unusable_vectors(spark):
    rows = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None, 1.0]), (6, [float("nan")] * 3)],
                                 "id int, vector array<float>").withColumn("parent_id", F.lit("p"))
    q = [1.0, 1.0, 1.0]
    got = {r.id: r.d for r in rows.select("id", squared_l2(F.col("vector"), q).alias("d")).collect()}
    assert got == {1: 0.25 + 4 + 1, 2: 3.0, 3: None, 4: None, 5: None, 6: None}
    assert [r.id for r in fusion.nearest(rows, q, 5).collect()] == [2, 1]


def test_term_runs(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>")
    got = [[(x.term, x.tf) for x in r[0]] for r in rows.select(keyword.term_runs(F.col("w"))).collect()]
    assert got == [[("a", 1), ("b", 2)], []]


def test_rendering(library):
    hits = library.search("liberty", 2)
    lines = [r.line for r in library.as_pretty(hits).collect()]
    assert re.match(r"\[0\.0\d{3}\] \w+ — .+, Ch\. \d+: .+\n  .*\.\.\.\n  → markdown/.+\.md\n", lines[0])
    rows = [json.loads(r.line) for r in library.as_json(hits).collect()]
    assert list(rows[0]) == [n for n, _ in render.JSON_FIELDS] and isinstance(rows[0]["score"], float)
    from datetime import datetime
    note = library.as_notes(hits, "What is liberty?", datetime(2024, 1, 2, 3, 4)).first()
    assert note.filename == "what-is-liberty-20240102"
    assert note.content.startswith("# Query: What is liberty?\n*Generated 2024-01-02 03:04 | 2 results*\n\n---\n\n## 1. (0.0")
    assert note.content.count("Source: [[") == 2


def test_rendering_of_missing_values_and_zero_scores(spark):
    row = spark.createDataFrame([(1, "i", None, None, None, None, None, None, None, None, 0.0, 0.5)],
                                "place int, id string, book_id string, author string, title string, chapter_number int, chapter_title string, "
                                "text string, char_start long, char_end long, _rrf_score double, _score double")
    assert row.select(render.pretty(row).alias("l")).first().l == "[0.5000] ? — ?, Ch. ?: ?\n  ...\n  → markdown/?.md\n"
    parsed = json.loads(row.select(render.json_object(row).alias("l")).first().l)
    assert parsed["score"] == 0.5 and parsed["title"] is None


def test_hashed_embedding_is_deterministic():
    a, b = hashed_embedding(["x y", "x y"], 8)
    assert list(a) == list(b) and abs(sum(v * v for v in a) - 1) < 1e-9
