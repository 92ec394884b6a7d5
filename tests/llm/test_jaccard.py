import random
import re
from collections import defaultdict

import duckdb
import pytest

from shelfmark.llm import jaccard
from shelfmark.llm.graph import components

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """(doc_id, set size, smallest id in reach) by comparing everything with everything."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    known = lambda ids: min((i for i in ids if i is not None), default=None)
    return [(i, len(s), known(least[find(a)]) if s else i) for a, (i, s) in enumerate(sets)]


def same(df, docs):
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(brute(docs), key=key)


def test_query(spark):
    same(jaccard.op9_prefix_join(spark, SF), duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_edited_copies(spark, documents, seed):
    """Families around the threshold, chains of edits, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 60))
    passage = [word() for _ in range(30)]
    docs, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(rng.choice([6, 30, 60]))]
        if rng.random() < 0.5:
            base = base[:10] + passage + base[10:]
        now = list(base)
        for _ in range(rng.randint(2, 25)):
            text = list(now if rng.random() < 0.4 else base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            now = text
            docs.append((n, " ".join(text).upper() if rng.random() < 0.2 else "  ".join(text)))
            n += 1
    docs += [(n + i, t) for i, t in enumerate(["", None, " \t\n", "a b", "A  B", "a b c", "É a b c d e", "é a b c d e"])]
    same(jaccard.cluster(documents(docs)), docs)


def test_edge_cases(spark, documents):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(5, long), (3, long + " end"), (7, "x y z"), (7, "x y z"), (None, "x y z"), (None, None), (9, None), (9, "other words stand here alone now")]
    same(jaccard.cluster(documents(docs)), docs)
    assert jaccard.cluster(documents([])).count() == 0


def test_one_document_of_each_group_stays(spark, documents):
    docs = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "q"), (4, None), (2, "A b c d e f g")]
    kept = jaccard.stage(spark, documents(docs), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == documents(docs).columns


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(90)] + [(500, 500 + i) for i in range(1, 50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_suffix_filter_is_a_lower_bound():
    import numpy as np
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert jaccard.differ(x, y) <= len(np.setxor1d(x, y))
