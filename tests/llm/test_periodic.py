import zlib
from hashlib import sha256

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from shelfmark.llm import periodic

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every lag, every place: (start, length, smallest period) of the maximal stretches."""
    found = {}
    for lag in range(1, len(words) // 4 + 1):
        same = [words[i] == words[i + lag] for i in range(len(words) - lag)]
        start = None
        for i, s in enumerate([*same, False]):
            if s and start is None:
                start = i
            if not s and start is not None:
                length = i - start + lag
                if length >= max(6, 4 * lag):
                    found.setdefault((start, length), lag)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def summary(words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda t: sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


letter = st.sampled_from("abc")
passage = st.lists(letter, max_size=6)
repeated = st.builds(lambda p, n, tail: p * n + tail, passage, st.integers(0, 8), passage)


@given(st.lists(st.lists(repeated, max_size=4).map(lambda x: sum(x, [])), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_runs_against_brute_force(texts):
    assert periodic.runs_of(texts) == [brute(t) for t in texts]


def test_long_periods_and_a_very_long_text():
    rng = np.random.default_rng(5)
    noise = lambda n: [f"w{i}" for i in rng.integers(0, 10 ** 9, n)]
    for period in (7, 8, 63, 64, 1000):
        head, passage_, tail = noise(50), noise(period), noise(9)
        text = head + passage_ * 4 + passage_[:period // 2] + tail
        assert periodic.runs_of([text, noise(20)]) == [[(50, 4 * period + period // 2, period)], []]
        assert periodic.runs_of([head + passage_ * 3 + passage_[:-1] + tail]) == [[]]  # one word short
    assert periodic.runs_of([["a"] * 300_000]) == [[(0, 300_000, 1)]]


def test_query_against_brute_force(spark):
    rows = {r.doc_id: tuple(r)[1:] for r in periodic.op12_runs(spark, SF).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(rows) == len(docs)
    periodic_ones = 0
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n <= 3000 or h % 10 == 0:  # the brute force is quadratic
            assert rows[doc_id] == summary(words), doc_id
            periodic_ones += rows[doc_id][0] > 0
    assert periodic_ones > 5


def test_edge_cases(spark, documents):
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a b a b a b a b x"), (None, "é é é é é é é"),
            (6, "a a a a a"), (7, "a" * 100_000), (8, "x x x x x x x x x x x x"), (9, "a b a b a b a b c c c c c c c c")]
    out = periodic.find(documents(docs), texts=True).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        r = by[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == summary(words)
    assert by[5].collapsed == "a b x" and by[4].collapsed == "a" and [tuple(x) for x in by[5].runs] == [(0, 8, 2)]
    assert (by[9].start, by[9].period) == (8, 1)  # the greater exponent
    assert periodic.find(documents([])).count() == 0
    assert [tuple(r) for r in periodic.find(documents([(None, "b " * 9)]), periodic.repeated_tail).select("n_runs").collect()] == [(1,)]
