from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shelfmark.llm import whitening

SF = "/root/testdata/sf0.001"


def brute_polynomial(matrix):
    """Coefficients of det(x - matrix), constant first, by Faddeev and LeVerrier in fractions."""
    d = len(matrix)
    a = np.array([[Fraction(int(v)) for v in r] for r in matrix], object)
    one = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    c, b = [Fraction(1)], one
    for k in range(1, d + 1):
        ab = a @ b
        c.append(-sum(ab[i, i] for i in range(d)) / k)
        b = ab + c[-1] * one
    return [int(x) for x in reversed(c)]


small = st.integers(-4, 4)
rectangles = st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(small, min_size=d, max_size=d), min_size=1, max_size=8))


@given(rectangles)
@settings(max_examples=150, deadline=None)
def test_polynomial_and_roots_against_brute_force(rows):
    x = np.array(rows)
    matrix = (x.T @ x).tolist()  # singular and repeated roots included
    want = brute_polynomial(matrix)
    for p in (2147483647, 101):
        assert whitening.characteristic(np.array(matrix, object), p) == [c % p for c in want]
    assert max(map(abs, want)) <= whitening.bound(matrix)
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    rank = len(want) - 1 - next(i for i, c in enumerate(want) if c)
    for k in range(1, rank + 1):
        numerator, scale, which, equals = whitening.root(want, k)
        value = Fraction(numerator, 1 << scale)
        assert float(value) == pytest.approx(values[k - 1], rel=1e-9, abs=1e-7 * max(values[0], 1)) and 1 <= which <= equals
        v = np.array(whitening.component(matrix, numerator, scale, which))
        assert abs(v @ v - 1) < 1e-12 and np.abs(np.array(matrix, float) @ v - float(value) * v).max() < 1e-11 * max(values[0], 1)


def test_repeated_roots_get_an_orthonormal_basis():
    matrix = np.diag([2, 7, 2, 2, 7, 1]).tolist()
    poly = brute_polynomial(matrix)
    roots = [whitening.root(poly, k) for k in range(1, 7)]
    assert [(round(Fraction(n, 1 << s)), which, equals) for n, s, which, equals in roots] == [(7, 1, 2), (7, 2, 2), (2, 1, 3), (2, 2, 3), (2, 3, 3), (1, 1, 1)]
    axes = np.array([whitening.component(matrix, n, s, which) for n, s, which, _ in roots])
    assert np.abs(axes @ axes.T - np.eye(6)).max() < 1e-14


def test_close_roots_are_told_apart():
    matrix = [[10 ** 30, 0], [0, 10 ** 30 + 1]]
    poly = brute_polynomial(matrix)
    (n1, s1, _, m1), (n2, s2, _, m2) = whitening.root(poly, 1), whitening.root(poly, 2)
    assert (round(Fraction(n1, 1 << s1)), round(Fraction(n2, 1 << s2)), m1, m2) == (10 ** 30 + 1, 10 ** 30, 1, 1)
    assert whitening.component(matrix, n1, s1, 1) == pytest.approx([0, 1], abs=1e-15)


def test_primes():
    sieve = [n for n in range(2, 3000) if all(n % q for q in range(2, int(n ** 0.5) + 1))]
    assert [n for n in range(3000) if whitening.is_prime(n)] == sieve
    assert whitening.primes(1 << 62)[:2] == [2147483647, 2147483629] and len(whitening.primes(1 << 62)) == 3


def brute(embeddings):
    x = np.floor(np.array(embeddings, float) * 64) + 1_000_000
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, axes = values[::-1], axes[:, ::-1]
    return (x - x.mean(0)) @ axes / np.sqrt(np.maximum(values, 1e-300)), values / values.sum(), x


def test_query(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by 1").fetchall()
    out = whitening.op13_whitening(spark, SF).orderBy("vec_id", "component").collect()
    want, shares, x = brute([e for _, e in rows])
    assert [(r.vec_id, r.component) for r in out] == [(i, k) for i, _ in rows for k in range(1, 33)]
    got = np.array([r.whitened for r in out]).reshape(-1, 32)
    for k in range(32):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-8
    assert [r.explained for r in out[:32]] == pytest.approx(shares[:32], rel=1e-9)
    n, total = len(rows), x.sum(0)
    assert [r.deviation for r in out[::32]] == [sum(int(n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    assert {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9


def embedded(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit("x"), "n": F.lit(1), "component": F.lit(0), "i": F.lit(2)})


def run(spark, rows):
    used = whitening.usable(embedded(spark, rows))
    model = whitening.fit(used)
    error = whitening.identity_error(used, model) if model.components else 0.0
    return whitening.whiten(used, model, error).collect()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 0.0]), (103, [0.0, inf, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    good = [(1, [1.0, 0.0, 0.5]), (2, [0.0, 1.0, 0.25]), (3, [0.5, 0.5, -1.0]), (3, [0.5, 0.5, -1.0]), (None, [2.0, -1.5, 0.0])]
    out = run(spark, bad + good)
    want, shares, _ = brute([e for _, e in good])
    assert len(out) == 5 * 3 and {r.n for r in out} == {5}
    for k in range(3):
        got = sorted(abs(r.whitened) for r in out if r.component == k + 1)
        assert got == pytest.approx(sorted(np.abs(want[:, k])), abs=1e-9)
        assert [r.explained for r in out if r.component == k + 1] == pytest.approx([shares[k]] * 5)
    same = [r.whitened for r in out if r.vec_id == 3]
    assert sorted(same)[::2] == sorted(same)[1::2] and out[0].identity_error < 1e-12


def test_no_variance_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [] and run(spark, [(1, [1.0, 2.0])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = run(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])  # one dimension of variance
    assert {r.component for r in line} == {1} and sorted(r.whitened for r in line) == pytest.approx([-2 ** 0.5, -(0.5 ** 0.5), 0, 0.5 ** 0.5, 2 ** 0.5])
    assert {r.explained for r in line} == {1.0}


def test_exact_far_from_the_mean():
    y = np.array([[3, -(1 << 40)], [5, 1 << 40]], np.int64)
    assert whitening.gram(y).tolist() == [[34, 2 << 40], [2 << 40, 1 << 81]]
    assert whitening.deviations(np.array([[3, 4], [1 << 31, 1 << 31]])) == [25, None]
    assert whitening.deviations(np.array([[1 << 31, 0]])) == [1 << 62]
