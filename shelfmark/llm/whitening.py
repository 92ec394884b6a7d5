"""Embedding whitening by an exact characteristic polynomial.

Entries become integers, so the scatter matrix ``n * sum y y' - sum y * sum y'`` (y: a
vector less a whole number near the mean) is an exact integer matrix, ``n^2`` times the
covariance. From there on:

1. Its characteristic polynomial is found modulo many primes, by reduction to Hessenberg
   form; the primes are spread over tasks.
2. Chinese remaindering gives the coefficients, whose size has a proven bound, so the
   polynomial is exact.
3. All its roots are real and none is negative. For such a polynomial the sign changes
   of its coefficients, moved by a, count the roots above a exactly (Descartes), so
   bisection isolates the k-th root, with its multiplicity, to ``BITS`` bits. Roots
   are spread over tasks.
4. Components are null vectors of ``scatter - root``: inverse iteration in fixed-point
   numbers of ``FRACTION`` bits. A root of multiplicity m gives m orthonormal vectors,
   the same in each task that needs one of them.

Data are read once each for the length and the sums, for the scatter and for the
covariance of the result. A task sends its own sums (at most d^2 numbers); vectors are
never shuffled, and what the driver holds is bounded by the dimension d.

Defined cases: a row is left out if its vector is null or holds a null, NaN, an infinity
or an entry of ``HUGE`` or more; of several lengths the most common counts (of equally common ones the
longest) and rows of others are left out. Components of variance 0 cannot be whitened
and give no rows, so equal vectors, or a single one, give none; repeated rows count
each; an empty table gives no rows; only ``vec_id`` and ``embedding`` are read. A
deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from itertools import accumulate
from math import comb, gcd, isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import carried, parts, table

carried(__name__)

SCALE, SHIFT, HUGE = 64, 1_000_000, float(1 << 34)
COMPONENTS = 32
# Bits to which a root is known, and fraction bits of the inverse iteration.
BITS, FRACTION, STEPS = 192, 512, 3
PRIMES_BELOW = 1 << 31
Matrix = list[list[int]]


# --- exact sums ---------------------------------------------------------------------------------------------

def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, all of one length."""
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < HUGE), F.lit(False)))
    kept = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(fine & (F.size("v") > 0))
    common = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.filter(F.size("v") == (common.d if common else 0))


def vectors(column: pa.Array, size: int) -> np.ndarray:
    """The whole numbers of a column of vectors, a row each."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE).astype(np.int64) + SHIFT


def gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers; in floating point or 64 bits only where that is exact."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    out = y.T.astype(kind) @ y.astype(kind)
    return (out.astype(np.int64) if kind is np.float64 else out).astype(object)


def sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = vectors(batch.column(0), size)
            n, total = n + len(x), total + x.sum(0).astype(object)
        yield from _numbers([(0, 0, n)] + [(0, i + 1, s) for i, s in enumerate(total)])

    found = {r.j: int(r.v) for r in _added(rows.select("v").mapInArrow(add, "i int, j int, v decimal(38,0)"))}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(size)]


def scatter(rows: DataFrame, n: int, total: list[int]) -> Matrix:
    """The exact matrix n^2 * covariance."""
    size, near = len(total), [s // n for s in total]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((size, size), object)
        for batch in batches:
            found += gram(vectors(batch.column(0), size) - np.array(near, np.int64))
        yield from _numbers([(i, j, found[i, j]) for i in range(size) for j in range(i, size)])

    rest = [s - n * c for s, c in zip(total, near, strict=True)]
    out = [[0] * size for _ in range(size)]
    for r in _added(rows.select("v").mapInArrow(add, "i int, j int, v decimal(38,0)")):
        out[r.i][r.j] = out[r.j][r.i] = n * int(r.v) - rest[r.i] * rest[r.j]
    return out


def _numbers(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    i, j, v = zip(*rows, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, v), pa.decimal128(38, 0))], ["i", "j", "v"])


def _added(partial: DataFrame) -> list:
    """The tasks' sums added up: one number per pair of dimensions."""
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()


# --- the characteristic polynomial ----------------------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide every n below 3.2 billion."""
    if n < 2 or n % 2 == 0:
        return n == 2
    s = (n - 1 & 1 - n).bit_length() - 1
    for base in (2, 3, 5, 7):
        if base % n == 0:
            continue
        x = pow(base, n - 1 >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(least_product: int) -> list[int]:
    """The primes below ``PRIMES_BELOW``, falling, until their product reaches ``least_product``."""
    found, product, n = [], 1, PRIMES_BELOW - 1
    while product < least_product or not found:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def characteristic(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo a prime below 2^31, constant first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        row, other = k + 1, k + 1 + int(below[0])
        if other != row:
            h[[row, other]] = h[[other, row]]
            h[:, [row, other]] = h[:, [other, row]]
        times = h[row + 1:, k] * pow(int(h[row, k]), -1, p) % p
        h[row + 1:] = (h[row + 1:] - times[:, None] * h[row]) % p
        h[:, row] = (h[:, row] + (h[:, row + 1:] * times % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # poly[k]: of the leading k rows and columns
    poly[0, 0] = 1
    for k in range(d):
        poly[k + 1, 1:] = poly[k, :-1]
        weights, chain = np.empty(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * chain % p
            if i:
                chain = chain * int(h[i, i - 1]) % p
        poly[k + 1] = (poly[k + 1] - (weights[:, None] * poly[:k + 1] % p).sum(0)) % p
    return poly[d].tolist()


def bound(matrix: Matrix) -> int:
    """No coefficient is larger: the mean of the products of k roots is at most their mean to the k-th power."""
    d = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(d)) // d)
    return max(comb(d, k) * mean ** k for k in range(d + 1))


def polynomial(spark: SparkSession, matrix: Matrix) -> list[int]:
    """Coefficients of det(x - matrix) for a positive semidefinite matrix, constant first."""
    used = primes(2 * bound(matrix) + 1)
    product = prod(used)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(matrix, object)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = characteristic(exact, used[at])
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([at] * len(found), pa.int32()), pa.array(found, pa.int64())],
                                                 ["k", "at", "residue"])

    @F.udf("string")
    def combine(rows):
        value = sum(r.residue * pow(product // used[r.at], -1, used[r.at]) * (product // used[r.at]) for r in rows) % product
        return str(value - product if 2 * value > product else value)

    tasks = spark.range(0, len(used), 1, min(len(used), parts(spark))).mapInArrow(residues, "k int, at int, residue long")
    found = tasks.groupBy("k").agg(F.collect_list(F.struct("at", "residue")).alias("rows"))  # one number per prime
    return [int(r.value) for r in found.select("k", combine("rows").alias("value")).orderBy("k").collect()]


# --- roots and components -------------------------------------------------------------------------------------

def above(poly: list[int], at: int, scale: int) -> int:
    """How many roots of a polynomial with real roots only are larger than ``at / 2^scale``."""
    d = len(poly) - 1
    moved = [c * at ** i << scale * (d - i) for i, c in enumerate(poly)] if at else poly
    if at:  # the roots are those over ``at``; move them by one
        moved = moved[::-1]
        for i in range(d):
            moved[:d + 1 - i] = accumulate(moved[:d + 1 - i])
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign(poly: list[int], at: int, scale: int) -> int:
    """Sign of the polynomial at ``at / 2^scale``."""
    value, power = 0, 0
    for c in reversed(poly):
        value = value * at + (c << power)
        power += scale
    return (value > 0) - (value < 0)


def root(poly: list[int], k: int, bits: int = BITS) -> tuple[int, int, int, int]:
    """The k-th largest root (from 1), not 0, as (numerator, scale, which of its equals it is, how many equals).

    The numerator is over ``2^scale`` and rounded down to a multiple of one part in ``2^bits``.
    """
    low, scale = 0, 0
    high = 1 << (-poly[-2]).bit_length()  # beyond the sum of all roots
    over_low, over_high = above(poly, 0, 0), 0
    upper = None  # sign at ``high``, once only one root is left
    while high - low > (low >> bits):
        if high - low == 1:
            low, high, scale = low * 2, high * 2, scale + 1
        middle = (low + high) // 2
        if over_low - over_high == 1 and low:
            upper = sign(poly, high, scale) if upper is None else upper
            here = sign(poly, middle, scale)
            if not here:
                low = high = middle
                break
            if here == upper or not upper:
                if not upper:  # the root is ``high`` itself
                    low = high
                    break
                high = middle
            else:
                low = middle
            continue
        over = above(poly, middle, scale)
        if over >= k:
            low, over_low = middle, over
        else:
            high, over_high = middle, over
    return low, scale, k - over_high, over_low - over_high


def _solver(matrix: Matrix, shift: int, fraction: int = FRACTION):
    """Solves (matrix - shift) x = b in fixed-point numbers; ``shift`` has ``fraction`` fraction bits."""
    d = len(matrix)
    rows = [[(v << fraction) - (shift if i == j else 0) for j, v in enumerate(r)] for i, r in enumerate(matrix)]
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best] = rows[best], rows[k]
        order[k], order[best] = order[best], order[k]
        head = rows[k]
        head[k] = head[k] or 1  # the matrix is singular up to the rounding of its root
        for i in range(k + 1, d):
            row = rows[i]
            times = (row[k] << fraction) // head[k]
            rows[i] = row[:k] + [times] + [a - (times * b >> fraction) for a, b in zip(row[k + 1:], head[k + 1:], strict=True)]

    def solve(b: list[int]) -> list[int]:
        x = [b[i] for i in order]
        for i in range(d):
            x[i] -= sum(rows[i][j] * x[j] for j in range(i)) >> fraction
        for i in range(d - 1, -1, -1):
            x[i] = ((x[i] - (sum(rows[i][j] * x[j] for j in range(i + 1, d)) >> fraction)) << fraction) // rows[i][i]
        return x

    return solve


def _unit(v: list[int], against: list[list[int]], fraction: int = FRACTION) -> list[int]:
    """``v`` at right angles to the unit vectors ``against``, of length one."""
    for _ in range(2):
        size = isqrt(sum(x * x for x in v)) or 1
        v = [(x << fraction) // size for x in v]
        for u in against:
            dot = sum(a * b for a, b in zip(u, v, strict=True)) >> fraction
            v = [b - (dot * a >> fraction) for a, b in zip(u, v, strict=True)]
    size = isqrt(sum(x * x for x in v)) or 1
    return [(x << fraction) // size for x in v]


def component(matrix: Matrix, numerator: int, scale: int, which: int) -> list[float]:
    """The ``which``-th unit vector of the null space of ``matrix - root``; its largest entry is positive."""
    shift = numerator << FRACTION - scale if FRACTION >= scale else numerator >> scale - FRACTION
    solve, found = _solver(matrix, shift), []
    for start in range(which):
        v = [((i * 7919 + start * 104_729 + 12_345) * 2_654_435_761 % (1 << 32) - (1 << 31)) << FRACTION - 32 for i in range(len(matrix))]
        for _ in range(STEPS):
            v = _unit(solve(_unit(v, found)), found)
        found.append(v)
    v = found[-1]
    most = max(v, key=abs)
    return [x / (1 << FRACTION) if most > 0 else -x / (1 << FRACTION) for x in v]


@dataclass
class Whitening:
    """A fit: number and sum of the whole-number vectors, components (a row each), their variances and shares."""

    n: int
    total: list[int]
    components: list[list[float]]
    variances: list[float]
    shares: list[float]


def fit(rows: DataFrame, count: int = COMPONENTS) -> Whitening:
    """Fit on every row that ``usable`` gave."""
    spark = rows.sparkSession
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return Whitening(0, [], [], [], [])
    n, total = sums(rows, first.d)
    matrix = scatter(rows, n, total)
    whole = gcd(*(v for r in matrix for v in r))
    if not whole:  # no vector differs from another
        return Whitening(n, total, [], [], [])
    matrix = [[v // whole for v in r] for r in matrix]
    poly = polynomial(spark, matrix)
    rank = first.d - next(i for i, c in enumerate(poly) if c)
    trace = sum(matrix[i][i] for i in range(first.d))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                numerator, scale, which, _ = root(poly, k)
                value = Fraction(numerator, 1 << scale)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([float(value * whole / n ** 2)]), pa.array([float(value / trace)]),
                     pa.array([component(matrix, numerator, scale, which)], pa.list_(pa.float64()))], ["k", "variance", "share", "axis"])

    wanted = min(count, rank)
    tasks = spark.range(1, wanted + 1, 1, min(wanted, parts(spark)))
    found = tasks.mapInArrow(solve, "k long, variance double, share double, axis array<double>").orderBy("k").collect()
    return Whitening(n, total, [list(r.axis) for r in found], [r.variance for r in found], [r.share for r in found])


def _whiten(model: Whitening):
    """Function from whole-number vectors to (n x - total) and whitened rows."""
    near = np.array([s // model.n for s in model.total], np.int64)
    rest = np.array([s - model.n * int(c) for s, c in zip(model.total, near, strict=True)], object)
    axes = np.array(model.components) / np.sqrt(model.variances)[:, None]

    def apply(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x - near
        exact = np.int64 if int(np.abs(y).max(initial=0)) * model.n + model.n < 1 << 62 else object
        off = y.astype(exact) * model.n - rest.astype(exact)
        return off, (off / model.n).astype(float) @ axes.T

    return apply


def deviations(off: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; null beyond 64 bits."""
    most = int(np.abs(off).max(initial=0)) ** 2 * off.shape[1]
    found = (off * off if most < 1 << 63 else off.astype(object) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in found]


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of (covariance of the whitened rows - identity), measured over all rows."""
    size, count = len(model.total), len(model.components)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten = _whiten(model)
        products, mean = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            w = whiten(vectors(batch.column(0), size))[1]
            products, mean = products + w.T @ w, mean + w.sum(0)
        at = [(i, j) for i in range(count) for j in range(count)] + [(-1, j) for j in range(count)]
        i, j = zip(*at, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([*products.ravel(), *mean])], ["i", "j", "v"])

    # whitened rows are centred already; what is left of the mean is rounding
    found = {(r.i, r.j): r.v / model.n for r in _added(rows.select("v").mapInArrow(add, "i int, j int, v double"))}
    return max(abs(found[i, j] - found[-1, i] * found[-1, j] - (i == j)) for i in range(count) for j in range(count))


def whiten(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """Per row and component: n, deviation, whitened, explained, identity_error; ``rows`` as ``usable`` gave them."""
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    count, size = len(model.components), len(model.total)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not count:
            return
        on = _whiten(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                some = batch.slice(start, 2048)
                off, w = on(vectors(some.column(1), size))
                repeat = np.repeat(np.arange(len(w)), count)
                deviation = pa.array(deviations(off), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(w))), pa.array(np.full(len(repeat), model.n, np.int64)),
                     deviation.take(pa.array(repeat)), pa.array(w.ravel()), pa.array(np.tile(model.shares, len(w))), pa.array(np.full(len(repeat), error))], names)

    return rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(
        apply, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark, sf_dir):
    """Every embedding on the 32 strongest components, whitened."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    return whiten(rows, model, identity_error(rows, model) if model.components else 0.0)
