"""Periodic run detection: seed-and-extend along diagonals.

A run with smallest period q and at least ``max(6, 4 q)`` words agrees with itself
q words later for at least 3 q words (5 for q = 1). So for the lags of one class,
``2^j <= q < 2^(j+1)``, every run holds two equal k-grams at lag q, where
``k = 3 * 2^j`` (5 for q = 1) is the least overlap such a run can have. Because k is
at least 1.5 q, a third copy between the two would give the run a smaller period
(Fine and Wilf), so the two are neighbours among the occurrences of their k-gram:
listing neighbouring occurrences in a document, one pair per position, finds every
run, and no k-gram's occurrences are ever paired all with all.

Each pair is a seed on the diagonal of its lag and is extended both ways by comparing
words. A table of the furthest word covered per lag skips seeds within a stretch that
is known already, so a run is walked once. K-grams are named by exact ranks (prefix
doubling), not by hashes. A class without a k-gram that recurs in a document ends that
document's search, as longer grams cannot recur either.

Rows stay where they are read: there is no shuffle, and a text's memory is about a
hundred bytes per word.

Defined cases: a null or blank text has no words and no runs; a null id is not
rewritten by the query; equal rows get equal results; an empty table gives no rows;
only ``doc_id`` and ``text`` are read. Ties of the exponent go to the smallest start,
then period.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.common import carried, table

carried(__name__)

LEAST, TIMES = 6, 4
BLOCK_WORDS = 200_000
Run = tuple[int, int, int]  # start, length, period
RESULT = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (left, right): equal pairs, equal numbers."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def ahead(grams: np.ndarray, by: int) -> np.ndarray:
    """``grams`` moved forward; what would start behind the end cannot recur, whatever is filled in."""
    out = np.zeros_like(grams)
    out[:len(grams) - by] = grams[by:] if by < len(grams) else 0
    return out


def agreement(words: np.ndarray, at: int, lag: int) -> int:
    """How many words from ``at`` on equal the word ``lag`` further on."""
    n, step, end = 0, 32, len(words) - lag
    while at + n < end:
        stop = min(at + n + step, end)
        other = np.flatnonzero(words[at + n:stop] != words[at + n + lag:stop + lag])
        if len(other):
            return n + int(other[0])
        n, step = stop - at, step * 2
    return n


def stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` whose words equal the word ``lag`` further on, as [start, end)."""
    back = agreement(words[:at + lag][::-1], 0, lag)
    return at - back, at + agreement(words, at, lag)


def seeds(words: np.ndarray, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per class of lags, shortest first: places and lags of the seeds, sorted by lag, then place.

    ``texts`` numbers the text of each word; every text ends with a word found nowhere else.
    """
    place = np.arange(len(words))
    one, size = ranks(words, np.zeros_like(words)), 1
    two = ranks(one, ahead(one, 1))
    while len(place):
        if size == 1:  # five words
            gram = ranks(ranks(two, ahead(two, 2)), ahead(one, 4))
        else:
            gram = ranks(two, ahead(one, 2 * size))
        order = np.argsort(gram, kind="stable")
        first, second = order[:-1], order[1:]
        again = (gram[first] == gram[second]) & (texts[first] == texts[second])
        first, second = first[again], second[again]
        lag = second - first
        fits = (lag >= size) & (lag < 2 * size)
        found, lags = first[fits], lag[fits]
        by = np.lexsort((found, lags))
        yield place[found[by]], lags[by]
        still = np.isin(texts, texts[first]) if len(first) else np.zeros(len(texts), bool)
        if not still.any():
            return
        if not still.all():
            place, texts, one, two = place[still], texts[still], one[still], two[still]
        one, size = two, size * 2
        two = ranks(one, ahead(one, size))


def runs_of(texts: list[list]) -> list[list[Run]]:
    """The maximal runs of each text, a list of words, sorted by start and period."""
    names: dict = {}
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    numbers = [names.setdefault(w, len(names)) for t in texts for w in (*t, None)]
    words = np.array(numbers, np.int64)
    ends = np.cumsum(sizes)
    words[ends - 1] = len(names) + np.arange(len(texts))
    found: list[list[Run]] = [[] for _ in texts]
    spans = set()
    for places, lags in seeds(words, np.repeat(np.arange(len(texts)), sizes)):
        furthest: dict[int, int] = {}
        for at, lag in zip(places.tolist(), lags.tolist(), strict=True):
            if at < furthest.get(lag, 0):
                continue
            start, end = stretch(words, at, lag)
            furthest[lag] = end
            length = end + lag - start
            if length >= max(LEAST, TIMES * lag) and (start, length) not in spans:  # a smaller period came before
                spans.add((start, length))
                text = int(np.searchsorted(ends, start, "right"))
                found[text].append((start - int(ends[text] - sizes[text]), length, lag))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words no run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period; the first of equal ones."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def blocks(rows: Iterable[tuple], size: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """Rows (id, words) in lists of about ``size`` words."""
    block, n = [], 0
    for row in rows:
        if block and n + len(row[1]) > size:
            yield block
            block, n = [], 0
        block.append(row)
        n += len(row[1]) + 1
    if block:
        yield block


def find(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, texts: bool = False) -> DataFrame:
    """Per document its runs in short: number, the strongest, and digests of all runs and of the words left.

    ``rewrite`` gives the words to look at, from the id and the text's own. With ``texts``, the runs
    (start, length, period) and the collapsed text come as well.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            split = ((i, (t.as_py() or "").encode().split()) for i, t in rows)  # at the six ASCII blanks
            for block in blocks((i, rewrite(i, w) if rewrite else w) for i, w in split):
                out = []
                for (doc_id, words), runs in zip(block, runs_of([w for _, w in block]), strict=True):
                    start, length, period = strongest(runs) or (None, None, None)
                    left = b" ".join(collapsed(words, runs))
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    row = [doc_id, len(words), len(runs), start, length, period, 1000 * length // period if runs else None,
                           sha256(listed.encode()).hexdigest(), sha256(left).hexdigest()]
                    out.append(row + [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], left.decode()] if texts else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = RESULT
    if texts:
        kinds += [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
        names += ["runs", "collapsed"]
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(search, schema)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: one document of ten, by the id's CRC, goes on repeating one passage from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    again = words[start:start + period]
    return words[:start] + (again * ((n - start) // period + 1))[:n - start]


def op12_runs(spark, sf_dir):
    """Every document with its runs in short, a tenth of the documents made periodic as the contract says."""
    return find(table(spark, sf_dir, "documents"), repeated_tail).drop("n_words")
