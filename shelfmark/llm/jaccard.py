"""Exact Jaccard similarity join on word shingles, as connected groups.

Documents with equal shingle sets are one node. A node's shingles are put in one
global order, rarest first; two sets of similarity ``4 / 5`` or more share a
shingle among the first ``n - ceil(4 n / 5) + 1``. Shingles that only one node has
lead that order and can never match, so most nodes drop out at once.

1. A first pass sends the two fifths of each set with the smallest hashes to the tasks
   that count them; linked sets share a sure number of these, so most nodes drop out.
   The others' shingles are sent and counted in full. Frequent shingles are recognised
   while the texts are read and are spread over many tasks; they come last in the
   order, as their counts are the largest.
2. Per prefix shingle, all nodes are compared with one pivot: the node with the
   fewest shingles of its own, in a family of edited copies the one nearest the
   original. Length, positional and suffix filters come first, then one exact check
   per pair.
3. Links give components. What is left are pairs with a common prefix shingle that
   lie in different components; these are compared too, each of the smaller parts of
   a shingle's nodes against all, so a large family is never expanded into pairs.

Since every pair that could be a link was compared or is connected already, the
components are exact, for any size of group.

Defined cases: null and blank texts have no shingles and stand alone; a text of
fewer than five words is one shingle; repeated rows share their node; a null id is the
largest id and comes out null; an empty table
gives no rows; only ``doc_id`` and ``text`` are read. Shingles and sets are named by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfmark.llm.common import LAST, carried, keyed, table, unkeyed, written
from shelfmark.llm.graph import components

carried(__name__)

WORDS = 5
# At most so many shingles are treated as frequent; the number bounds a broadcast and
# only decides how rows are dealt, never what is found.
FREQUENT = 10_000
SALTS = 64
# Low bits of shingles and of set keys that the first pass leaves out.
DROPPED, KEY_DROPPED = 16, 24
LOOKED_AT = 1024
MULTIPLIER, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; ASCII letters are lower-cased."""
    found = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    span = min(size, len(hashes))
    if not span:
        return hashes
    mixed = np.full(len(hashes) - span + 1, span, np.uint64)
    for k in range(span):
        mixed = mixed * MULTIPLIER + hashes[k:len(hashes) - span + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= FINISH
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _read(rows: DataFrame) -> DataFrame:
    """Per document its set's size and key; besides, rows (shingle, count) of shingles that are frequent in a batch."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, n, keys, some = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], [], []
            step = max(1, len(ids) // LOOKED_AT)
            for i, text in enumerate(batch.column(2)):
                found = shingle_set(text.as_py())
                n.append(len(found))
                keys.append(set_key(found))
                if i % step == 0:
                    some.append(found)
            every, counts = np.unique(np.concatenate(some), return_counts=True) if some else (np.empty(0, np.uint64), np.empty(0, int))
            often = counts >= max(8, len(some) // 100)
            every, counts = every[often].view(np.int64), counts[often] * step
            gap = [None] * len(every)
            columns = [ids + gap, contents + gap, n + gap, np.array(keys, np.uint64).view(np.int64).tolist() + gap,
                       [None] * len(ids) + every.tolist(), [None] * len(ids) + counts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["d", "c", "n", "k", "h", "often"])

    return rows.select("d", "c", "text").mapInArrow(summarise, "d long, c long, n long, k long, h long, often long")


def _shingles(rows: DataFrame, part: Callable[[int], int] = lambda n: n, dropped: int = 0, key_dropped: int = 0, at_once: int = 256) -> DataFrame:
    """Rows (h, k, s) of the ``part(n)`` smallest shingles of each document's set; s is a salt.

    ``dropped`` low bits are left out of the shingles' hashes and ``key_dropped`` of the sets' keys, to send fewer bytes.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                some = batch.slice(start, at_once)
                sets = [shingle_set(t.as_py()) for t in some.column(1)]
                keys = (np.array([set_key(x) for x in sets], np.uint64) >> np.uint64(key_dropped)).view(np.int64)
                sets = [x[:part(len(x))] >> np.uint64(dropped) for x in sets]
                sizes = [len(x) for x in sets]
                salts = np.array(some.column(0).to_pylist(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(keys, sizes)),
                                                  pa.array(np.repeat(salts, sizes))], ["h", "k", "s"])

    salt = F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")
    return rows.select(salt.alias("s"), "text").mapInArrow(spread, "h long, k long, s int")


def _dealt(shingles: DataFrame, frequent: DataFrame) -> DataFrame:
    """Shingles brought together by hash, frequent ones over ``SALTS`` tasks, with ``df`` (at least 2: others go)."""
    rows = shingles.join(F.broadcast(frequent), "h", "left")
    together = rows.withColumn("s", F.when(F.col("often").isNotNull(), F.col("s")).otherwise(F.lit(0))).repartition("h", "s")
    counted = F.coalesce(F.col("often"), F.count("*").over(Window.partitionBy("h", "s")))
    return together.withColumn("df", counted).filter("df > 1")


def needed(n: Column) -> Column:
    """Least overlap of a set of size n with any partner: ceil(4 n / 5)."""
    return F.floor((n * 4 + 4) / 5)


def first_part(n: int) -> int:
    """How many of a set's smallest shingles the first pass looks at: two fifths, at least a prefix."""
    return max(n - (4 * n + 4) // 5 + 1, (2 * n + 4) // 5)


def first_shared(n: Column) -> Column:
    """How many of them two linked sets have in common at least, for the smaller partner's size.

    Prefixes of length ``n - needed(n) + j`` of two linked sets share j; ``first_part``
    has j = ceil(2 n / 5) - floor(n / 5), and a partner has at least ``needed(n)`` shingles.
    """
    m = needed(n)
    return F.greatest(F.ceil(m * 2 / 5) - F.floor(m / 5) - 1, F.lit(1))


def promising(rows: DataFrame, documents: DataFrame, frequent: DataFrame) -> DataFrame:
    """The texts of nodes that may have a partner, one per node.

    Only two fifths of the shingles are sent for this, and only the few texts left are
    sent whole afterwards.
    """
    # Fewer bits can only make more shingles look shared, so no node is lost by them.
    short = frequent.withColumn("h", F.shiftrightunsigned("h", DROPPED)).groupBy("h").agg(F.max("often").alias("often"))
    # Sets whose shortened keys are equal are counted together, which can only make them look more promising.
    shared = _dealt(_shingles(rows, first_part, DROPPED, KEY_DROPPED), short).groupBy(F.col("k").alias("short")).agg(F.count("*").alias("shared"))
    nodes = documents.filter("n > 0").groupBy("k").agg(F.first("n").alias("n"), F.min(F.struct("d", "c")).alias("place"))
    left = nodes.withColumn("short", F.shiftrightunsigned("k", KEY_DROPPED)).join(shared, "short").filter(F.col("shared") >= first_shared(F.col("n"))).select("place.*")
    return rows.join(left, ["d", "c"], "left_semi")


def prefixes(rows: DataFrame, documents: DataFrame, frequent: DataFrame) -> DataFrame:
    """Nodes that may have a partner: k, n, own (shingles nobody else has), shared (in the global order)."""
    once = _dealt(_shingles(promising(rows, documents, frequent)), frequent).select("h", "s", "k", "df").distinct()
    shared = once.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    nodes = documents.filter("n > 0").groupBy("k").agg(F.first("n").alias("n"))
    out = shared.join(nodes, "k").select("k", "n", (F.col("n") - F.size("shared")).alias("own"), F.transform("shared", lambda x: x["h"]).alias("shared"))
    return out.filter(F.col("own") < F.col("n") - needed(F.col("n")) + 1)


def _may_link(a: str, b: str) -> Column:
    """Length and positional filters at a common shingle (0-based positions in the global order)."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    overlap = F.floor((na * 4 + nb * 4 + 8) / 9)  # ceil(0.8 / 1.8 * (na + nb))
    rest = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))
    return (F.least(na, nb) * 5 >= F.greatest(na, nb) * 4) & (rest >= overlap)


def differ(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the symmetric difference of two sorted arrays: the suffix filter's recursive split."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    half = len(y) // 2
    cut = int(np.searchsorted(x, y[half]))
    return differ(x[:cut], y[:half], depth - 1) + differ(x[cut:], y[half:], depth - 1)


@F.pandas_udf(T.BooleanType())
def linked(na: pd.Series, own_a: pd.Series, a: pd.Series, nb: pd.Series, own_b: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for n1, o1, x, n2, o2, y in zip(na, own_a, a, nb, own_b, b):
        overlap = -(-4 * (n1 + n2) // 9)
        x, y = np.sort(x), np.sort(y)
        if o1 + o2 + differ(x, y) > n1 + n2 - 2 * overlap:
            out.append(False)
            continue
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(bool(5 * common >= 4 * (n1 + n2 - common)))
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones among distinct pairs (a, b) of nodes."""
    side = lambda s: sets.select(F.col("k").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "own", "shared")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(linked("n_a", "own_a", "shared_a", "n_b", "own_b", "shared_b")).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with n and k, roots of the nodes that have a link)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("c"), "text")
    read = written(_read(rows), "sets")
    documents = read.filter("h is null").select("d", "c", "n", "k")
    often = read.filter("h is not null").groupBy("h").agg(F.sum("often").alias("often"))
    # Beyond any exact count, so that these come last.
    frequent = often.orderBy(F.desc("often"), "h").limit(FREQUENT).withColumn("often", F.col("often") + F.lit(1 << 40))
    sets = written(prefixes(rows, documents, frequent), "prefixes")
    inside = F.slice("shared", F.lit(1), (F.col("n") - needed(F.col("n")) + 1 - F.col("own")).cast("int"))
    entries = sets.select("k", "n", "own", F.posexplode(inside).alias("at", "h")).select("h", "k", "n", "own", (F.col("own") + F.col("at")).alias("pos"))

    pivots = entries.groupBy("h").agg(F.min(F.struct("own", "k", "n", "pos")).alias("p"), F.count("*").alias("size")).filter("size > 1")
    star = entries.join(pivots.select("h", F.col("p.k").alias("pk"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos")), "h")
    pairs = star.filter((F.col("k") != F.col("pk")) & _may_link("", "p")).select(*_ordered("k", "pk")).distinct()
    links = written(_verified(pairs, sets), "links")
    roots = written(components(links), "roots")

    # Pairs in different components with a common prefix shingle.
    placed = entries.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    parts = placed.groupBy("h", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("h", "main")
    # The table's rows in shared prefixes with more than one component, read twice.
    open_rows = written(placed.join(main, "h"), "open")
    few = open_rows.filter("root <> main").select("h", *(F.col(c).alias(f"q{c}") for c in ("k", "n", "pos", "root")))
    rest = open_rows.join(few, "h").filter((F.col("root") != F.col("qroot")) & _may_link("", "q")).select(*_ordered("k", "qk")).distinct()
    more = written(_verified(rest, sets), "links")
    label = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    between = (more.join(label("a"), "a", "left").join(label("b"), "b", "left")
               .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    if between.isEmpty():
        return documents, roots
    above = components(between)
    known = roots.union(more.select(F.explode(F.array("a", "b")).alias("node"), F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    final = known.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return documents, final


def _placed(docs: DataFrame) -> DataFrame:
    """(d, c, n, rep) of every document: ``rep`` is the smallest (id, content) of its group."""
    documents, roots = groups(docs)
    rooted = documents.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = rooted.filter("n > 0").groupBy("root").agg(F.min(F.struct("d", "c")).alias("rep"))
    grouped = rooted.filter("n > 0").join(least, "root").select("d", "c", "n", "rep")
    return grouped.union(documents.filter("n = 0").select("d", "c", "n", F.struct("d", "c").alias("rep")))


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    known = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return _placed(docs).select(known("d").alias("doc_id"), F.col("n").alias("n_shingles"), known("rep.d").alias("component_id"))


def op9_prefix_join(spark, sf_dir):
    """Every document with the size of its shingle set and its group."""
    return cluster(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: of each group the document with the smallest id stays; equal rows are one document."""
    stay = _placed(docs).filter((F.col("d") == F.col("rep.d")) & (F.col("c") == F.col("rep.c"))).select("d", "c").distinct()
    kept = keyed(docs).join(stay, ["d", "c"], "left_semi").dropDuplicates(["d", "c"])
    return kept.select(*unkeyed(docs.columns))
