"""Line dedup by winnowing over line hashes.

A window is a span of consecutive lines that just reaches ``min_words`` words, seen
from its first line or from its last. Each window selects its smallest line hash as
anchor, so a repeated run of that many words always has a fingerprint: (anchor,
content of the window). Every line of such a run lies in a window that starts at it or
in the one that ends with the run, so deleting each window whose fingerprint has an
earlier place in document order (smallest id, then content hash, then line) deletes
all of the run and nothing else, wherever its parts were seen before.

Lines without a word are left out of runs and stay in the text unless they lie
inside a deleted run or between two. A run may repeat an earlier place of its own document; the
first copy stays.

Only line hashes are shuffled until the end, where deletions meet the texts once.
Fingerprints are reduced to their first occurrence on the map side, and a very
common line is one row per task there; the join back is an equi-join that adaptive
execution splits.

Defined cases: null and empty texts stay as they are; equal rows (id and text) are
one document, so neither loses lines to the other; a null id comes after all
others; an empty table gives no rows; other columns pass through
untouched, but for one named ``deleted_lines``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import let
from shelfmark.llm.common import keyed, others, restored, slim, table, unkeyed, words, written

MIN_WORDS = 50


def line_arrays(rows: DataFrame) -> DataFrame:
    """Per document the lines with a word: ``at`` (place among all lines), ``h`` (hash), ``n`` (words)."""
    split = F.split("body", "\n", -1)
    sized = F.transform(split, lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.size(words(x)).alias("n")))
    lines = F.filter(sized, lambda x: x["n"] > 0)
    out = rows.filter("body is not null").select("d", "c", lines.alias("lines"))
    return out.select("d", "c", F.transform("lines", lambda x: x["at"]).alias("at"), F.transform("lines", lambda x: x["h"]).alias("h"),
                      F.transform("lines", lambda x: x["n"]).alias("n")).filter(F.size("at") > 0).dropDuplicates(["d", "c"])


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per window: anchor (smallest line hash), content, and the window's first and last line.

    A line has a word at least, so a window never spans more than ``min_words`` lines.
    """

    def reach(part: Column) -> Column:
        grow = F.aggregate(part, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("len")),
                           lambda acc, x: F.when(acc["sum"] >= min_words, acc).otherwise(
                               F.struct((acc["sum"] + x).alias("sum"), (acc["len"] + 1).alias("len"))))
        return let(grow, lambda g: F.when(g["sum"] >= min_words, g["len"]))

    def window(first: Column, length: Column) -> Column:
        return F.when(length.isNotNull(), let(F.slice("h", first + 1, length), lambda part: F.struct(
            F.array_min(part).alias("anchor"), F.xxhash64(part).alias("content"), first.alias("i"), (first + length - 1).alias("j"))))

    def from_line(n: Column, i: Column) -> Column:
        length = F.when(n >= min_words, F.lit(1)).otherwise(reach(F.slice("n", i + 1, F.lit(min_words))))
        return let(length, lambda size: window(i, size))

    def to_line(n: Column, i: Column) -> Column:
        some = F.least(i + 1, F.lit(min_words))
        length = F.when(n < min_words, reach(F.reverse(F.slice("n", i - some + 2, some))))  # a line that is a window is one already
        return let(length, lambda size: window(i - size + 1, size))

    found = F.array_distinct(F.array_compact(F.concat(F.transform("n", from_line), F.transform("n", to_line))))
    return lines.select("d", "c", F.explode(found).alias("w")).select("d", "c", "w.*")


def spans(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Per document the runs to delete, as places (a, b) among all its lines, both included."""
    first = (found.groupBy("anchor", "content").agg(F.min(F.struct("d", "c", "i")).alias("o"), F.count("*").alias("times"))
             .filter("times > 1").select("anchor", "content", F.col("o.d").alias("d0"), F.col("o.c").alias("c0"), F.col("o.i").alias("i0")))
    later = found.join(first, ["anchor", "content"]).filter("not (d = d0 and c = c0 and i = i0)")
    each = later.groupBy("d", "c").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("seen"))
    empty = F.array().cast("array<struct<i:int,j:int>>")

    def step(runs: Column, w: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        grown = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["i"].alias("i"), F.greatest(last["j"], w["j"]).alias("j"))))
        return F.when((F.size(runs) > 0) & (last["j"] >= w["i"] - 1), grown).otherwise(F.concat(runs, F.array(w)))

    merged = each.select("d", "c", F.aggregate("seen", empty, step).alias("seen"))
    place = lambda k: F.get("at", k)
    return merged.join(lines.select("d", "c", "at"), ["d", "c"]).select(
        "d", "c", F.transform("seen", lambda w: F.struct(place(w["i"]).alias("a"), place(w["j"]).alias("b"))).alias("runs"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut from ``text``; ``deleted_lines`` counts the lines that went."""
    rows = keyed(docs)
    lines = written(line_arrays(rows), "lines")
    runs = spans(lines, windows(lines, min_words))
    joined = rows.join(runs, ["d", "c"], "left")
    inside = lambda k: F.exists("runs", lambda r: k.between(r["a"], r["b"]))
    cut = F.filter(F.split("body", "\n", -1), lambda _, k: ~inside(k))
    out = joined.select("row", F.when(F.col("runs").isNull(), F.col("body")).otherwise(F.array_join(cut, "\n")).alias("rest"),
                        F.when(F.col("runs").isNull(), F.lit(0)).otherwise(F.size(F.split("body", "\n", -1)) - F.size(cut)).alias("deleted"))
    return out.select(*unkeyed(others(docs, "deleted_lines"), "rest"), F.col("deleted").alias("deleted_lines"))


def op10_winnowing(spark, sf_dir):
    """Every document with the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs)


def stage(spark, docs, sf_dir):
    """Pipeline stage: texts without their repeated runs; documents that were nothing else go."""
    cut = dedup(slim(docs))
    left = cut.filter((F.col("deleted_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        size = F.when(F.col("deleted_lines") == 0, F.col("_rest.n_chars")).otherwise(F.length("text"))
        left = left.withColumn("_rest", F.col("_rest").withField("n_chars", size))
    return restored(left, docs.columns)
