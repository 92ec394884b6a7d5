"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``a``; combined on the map side, so hubs cost little."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node it reaches.

    Rounds end when the edges no longer change; each is written, so lineage stays
    short. The number of rounds grows with the logarithm of the graph's width.
    """
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        before, now = now, written(_small_star(_large_star(now)).filter("a <> b").distinct(), "edges")
        # Both hold distinct edges, so equal numbers and none missing mean equal sets.
        if now.count() == before.count() and now.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
