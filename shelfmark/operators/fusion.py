"""Vector ranking, rank fusion and the three retrieval modes.

Ranked lists hold at most ``OVER_FETCH * k`` rows (the limits compile to
``TakeOrderedAndProject``), so the windows, the fusion and the broadcasts below
work on data bounded by the request, never by the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions.similarity import nearest_of, squared_l2
from shelfmark.operators.keyword import apply_filters, top_scores
from shelfmark.schemas import OVER_FETCH, RRF_K
from shelfmark.session import BROADCAST_MAX_ROWS


def numbered(ranked: DataFrame, *order: Column | str) -> DataFrame:
    """Add the 1-based position of a short, already limited list."""
    return ranked.withColumn("rn", F.row_number().over(Window.orderBy(*order)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a list whose length is bounded by ``rows``."""
    return F.broadcast(df) if rows <= BROADCAST_MAX_ROWS else df


def nearest(
    children: DataFrame, query: Sequence[float], n: int,
    book_id: str | None = None, author: str | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """The ``n`` children closest to ``query``; filters apply before the cut.

    Children without a usable vector have no distance and are left out.
    """
    rows = apply_filters(children, book_id, author)
    measured = rows.select("id", "parent_id", *carry, squared_l2(F.col("vector"), query).alias("_distance"))
    return measured.where("_distance is not null").orderBy("_distance", "id").limit(n)


# Questions that travel with one scan of the children.
QUESTIONS = 1024


def nearest_many(children: DataFrame, questions: DataFrame, n: int, book_id: str | None = None, author: str | None = None) -> DataFrame:
    """The ``n`` nearest children of every question (qid, vector): (qid, id, parent_id, _distance, rn).

    The children are scanned once per ``QUESTIONS`` questions. A task multiplies its batches with the
    block of questions and keeps n rows per question, so what is shuffled is n rows per question and
    task, never a pair per child. A question without a usable vector has no rows.
    """
    rows = apply_filters(children, book_id, author).select("id", "parent_id", "vector")
    found: list[DataFrame] = []
    for block in batched(questions.select("qid", "vector").where("vector is not null").toLocalIterator(), QUESTIONS):
        for width in sorted({len(q.vector) for q in block}):
            own = [q for q in block if len(q.vector) == width and None not in q.vector]
            if own and width:
                near = rows.mapInArrow(nearest_of([q.vector for q in own], n), "q int, id string, parent_id string, _distance double")
                names = F.array(*(F.lit(q.qid) for q in own))
                part = near.select(F.get(names, F.col("q")).alias("qid"), "id", "parent_id", "_distance")
                found.append(part)
    none = questions.select("qid").limit(0).selectExpr("qid", "'' as id", "'' as parent_id", "0D as _distance")
    best = Window.partitionBy("qid").orderBy("_distance", "id")
    return reduce(DataFrame.unionByName, found, none).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= n)


def rank_share(position: Column) -> Column:
    """Reciprocal-rank contribution of a 1-based position."""
    return F.lit(1.0) / (F.lit(RRF_K) + position)


def fuse(vector_list: DataFrame, keyword_list: DataFrame, k: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, _rrf_score, place) of the ``k`` best parents of two ranked lists.

    Every child row of a parent contributes.  Shares are added in list order and
    ties keep the order of first appearance, the vector list before the other.
    """
    votes = vector_list.select(F.col("parent_id").alias("id"), F.lit(0).alias("src"), "rn", *carry).unionByName(
        keyword_list.select("id", F.lit(1).alias("src"), "rn", *carry))
    ballots = votes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("src", "rn"))).alias("votes"),
                                       *(F.first(c).alias(c) for c in carry))
    scored = ballots.select(
        "id", *carry, F.col("votes")[0].alias("first"),
        F.aggregate("votes", F.lit(0.0), lambda s, v: s + rank_share(v["rn"])).alias("_rrf_score"),
    )
    best = scored.orderBy(F.desc("_rrf_score"), "first").limit(k)
    return numbered(best, F.desc("_rrf_score"), "first").select(
        "id", *carry, "_rrf_score", F.col("rn").alias("place"))


def hybrid(vector_list: DataFrame, keyword_list: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """Fused parents; one that is missing from the table drops out after the cut."""
    top = fuse(vector_list, keyword_list, k)
    return parents.join(small(top, k), "id").orderBy("place")


def best_children(vector_list: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, place, _score): the first child of every parent and ``1 - distance``."""
    best = vector_list.groupBy("parent_id").agg(F.min(F.struct("rn", "_distance", *carry)).alias("best"))
    return best.select(F.col("parent_id").alias("id"), *(F.col(f"best.{c}").alias(c) for c in carry), F.col("best.rn").alias("place"),
                       (F.lit(1.0) - F.col("best._distance")).alias("_score"))


def semantic(vector_list: DataFrame, parents: DataFrame, k: int, fetched: int) -> DataFrame:
    """Parents of the nearest children, best child first; missing ones never take a place."""
    return parents.join(small(best_children(vector_list), fetched), "id").orderBy("place").limit(k)


def keyword(scored_parents: DataFrame, k: int) -> DataFrame:
    """First ``k`` of the over-fetched keyword list."""
    return numbered(top_scores(scored_parents, k), F.desc("_score"), "id").withColumnRenamed("rn", "place")


def fetch_size(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return OVER_FETCH * k
