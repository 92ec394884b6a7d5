"""Convert page ranges in parallel and put the pieces back in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import let
from shelfmark.schemas import CLOUD_PAGE_BATCH, LOCAL_PAGE_BATCH

PAGE_JOIN = "\n\n"
OCR_PAGE_JOIN = "\n\n---\n\n"
RANGES_PER_GROUP = 64


def page_ranges(total: Column, size: int) -> Column:
    """``array<(first,stop)>`` of consecutive ``[first, stop)`` page ranges."""
    starts = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)).cast("int"), F.lit(size))
    ranges = F.transform(starts, lambda s: F.struct(
        s.alias("first"), F.least(s + size, total.cast("int")).alias("stop")))
    return F.when(total > 0, ranges).otherwise(F.array().cast("array<struct<first:int,stop:int>>"))


def batch_count(total: Column, size: int = CLOUD_PAGE_BATCH) -> Column:
    return F.ceil(total / F.lit(size)).cast("int")


def work_items(documents: DataFrame, size: int = LOCAL_PAGE_BATCH) -> DataFrame:
    """(file, total_pages, ...) -> one row per page range, the unit of conversion."""
    rest = [c for c in documents.columns if c != "total_pages"]
    items = documents.select(*rest, F.posexplode(page_ranges(F.col("total_pages"), size)).alias("part", "r"))
    return items.select(*rest, "part", F.col("r.first").alias("first"), F.col("r.stop").alias("stop"))


def split_pages(pages: Column, size: int = LOCAL_PAGE_BATCH) -> Column:
    """The pages of each range, cut inside the row, so the text is not repeated per range."""
    return let(pages, lambda p: F.transform(page_ranges(F.size(p), size), lambda r: F.slice(p, r["first"] + 1, r["stop"] - r["first"])))


def remaining(items: DataFrame, converted: DataFrame) -> DataFrame:
    """Resume: only the ranges that have no stored result yet."""
    return items.join(converted.select("file", "part"), ["file", "part"], "left_anti")


def convert(items: DataFrame, converter: Callable[[str, int, int], str]) -> DataFrame:
    """Run ``converter(file, first, stop)`` per range; a failure becomes its ``error`` text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts, errors = [], []
            for row in frame.itertuples(index=False):
                try:
                    texts.append(converter(row.file, row.first, row.stop))
                    errors.append(None)
                except Exception as exc:  # reported per range, never fails the job
                    texts.append(None)
                    errors.append(str(exc))
            yield frame[["file", "part"]].assign(text=texts, error=errors)

    return items.select("file", "part", "first", "stop").mapInPandas(
        run, "file string, part int, text string, error string")


def ordered_text(parts: DataFrame, key: str, position: str, text: str, glue: str = PAGE_JOIN) -> DataFrame:
    """Concatenate the pieces of each key in position order.

    Pieces are first joined in groups of 64 neighbours and then per key, so no
    task sorts more than a short list before the one string that is the result.
    """
    group = F.floor(F.col(position) / RANGES_PER_GROUP)

    def joined(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", column))),
                                        lambda x: x[column]), glue)

    rows = parts.select(key, F.col(position).alias("_at"), F.col(text).alias("_text"), group.alias("_group"))
    partial = rows.groupBy(key, "_group").agg(joined("_text").alias("_text"))
    partial = partial.select(key, F.col("_group").alias("_at"), "_text")
    return partial.groupBy(key).agg(joined("_text").alias(text))


def whole_documents(converted: DataFrame) -> DataFrame:
    """(file, raw_text, error): one failed range fails the whole document."""
    failed = converted.groupBy("file").agg(F.max("error").alias("error"),
                                           F.count(F.when(F.col("text").isNull(), 1)).alias("missing"))
    texts = ordered_text(converted.where(F.col("text").isNotNull()), "file", "part", "text")
    joined = failed.join(texts, "file", "left")
    return joined.select(
        "file", F.when(F.col("missing") == 0, F.col("text")).alias("raw_text"),
        F.when(F.col("missing") > 0, F.coalesce("error", F.lit("conversion returned no text"))).alias("error"))


def ocr_text(pages: Column, glue: str = OCR_PAGE_JOIN) -> Column:
    """Join the non-empty page texts of one OCR answer."""
    kept = F.filter(pages, lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, glue)
