"""Batch OCR bookkeeping: requests, submitted batches, polled results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.operators.conversion import ocr_text
from shelfmark.schemas import OCR_PRICE_PER_1K_PAGES

# The request shape and the batch states of the OCR service.
OCR_MODEL = "mistral-ocr-latest"
OCR_URL = "/v1/ocr"
CLOSED_STATES = ("complete", "cancelled", "failed")
SUCCESS_STATES = ("SUCCESS", "COMPLETED", "complete")
TAKEN_STATES = ("submitted", "complete")


def to_submit(staging: DataFrame) -> DataFrame:
    """Scanned books that are in no open or finished batch; unsorted, since the rows may carry file contents."""
    free = F.coalesce(~F.col("batch_status").isin(*TAKEN_STATES), F.lit(True))
    return staging.where((F.col("staging_category") == "cloud") & free)


def submit_summary(pending: DataFrame) -> DataFrame:
    pages = F.coalesce(F.sum("page_count"), F.lit(0))
    return pending.agg(F.count("*").alias("books"), pages.alias("total_pages"),
                       cost(pages).alias("cost_estimate"))


def cost(pages: Column) -> Column:
    return pages / F.lit(1000.0) * F.lit(OCR_PRICE_PER_1K_PAGES)


def request_line(custom_id: Column, file_id: Column, model: str = OCR_MODEL) -> Column:
    document = F.struct(F.lit("file_id").alias("type"), file_id.alias("file_id"))
    body = F.struct(F.lit(model).alias("model"), document.alias("document"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"),
                              F.lit(OCR_URL).alias("url"), body.alias("body")))


def open_batches(batches: DataFrame) -> DataFrame:
    return batches.where(~F.coalesce(F.col("status"), F.lit("")).isin(*CLOSED_STATES))


def finished_batches(batches: DataFrame) -> DataFrame:
    return open_batches(batches).where(F.col("polled_status").isin(*SUCCESS_STATES))


def with_status(batches: DataFrame, batch_id: str, status: str) -> DataFrame:
    return batches.withColumn("status", F.when(F.col("batch_id") == F.lit(batch_id), F.lit(status))
                              .otherwise(F.col("status")))


def batch_listing(batches: DataFrame) -> DataFrame:
    return batches.select("batch_id", "status", "books", "total_pages", "cost_estimate").orderBy("batch_id")


def convert_now(documents: DataFrame, recognise: Callable[[bytes], list[str]]) -> DataFrame:
    """(folder_id, content) -> (folder_id, raw_text, error): one synchronous call per document, its pages joined by rules."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages, errors = [], []
            for content in frame["content"]:
                try:
                    pages.append([str(p) for p in recognise(bytes(content))])
                    errors.append(None)
                except Exception as exc:
                    pages.append(None)
                    errors.append(str(exc) or type(exc).__name__)
            yield pd.DataFrame({"folder_id": frame["folder_id"], "pages": pages, "error": errors})

    got = documents.select("folder_id", "content").mapInPandas(run, "folder_id string, pages array<string>, error string")
    text = F.when(F.col("error").isNull(), ocr_text(F.col("pages")))
    empty = F.when(text == "", F.lit("no text was recognised"))
    return got.select("folder_id", F.when(text != "", text).alias("raw_text"), F.coalesce("error", empty).alias("error"))


def result_texts(results: DataFrame, *carry: str) -> DataFrame:
    """(custom_id, response) -> (custom_id, raw_text, batch_status, batch_error, raw_chars)."""
    text = ocr_text(F.col("response.body.pages.markdown"), "\n\n")
    rows = results.select(*carry, "custom_id", F.coalesce(text, F.lit("")).alias("raw_text"))
    empty = F.col("raw_text") == ""
    return rows.select(
        *carry, "custom_id", F.when(~empty, F.col("raw_text")).alias("raw_text"),
        F.when(empty, "failed").otherwise("complete").alias("batch_status"),
        F.when(empty, "empty result").alias("batch_error"),
        F.when(~empty, F.length("raw_text")).alias("raw_chars"))


def matched(results: DataFrame, staging: DataFrame) -> DataFrame:
    ids = staging.select(F.col("folder_id").alias("custom_id"))
    return results.join(ids, "custom_id", "left_semi")


def unmatched(results: DataFrame, staging: DataFrame) -> DataFrame:
    ids = staging.select(F.col("folder_id").alias("custom_id"))
    return results.join(ids, "custom_id", "left_anti")
