"""Batch OCR of scanned books: submit, status, cancel, poll, list.

The service is an injected client.  File bytes are uploaded from the tasks and
results are written by the client to the shared folder and read back by Spark;
only batch records, a few per run, pass through the driver.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.operators import ocr
from shelfmark.schemas import OCR_BATCH_DDL
from shelfmark.session import shared_dir
from shelfmark.sources import files, tables
from shelfmark.sources.ledger import Ledger, key_of

log = logging.getLogger(__name__)

# States in which a batch gave nothing and its folders are free again.
FAILED_STATES = ("cancelled", "failed", "expired", "timeout_exceeded")
FOLDER_DDL = "batch_id string, folder_id string, file_id string"
UPLOAD_DDL = "folder_id string, page_count int, file_id string"
RESULT_DDL = "custom_id string, raw_text string, batch_status string, batch_error string, raw_chars int, batch_id string"


class OcrClient(Protocol):
    def upload(self, name: str, content: bytes) -> str: ...
    def submit(self, request_path: str) -> tuple[str, str, str]:
        """Returns (batch_id, request_file_id, status)."""
    def status(self, batch_id: str) -> str: ...
    def download(self, batch_id: str, target: str) -> None: ...
    def cancel(self, batch_id: str) -> str: ...


class OcrBatches:
    def __init__(self, spark: SparkSession, root: str, client: OcrClient):
        self.spark, self.root, self.client = spark, root.rstrip("/"), client

    def _read(self, name: str, ddl: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(ddl).parquet(path) if tables.exists(self.spark, path) \
            else self.spark.createDataFrame([], ddl)

    def batches(self) -> DataFrame:
        """Latest record of every batch; records are only appended."""
        log = self._read("batches", OCR_BATCH_DDL + ", at timestamp")
        last = log.groupBy("batch_id").agg(F.max_by(F.struct("*"), "at").alias("b"))
        return last.select("b.*").drop("at")

    def _record(self, rows: DataFrame) -> None:
        rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/batches")

    def results(self) -> DataFrame:
        return self._read("results", RESULT_DDL)

    def with_status(self, staging: DataFrame) -> DataFrame:
        """Staging rows with the state of the batch they are in."""
        folders = self._read("folders", FOLDER_DDL).join(self.batches().select("batch_id", "status"), "batch_id")
        folders = folders.select("batch_id", "folder_id", F.when(F.lower("status").isin(*FAILED_STATES), "cancelled").otherwise("submitted").alias("s"))
        got = self.results().select("batch_id", F.col("custom_id").alias("folder_id"), F.col("batch_status").alias("r"))
        # "submitted" sorts after the other states, so a failed folder sent again counts as taken.
        latest = folders.join(got, ["batch_id", "folder_id"], "left").groupBy("folder_id").agg(
            F.max(F.coalesce("r", "s")).alias("batch_status"))
        return staging.join(latest, "folder_id", "left")

    def pending(self, staging: DataFrame) -> DataFrame:
        return ocr.to_submit(self.with_status(staging))

    def preview(self, staging: DataFrame) -> DataFrame:
        """Books, pages and price of what ``submit`` would send."""
        return ocr.submit_summary(self.pending(staging))

    def submit(self, staging: DataFrame) -> str | None:
        """Upload (folder_id, page_count, content) rows that are pending and open one batch."""
        client, ledger, run = self.client, Ledger(f"{self.root}/ledger"), uuid.uuid4().hex

        def upload(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                # a repeated task finds the files its first attempt uploaded
                ids = [ledger.kept(key_of("upload", run, n), lambda n=n, c=c: client.upload(f"{n}.pdf", bytes(c))) for n, c in zip(frame["folder_id"], frame["content"])]
                yield frame[["folder_id", "page_count"]].assign(file_id=ids)

        scratch = shared_dir(self.spark, "uploads")
        self.pending(staging).select("folder_id", "page_count", "content").mapInPandas(upload, UPLOAD_DDL).write.parquet(scratch)
        sent = self.spark.read.parquet(scratch)
        if sent.isEmpty():
            return None
        request = shared_dir(self.spark, "requests")
        sent.select(ocr.request_line(F.col("folder_id"), F.col("file_id")).alias("value")).write.text(request)
        batch_id, request_id, status = client.submit(request)
        # One row per folder, so a batch of any size never becomes one cell.
        sent.select(F.lit(batch_id).alias("batch_id"), "folder_id", "file_id").write.mode("append").parquet(f"{self.root}/folders")
        total = F.sum("page_count")
        self._record(sent.agg(
            F.lit(batch_id).alias("batch_id"), F.lit(request_id).alias("request_file_id"), F.count("*").alias("books"),
            total.alias("total_pages"), ocr.cost(total).alias("cost_estimate"), F.lit(status).alias("status")))
        return batch_id

    def _polled(self) -> DataFrame:
        """Open batches with the state the service reports now; one that cannot be asked keeps its state."""
        states = []
        for r in ocr.open_batches(self.batches()).select("batch_id", "status").collect():  # few: the open batches
            try:
                states.append((r.batch_id, self.client.status(r.batch_id)))
            except Exception as exc:
                log.warning("batch %s cannot be asked: %s", r.batch_id, exc)
                states.append((r.batch_id, r.status))
        polled = self.spark.createDataFrame(states, "batch_id string, polled_status string")
        return self.batches().join(polled, "batch_id")

    def status(self) -> DataFrame:
        rows = self._polled()
        return ocr.batch_listing(rows.withColumn("status", F.col("polled_status")))

    def cancel(self, batch_id: str) -> str:
        answer = self.client.cancel(batch_id)
        rows = self.batches().where(F.col("batch_id") == batch_id)
        self._record(ocr.with_status(rows, batch_id, "cancelled"))
        return answer

    def poll(self, staging: DataFrame) -> list[str]:
        """Fetch the results of finished batches; returns the batches closed.

        Every state is recorded, so a batch that failed is closed and its folders may be
        sent again. A batch whose results cannot be fetched stays open and does not stop
        the others; results count only for folders of their own batch.
        """
        polled = shared_dir(self.spark, "polled")
        self._polled().write.parquet(polled)
        now = self.spark.read.parquet(polled)
        finished = ocr.finished_batches(now).select("batch_id")
        moved = now.where(F.col("polled_status") != F.col("status")).join(finished, "batch_id", "left_anti")
        state = F.lower("polled_status")
        self._record(moved.withColumn("status", F.when(state == "cancelled", "cancelled").when(state.isin(*FAILED_STATES), "failed").otherwise(
            F.col("polled_status"))).drop("polled_status"))
        client, target = self.client, shared_dir(self.spark, "ocr")

        def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                errors = []
                for batch_id in frame["batch_id"]:
                    try:
                        client.download(batch_id, f"{target}/{batch_id}")
                        errors.append(None)
                    except Exception as exc:
                        errors.append(str(exc) or type(exc).__name__)
                yield frame.assign(error=errors)

        fetched = f"{target}-fetched"
        finished.mapInPandas(fetch, "batch_id string, error string").write.parquet(fetched)
        answers = self.spark.read.parquet(fetched)
        for r in answers.where("error is not null").limit(20).collect():
            log.warning("results of batch %s cannot be fetched: %s", r.batch_id, r.error)
        good = answers.where("error is null").select("batch_id")
        if good.isEmpty():
            return []
        lines = files.ocr_results(self.spark, f"{target}/*").withColumn("batch_id", F.element_at(F.split("_metadata.file_path", "/"), -2))
        # results count only for folders of their own batch, and only those still staged
        own = self._read("folders", FOLDER_DDL).join(good, "batch_id", "left_semi").select("batch_id", F.col("folder_id").alias("custom_id"))
        mine = ocr.matched(lines.join(own, ["batch_id", "custom_id"], "left_semi"), staging)
        texts = ocr.result_texts(mine, "batch_id")
        texts.select(*[c.split()[0] for c in RESULT_DDL.split(", ")]).write.mode("append").parquet(f"{self.root}/results")
        self._record(self.batches().join(good, "batch_id", "left_semi").withColumn("status", F.lit("complete")))
        return sorted(r.batch_id for r in good.collect())  # few: the batches closed now
