"""Send finished books to an e-reader and keep the ones that could not be sent."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from shelfmark.functions.text import delivery_label, safe_file_name
from shelfmark.session import shared_dir
from shelfmark.sources.config import Kindle
from shelfmark.sources.ledger import Ledger, Unconfirmed, key_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# sender(subject, file_name, content) delivers one attachment or raises.
Sender = Callable[[str, str, bytes], None]
# builder(markdown, metadata) makes an EPUB from cleaned text.
Builder = Callable[[str, dict], bytes]
RESULT_DDL = "folder_id string, sent boolean, outbox_name string"
SENT_COLUMNS = ("folder_id", "route", "file_name", "subject", "title", "author", "description", "subjects", "clean_text", "content")


@dataclass(frozen=True)
class Delivery:
    settings: Kindle
    sender: Sender | None = None
    builder: Builder | None = None
    # confirm(key) asks the service whether a delivery whose task died went out.
    confirm: Callable[[str], bool] | None = None

    @property
    def configured(self) -> bool:
        s = self.settings
        return bool(s.enabled and s.kindle_email and s.sender_email and s.resend_api_key and self.sender)

    def key(self, folder_id: str) -> str:
        """One delivery: a book to an address."""
        return key_of("delivery", folder_id, self.settings.kindle_email)


def route(books: DataFrame) -> DataFrame:
    """EPUB sources go out as they are, PDF sources as an EPUB of the cleaned text."""
    original = F.col("file_type") == "epub"
    return books.select(
        *books.columns,
        F.when(original, "original").otherwise("rebuilt").alias("route"),
        F.when(original, F.lit("source.epub")).otherwise(safe_file_name(F.col("title"))).alias("file_name"),
        delivery_label(F.col("title"), F.col("author")).alias("subject"))


@dataclass
class Report(WriterCommitMessage):
    """What one task did."""

    task: int
    sent: int = 0
    failed: int = 0
    unconfirmed: int = 0


class OutboxWriter(DataSourceWriter):
    """Sends each row once, whatever becomes of its task; the ledger holds the outcome of every row."""

    def __init__(self, delivery: Delivery, ledger: Ledger, run: str):
        self.delivery, self.ledger, self.run = delivery, ledger, run

    def _send(self, row: Row) -> None:
        content = row.content
        if row.route == "rebuilt":
            about = {"title": row.title, "author": row.author, "lang": "en", "description": row.description, "subjects": list(row.subjects or ())}
            content = self.delivery.builder(row.clean_text, about)
        self.delivery.sender(row.subject, row.file_name, bytes(content))

    def write(self, iterator: Iterator[Row]) -> Report:
        context = TaskContext.get()
        report = Report(context.partitionId() if context else -1)
        for row in iterator:
            try:
                self.ledger.once(self.delivery.key(row.folder_id), lambda: self._send(row), self.delivery.confirm)
                report.sent += 1
            except Unconfirmed:
                report.unconfirmed += 1
            except Exception:  # written down with its reason; the outbox copy is for the user to send
                report.failed += 1
        return report

    def _close(self, state: str, messages: list) -> None:
        reports = [m for m in messages if m is not None]
        self.ledger.put(key_of("run", self.run), state, {
            "tasks": len(reports), **{n: sum(getattr(m, n) for m in reports) for n in ("sent", "failed", "unconfirmed")}})

    def commit(self, messages: list) -> None:
        self._close("done", messages)

    def abort(self, messages: list) -> None:
        """Nothing is taken back: what was sent stays written down, and the next run goes on from there."""
        self._close("aborted", messages)


def outbox(delivery: Delivery, ledger: Ledger, run: str) -> type[DataSource]:
    """The data source to write routed books to."""

    class Outbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return "book_outbox"

        def writer(self, schema, overwrite: bool) -> OutboxWriter:
            return OutboxWriter(delivery, ledger, run)

    return Outbox


def outcomes(ids: DataFrame, delivery: Delivery, ledger: Ledger) -> DataFrame:
    """(folder_id, sent, outbox_name) of (folder_id, file_name) as the ledger has them."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            states = [(ledger.get(delivery.key(i)) or {}).get("state") for i in frame["folder_id"]]
            yield pd.DataFrame({"folder_id": frame["folder_id"], "sent": [s == "done" for s in states],
                                "outbox_name": [None if s == "done" else n for s, n in zip(states, frame["file_name"])]})

    return ids.select("folder_id", "file_name").mapInPandas(look, RESULT_DDL)


def deliver(books: DataFrame, delivery: Delivery, ledger: str | None = None) -> DataFrame:
    """Send the books; (folder_id, sent, outbox_name): switched off counts as sent, a failure names its outbox copy.

    ``ledger`` is a folder that outlives the run, so a book is never sent twice; without
    one, only within this run.
    """
    if not delivery.settings.enabled:
        return books.select("folder_id", F.lit(True).alias("sent"), F.lit(None).cast("string").alias("outbox_name"))
    if not delivery.configured:
        return books.select("folder_id", F.lit(False).alias("sent"), F.lit(None).cast("string").alias("outbox_name"))
    spark = books.sparkSession
    run = shared_dir(spark, "delivery")
    kept = Ledger(ledger or f"{run}-ledger")
    routed = route(books)
    # The ids are written before anything is sent, so outcomes are asked for exactly these.
    routed.select("folder_id", "file_name").write.parquet(run)
    spark.dataSource.register(outbox(delivery, kept, run))
    routed.select(*(n if n in routed.columns else F.lit(None).alias(n) for n in SENT_COLUMNS)).write.format("book_outbox").mode("append").save()
    return outcomes(spark.read.parquet(run), delivery, kept)
