"""Streaming inbox: each micro-batch stages its files and moves them on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfmark.plans.ingest import Ingest
from shelfmark.schemas import MAX_FILES_PER_TRIGGER, POLL_SECONDS
from shelfmark.sources.files import inbox_stream
from shelfmark.sources.ledger import key_of
from shelfmark.streaming.copies import first_copies, use_state_store


def watch(ingest: Ingest, folder: str, checkpoint: str, continuous: bool = False,
          per_trigger: int = MAX_FILES_PER_TRIGGER, archive: str | None = None) -> StreamingQuery:
    """Watch ``folder``; by default process what is there and stop.

    Copies are recognised from state keyed by digest, first filled from the staged files,
    so a micro-batch costs the same however large the library is. A replayed micro-batch
    finds the state of its first run and overwrites what that staged.
    """
    use_state_store(ingest.spark)
    stream = key_of(checkpoint)[:12]

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest.stage_fresh(batch, f"{stream}-{batch_id:09d}")
        ingest.run_once()

    arrivals = ingest.looked(inbox_stream(ingest.spark, folder, per_trigger, archive))
    writer = (first_copies(arrivals, ingest.known_files()).writeStream
              .foreachBatch(handle).option("checkpointLocation", checkpoint))
    if continuous:
        return writer.trigger(processingTime=f"{POLL_SECONDS} seconds").start()
    return writer.trigger(availableNow=True).start()
