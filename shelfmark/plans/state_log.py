"""The staging state kept up to date: a change log, and snapshots of it.

Changes are appended in numbered batches. A snapshot named after the last batch in it
holds the folded state; the state now is the newest snapshot with the later batches
folded onto it, so a read costs the snapshot and the changes since, not the whole log.
A batch or snapshot written again replaces itself, so every step can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.operators.staging import fold_onto
from shelfmark.sources import tables

ENTRY_DDL = "folder_id string, field string, value string, at timestamp, seq bigint"
STATE_DDL = "folder_id string, field string, value string, at timestamp, seq bigint, created_at timestamp, updated_at timestamp"


class StateLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, changes: DataFrame, batch: int) -> None:
        """Add changes (folder_id, field, value, at); ``batch`` orders changes of one time."""
        rows = changes.select("folder_id", "field", "value", "at", F.lit(batch).cast("bigint").alias("seq"))
        rows.write.mode("overwrite").parquet(f"{self.root}/log/batch={batch:012d}")

    def _newest(self) -> tuple[int, DataFrame]:
        """Number and rows of the newest finished snapshot."""
        done = [f for f in tables.folders(self.spark, f"{self.root}/snapshots") if tables.exists(self.spark, f"{f}/_SUCCESS")]
        if not done:
            return -1, self.spark.createDataFrame([], STATE_DDL)
        return int(max(done).rsplit("=", 1)[-1]), self.spark.read.schema(STATE_DDL).parquet(max(done))

    def entries(self, after: int) -> DataFrame:
        """Changes of the batches after a number; the folders of earlier ones are not opened."""
        if not tables.exists(self.spark, f"{self.root}/log"):
            return self.spark.createDataFrame([], ENTRY_DDL)
        log = self.spark.read.schema(f"{ENTRY_DDL}, batch bigint").parquet(f"{self.root}/log")
        return log.where(F.col("batch") > after).drop("batch")

    def current(self) -> DataFrame:
        """The last value per folder and field, with the first and last time of change."""
        after, snapshot = self._newest()
        return fold_onto(snapshot, self.entries(after))

    def snapshot(self, batch: int) -> None:
        """Keep the state up to ``batch``, the last one appended."""
        self.current().write.mode("overwrite").parquet(f"{self.root}/snapshots/upto={batch:012d}")
