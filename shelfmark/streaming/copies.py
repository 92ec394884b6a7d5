"""Recognise copies in the stream from keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where Spark keeps keyed state on disk, and that it uploads changes only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_state_store(spark: SparkSession) -> None:
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)


class FirstCopy(StatefulProcessor):
    """Per digest: whether a file with it was met before. The earliest file of the first batch with it goes on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getValueState("met", "path string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.met.update((initialState["path"].iloc[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.met.exists():
            return
        first = None
        for frame in rows:  # one row is held, however many copies arrive at once
            frame = pd.concat([frame] if first is None else [first, frame]).sort_values(["modification_time", "path"], kind="stable")
            first = frame.head(1)
        self.met.update((first["path"].iloc[0],))
        yield first

    def close(self) -> None:
        pass


def first_copies(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """The streamed files (sha256, path, modification_time, ...) whose digest was never met, one per digest.

    ``known`` (sha256, path) is loaded into the state when the stream first starts; after
    that a micro-batch reads the state of its own digests only. The state keeps one path
    per digest on the executors' disks and in the checkpoint.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrivals.schema)
    return arrivals.groupBy("sha256").transformWithStateInPandas(
        FirstCopy(), columns, "Append", "None", initialState=known.select("sha256", "path").groupBy("sha256"))
