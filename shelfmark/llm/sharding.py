"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: no ring table
is stored, and with one more shard only the rows that the new shard takes move
(1 / (n + 1) of them). Slots number the rows of a shard without gaps although no
task ever holds a whole shard.

Defined cases: a null key hashes like any other key (one shard); a null text has
no bytes; repeated rows keep one slot each; an empty table gives no rows; further
columns, whatever their names, stay out of the way because only ``key`` and
``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import carried, table, whole

carried(__name__)

ROW_OVERHEAD = 16
# Rows that share one numbering group; the number of groups grows with the table.
GROUP_ROWS = 2_000
# The multiplier of the published jump hash.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into ``range(shards)``."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        key[moving] = key[moving] * STEP + np.uint64(1)
        draw = ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key; only its 64-bit hash travels to Python."""

    @F.pandas_udf("int")
    def place(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def assign(df: DataFrame, key: str = "doc_id", shards: int = 40) -> DataFrame:
    """``df`` with a column ``shard``; no shuffle."""
    return df.withColumn("shard", shard_of(F.col(key), shards))


def digests(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One small row per document: key, size and checksum of its text."""
    text = whole()
    return df.select(F.col(key), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
                     F.crc32(text).alias("text_crc32"))


def number(df: DataFrame, shards: int = 40, key: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows of ``digests`` with ``shard`` and a gapless ``slot`` within it.

    Equal rows are counted before the shuffle and spread out again at the end, so
    a key with a third of all rows is one row per task here. Slots run over groups
    (shard, hash group): each group is numbered on its own and starts where the
    counts of the groups before it end.
    """
    names = df.columns
    rows = df.groupBy(*names).agg(F.count("*").alias("_copies"))
    groups = max(1, -(-df.count() // (shards * group_rows)))
    rows = assign(rows, key, shards).withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(groups)))
    sums = rows.groupBy("shard", "_group").agg(F.sum("_copies").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "_group", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_group").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_offset", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    first = F.col("_start") + F.col("_offset")
    return (placed.join(starts, ["shard", "_group"])
            .select(*names, "shard", F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("slot")))


def write(df: DataFrame, path: str, key: str = "doc_id", shards: int = 40, files_per_shard: int = 1) -> None:
    """Write ``df`` as one folder per shard, each of ``files_per_shard`` files."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))
    (assign(df, key, shards).repartition(shards * files_per_shard, "shard", spread)
     .write.partitionBy("shard").parquet(path))


def op8_jump_hash(spark, sf_dir):
    """All documents in 40 shards by the law ``key``, and their shard if there were 41."""
    placed = number(digests(table(spark, sf_dir, "documents")), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                         shard_of(F.col("doc_id"), 41).alias("grown_shard"))
