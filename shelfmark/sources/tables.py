"""Parquet tables of append-only segments, partitioned by a hash bucket of their key.

Each run adds a folder ``batch=...`` to a table.  Hashing keeps buckets even,
whatever the book names, and avoids one directory per book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below a path."""
    if not exists(spark, path):
        return []
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)
    return [f.getPath().toString() for f in listed if f.isDirectory()]


def open_segments(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """All segments of a table, or an empty one with its schema when nothing was written yet."""
    schema = f"{ddl}, batch string, bucket int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no folder yet
        return spark.createDataFrame([], schema)


def write_segment(rows: DataFrame, path: str, batch: str, sort: list[str], dealt: bool = True) -> None:
    """Write rows with a ``bucket`` as one segment that nothing reads before it is committed.

    Dealing by hash needs no sampling pass, so costly columns are computed once; a bucket
    that is large for one task is dealt to several, and becomes several files. Sorted files
    let min/max statistics skip row groups. Rows that already lie by bucket need no dealing.
    """
    rows = rows.hint("rebalance", "bucket") if dealt else rows
    (rows.sortWithinPartitions("bucket", *sort)
     .write.partitionBy("bucket").parquet(f"{path}/batch={batch}"))
