"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed by contract: a word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def carried(module: str) -> None:
    """Let functions of ``module`` travel with the plan, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text; one split is cheaper than extracting every match."""
    return F.array_remove(F.split(text, BLANKS, -1), "")


def pair_up(hashes: Column, step: int) -> Column:
    """Hash of ``2 * step`` words from two neighbouring hashes of ``step`` words."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - step, F.lit(0)))
    return F.transform(starts, lambda h, i: F.shiftleft(h, step).bitwiseXOR(F.get(hashes, i + step)))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the cluster's shared folder, so lineage ends there.

    A lost executor then costs a reread, not a recomputation. The folder is the
    session's ``spark.checkpoint.dir``; where it is unset (tests), the warehouse.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of a document: ``d`` (id, null last) and ``c`` (content hash).

    The text is ``body``, all other columns are in the struct ``row``.
    """
    return docs.select(F.struct(*(n for n in docs.columns if n != "text")).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
                       F.xxhash64("text").alias("c"), F.col("text").alias("body"))


def unkeyed(names: list[str], text: str = "body") -> list[Column]:
    """Columns ``names`` of a frame that came from ``keyed``."""
    return [F.col(text).alias("text") if n == "text" else F.col("row")[n].alias(n) for n in names]


def slim(docs: DataFrame) -> DataFrame:
    """Id and text, with all other columns in one struct, so none of their names can clash."""
    rest = [n for n in docs.columns if n not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))


def restored(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of a frame that came from ``slim``."""
    return df.select(*(F.col(n) if n in ("doc_id", "text") else F.col("_rest")[n].alias(n) for n in names))


def others(df: DataFrame, *new: str) -> list[str]:
    """Columns of ``df`` besides those an operator adds; an operator's own column replaces one of the same name."""
    return [n for n in df.columns if n not in new]
