"""The staging table: one row of state per incoming book."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

AUDIT = ("created_at", "updated_at")


def merge_meta(current: DataFrame, updates: DataFrame, key: str = "folder_id") -> DataFrame:
    """Upsert: new non-null values win, ``created_at`` sticks, ``updated_at`` moves on.

    Both sides hold one row per key.
    """
    values = list(dict.fromkeys(
        c for c in [*current.columns, *updates.columns] if c != key and c not in AUDIT))
    old, new = current.alias("old"), updates.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")

    def pick(name: str):
        sides = [F.col(f"{side}.{name}") for side, df in (("new", updates), ("old", current))
                 if name in df.columns]
        return F.coalesce(*sides).alias(name)

    created = F.coalesce("old.created_at", "new.updated_at").alias("created_at")
    updated = F.coalesce("new.updated_at", "old.updated_at").alias("updated_at")
    return joined.select(F.coalesce(f"new.{key}", f"old.{key}").alias(key), *map(pick, values),
                         created, updated)


def fold_log(log: DataFrame, key: str = "folder_id") -> DataFrame:
    """(key, field, value, at, seq) change log -> last value per key and field.

    ``max_by`` combines on the map side, so a key with a third of the log is fine.
    """
    return log.groupBy(key, "field").agg(
        F.max_by("value", F.struct("at", "seq")).alias("value"),
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def fold_onto(snapshot: DataFrame, entries: DataFrame, key: str = "folder_id") -> DataFrame:
    """Entries (key, field, value, at, seq) folded onto a snapshot of earlier ones, itself a snapshot again.

    A snapshot holds one row per key and field: the value, the ``at`` and ``seq`` that won, and
    the first and last time; so folding in steps, in any order, gives what folding all at once gives.
    """
    new = entries.select(key, "field", "value", "at", "seq", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    both = snapshot.select(new.columns).unionByName(new)
    won = F.max_by(F.struct("value", "at", "seq"), F.struct("at", "seq")).alias("w")
    folded = both.groupBy(key, "field").agg(won, F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return folded.select(key, "field", "w.value", "w.at", "w.seq", "created_at", "updated_at")


def pending(staging: DataFrame) -> DataFrame:
    """Visible, unlocked folders with metadata but no cleaned text, oldest first."""
    rows = staging.where(~F.col("folder_id").startswith(".") & ~F.col("is_locked")
                         & F.col("has_meta") & ~F.col("has_clean"))
    return rows.orderBy(F.asc_nulls_first("created_at"), "folder_id")


def ready_for_fanout(staging: DataFrame) -> DataFrame:
    """Cleaned, unlocked folders that are not done."""
    return staging.where(~F.col("folder_id").startswith(".") & F.col("has_clean")
                         & ~F.col("is_done") & ~F.col("is_locked"))


def set_flag(staging: DataFrame, flag: str, folder_ids: DataFrame, value: bool = True) -> DataFrame:
    """Set a marker (lock, done) on the folders listed in ``folder_ids``."""
    marked = folder_ids.select("folder_id").distinct().withColumn("_hit", F.lit(True))
    return (staging.join(marked, "folder_id", "left")
            .withColumn(flag, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag))).drop("_hit"))


def reclassify(staging: DataFrame) -> DataFrame:
    """Move local folders whose conversion came out too thin to the cloud area."""
    move = (F.col("staging_category") == "local") & (F.col("quality_gate") == "failed")
    return staging.select(
        *[c for c in staging.columns if c != "staging_category"],
        F.when(move, "cloud").otherwise(F.col("staging_category")).alias("staging_category"),
        F.when(move, "local").alias("reclassified_from"),
        F.when(move, "scanned").alias("reclassified_to"),
    )


def backlog(staging: DataFrame) -> DataFrame:
    """Everything left to process, scanned books included, in folder order."""
    rows = staging.where(~F.col("folder_id").startswith(".") & ~F.col("is_done")
                         & (F.col("has_raw") | F.col("file_type").isin("pdf", "epub")))
    return rows.orderBy("folder_id")
