"""Clean raw text, score it, and send only poor text to an optional repairer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.cleanup import full_cleanup, quality_score
from shelfmark.functions.numbers import round_exact
from shelfmark.functions.text import let
from shelfmark.schemas import FUZZY_SAMPLE_CHARS
from shelfmark.sources.config import Cleanup

Rewrite = Callable[[str], str]


def rewrite_text(df: DataFrame, column: str, rewrite: Rewrite, only: Column | None = None, window: int | None = None) -> DataFrame:
    """Apply a Python text service per Arrow batch; a failure leaves the text as it was.

    Only rows where ``only`` holds reach the service, in windows of ``window`` characters.
    """

    def one(text: str) -> str:
        try:
            return rewrite(text) or text
        except Exception:
            return text

    def whole(text: str) -> str:
        size = window or max(len(text), 1)
        return "".join(one(text[at:at + size]) for at in range(0, len(text), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            rows = zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
            fixed = pa.array([whole(t) if t is not None and wanted else t for t, wanted in rows], pa.string())
            arrays = [fixed if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1])

    # One pass over whole rows: the service is called once per window, whatever is computed from the text later.
    marked = df.withColumn("_wanted", F.lit(True) if only is None else F.coalesce(only, F.lit(False)))
    return marked.mapInArrow(run, df.schema)


def needs_repair(score: Column, threshold: float, enabled: bool) -> Column:
    return (score < threshold) & F.lit(enabled)


def clean(raw: DataFrame, options: Cleanup = Cleanup(), normalize: Rewrite | None = None,
          repair: Rewrite | None = None, window: int | None = FUZZY_SAMPLE_CHARS) -> DataFrame:
    """(.., raw_text, file_type) -> adds clean_text, quality_score, cleanup_method, clean_chars.

    ``repair`` sees texts below the threshold, whole, in consecutive windows of
    ``window`` characters (None: in one piece); a window it fails on stays as it is.
    ``cleanup_method`` names the steps that ran.
    """
    df = raw.withColumn("clean_text", full_cleanup(
        F.col("raw_text"), F.col("file_type"), options.strip_images, options.strip_tables))
    if normalize is not None:
        df = rewrite_text(df, "clean_text", normalize)
    df = df.withColumn("_score", quality_score(F.col("clean_text")))
    poor = needs_repair(F.col("_score"), options.fuzzy_threshold, repair is not None)
    df = df.withColumn("_poor", poor)
    steps = "regex" if normalize is None else "regex+normalize"
    method = F.when(F.col("_poor"), f"{steps}+repair").otherwise(steps)
    if repair is not None:
        df = rewrite_text(df, "clean_text", repair, F.col("_poor"), window)
    after = let(F.col("clean_text"), quality_score)
    return df.select(
        *raw.columns, "clean_text", round_exact(F.col("_score"), 3).alias("quality_score"),
        method.alias("cleanup_method"), F.length("clean_text").alias("clean_chars"),
        F.when(F.col("_poor"), round_exact(after, 3)).alias("quality_score_after_repair"))


