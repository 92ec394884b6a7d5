"""File sources: inbox, books as Markdown, book maps, batch results."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.text import stem
from shelfmark.operators.triage import finished, visible
from shelfmark.schemas import BOOK_MAP_DDL, MAX_FILES_PER_TRIGGER, META_DDL, OCR_RESULT_DDL
from shelfmark.sources.ledger import opened

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINARY_DDL = "path string, modificationTime timestamp, length bigint, content binary"


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        "path", F.substring_index("path", "/", -1).alias("name"),
        F.col("modificationTime").alias("modification_time"), "length", "content")


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Waiting files, hidden ones excluded; unsorted, as sorting would shuffle the contents."""
    return _named(spark.read.format("binaryFile").load(folder)).where(visible(F.col("name")))


PIECE = 8 << 20


def digests(listing: DataFrame) -> DataFrame:
    """``sha256`` of files of any size: (path, ...) rows without contents, each file read in pieces by a task.

    The digest is null, with the reason in ``error``, where a file cannot be read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, errors = [], []
            for path in frame["path"]:
                digest, error = hashlib.sha256(), None
                try:
                    system, at = opened(path)
                    with system.open_input_stream(at, buffer_size=0) as f:
                        while piece := f.read(PIECE):
                            digest.update(piece)
                except Exception as exc:
                    error = str(exc) or type(exc).__name__
                found.append(None if error else digest.hexdigest())
                errors.append(error)
            yield frame.assign(sha256=found, error=errors)

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema)
    return listing.mapInPandas(run, f"{columns}, sha256 string, error string")


def oldest_first(files: DataFrame) -> DataFrame:
    """Listing of files without their contents."""
    return files.select("path", "name", "modification_time", "length").orderBy("modification_time", "path")


def inbox_stream(spark: SparkSession, folder: str, per_trigger: int = MAX_FILES_PER_TRIGGER,
                 archive: str | None = None) -> DataFrame:
    """Arriving files; nothing is dropped when many arrive, later triggers take the rest.

    With ``archive`` the source moves files of finished micro-batches there.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_DDL).option("maxFilesPerTrigger", per_trigger)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(folder)
    return _named(files).where(finished(F.col("name")))


def epub_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(folder)
    return _named(files)


def markdown_books(spark: SparkSession, folder: str, book: str | None = None) -> DataFrame:
    """(book_id, text), one row per ``*.md`` file; a named book must exist."""
    books = (spark.read.option("pathGlobFilter", f"{book}.md" if book else "*.md")
             .text(folder, wholetext=True)
             .select(stem(F.col("_metadata.file_name")).alias("book_id"), F.col("value").alias("text")))
    if book is not None and books.isEmpty():
        raise FileNotFoundError(f"Not found: {book}.md")
    return books


def book_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Stored maps; the file name is the book id whatever the map says."""
    maps = spark.read.schema(BOOK_MAP_DDL).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    return maps.withColumn("id", stem(F.col("_metadata.file_name")))


def ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of an OCR batch; blank lines are skipped."""
    return spark.read.schema(OCR_RESULT_DDL).json(path)


def write_maps(maps: DataFrame, folder: str) -> None:
    """One JSON object per line; nulls are kept so every field is present."""
    text = F.to_json(F.struct(*maps.columns), {"ignoreNullFields": "false"}).alias("value")
    maps.select(text).write.mode("append").text(folder)


def generated_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Maps written by ``write_maps``; each carries its own id."""
    return spark.read.schema(BOOK_MAP_DDL).option("pathGlobFilter", "part-*").json(folder)


def map_text(book_map: dict) -> str:
    """One map as an indented JSON document."""
    return json.dumps(book_map, indent=2, ensure_ascii=False) + "\n"


def staging_meta(spark: SparkSession, folder: str) -> DataFrame:
    """``meta.json`` files of existing staging folders as one row per folder."""
    meta = (spark.read.schema(META_DDL).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "meta.json").json(folder, multiLine=True))
    place = F.split("_metadata.file_path", "/")
    return meta.select(F.element_at(place, -2).alias("folder_id"), F.element_at(place, -3).alias("area"), *meta.columns)
