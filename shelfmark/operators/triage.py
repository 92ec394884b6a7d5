"""Deduplicate, classify and route incoming files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.numbers import round_exact
from shelfmark.functions.text import sha256_hex, suffix
from shelfmark.schemas import NATIVE_CHARS_PER_PAGE, QUALITY_CHARS_PER_PAGE, SAMPLE_PAGES

# Partial-download extensions and the staging area of each class.
PARTIAL_SUFFIXES = (".crdownload", ".part", ".tmp")
AREA_OF_CLASS = {"epub": "epub", "native": "local", "scanned": "cloud"}


def visible(name: Column) -> Column:
    return ~name.startswith(".")


def finished(name: Column) -> Column:
    """Neither hidden nor a partial download."""
    return visible(name) & ~suffix(name).isin(*PARTIAL_SUFFIXES)


def fingerprints(files: DataFrame) -> DataFrame:
    """Replace the bytes by their digest right at the scan, so no content is shuffled."""
    return files.withColumn("sha256", sha256_hex(F.col("content"))).drop("content")


def first_copies(prints: DataFrame, order: tuple[str, ...] = ("modification_time", "path")) -> DataFrame:
    """Earliest file per digest.

    ``min_by`` combines on the map side: a digest shared by a third of all files
    still reaches the reducer as one row per task.
    """
    rest = [c for c in prints.columns if c != "sha256"]
    row = F.struct(*rest)
    kept = prints.groupBy("sha256").agg(F.min_by(row, F.struct(*order)).alias("f"))
    return kept.select("sha256", "f.*")


def unseen(prints: DataFrame, known: DataFrame) -> DataFrame:
    """Drop files whose digest is already staged."""
    return prints.join(known.select("sha256").distinct(), "sha256", "left_anti")


def sample_positions(total: Column) -> Column:
    """Zero-based numbers of up to five evenly spaced pages."""
    some = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PAGES - 1)),
                       lambda i: F.floor(i * (total / F.lit(float(SAMPLE_PAGES)))).cast("int"))
    every = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)).cast("int"))
    return (F.when(total <= 0, F.array().cast("array<int>"))
            .when(total <= SAMPLE_PAGES, every).otherwise(some))


def probe_pages(pages: DataFrame) -> DataFrame:
    """(file, page_no, n_chars) -> text-density probe per file.

    Page counts and sampled sums are additive aggregates; the page join is keyed
    by file and page, so one huge file spreads over its pages.
    """
    totals = pages.groupBy("file").agg(F.count("*").alias("total_pages"))
    wanted = totals.select("file", F.explode(sample_positions(F.col("total_pages"))).alias("page_no"))
    sampled = (pages.select("file", F.col("page_no").cast("int").alias("page_no"), "n_chars")
               .join(wanted, ["file", "page_no"], "left_semi"))
    sums = sampled.groupBy("file").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("sampled_pages"))
    joined = totals.join(sums, "file", "left")
    sampled_pages = F.coalesce("sampled_pages", F.lit(0))
    average = F.coalesce(F.col("chars") / F.col("sampled_pages"), F.lit(0.0))
    return joined.select(
        "file", round_exact(average, 1).alias("avg_chars_per_page"), sampled_pages.alias("sampled_pages"),
        "total_pages", density_class(average).alias("classification"),
    )


def density_class(average_chars: Column) -> Column:
    return F.when(average_chars >= NATIVE_CHARS_PER_PAGE, "native").otherwise("scanned")


def file_type(name: Column) -> Column:
    return F.substr(suffix(name), F.lit(2))


def classification(name: Column, probed: Column) -> Column:
    """EPUB by name, PDF by its probe, everything else unsupported."""
    return (F.when(suffix(name) == ".epub", F.lit("epub"))
            .when(suffix(name) == ".pdf", F.coalesce(probed, F.lit("scanned")))
            .otherwise(F.lit("unsupported")))


def staging_area(kind: Column) -> Column:
    area = F.lit(None).cast("string")
    for name, where in AREA_OF_CLASS.items():
        area = F.when(kind == name, F.lit(where)).otherwise(area)
    return area


def source_file(name: Column) -> Column:
    return F.concat(F.lit("source"), suffix(name))


def routed(rows: DataFrame) -> DataFrame:
    """Files (path, name, modification_time, sha256 and the probe's columns) -> staged rows, unsupported ones included.

    Rows with a null ``staging_category`` belong in quarantine.
    """
    kind = classification(F.col("name"), F.col("classification"))
    probe = F.struct("avg_chars_per_page", "sampled_pages", "total_pages", "classification")
    return rows.select(
        F.col("sha256").alias("folder_id"), "sha256", "path",
        F.col("name").alias("original_name"), file_type(F.col("name")).alias("file_type"),
        kind.alias("classification"), staging_area(kind).alias("staging_category"),
        F.when(F.col("classification").isNotNull(), probe).alias("probe"), "modification_time")


def triage(prints: DataFrame, probes: DataFrame, staged: DataFrame) -> DataFrame:
    """Route files (path, name, modification_time, sha256) that are no copies, with the probes of those that have one."""
    fresh = unseen(first_copies(prints), staged)
    return routed(fresh.join(probes.withColumnRenamed("file", "path"), "path", "left"))


def quality_gate(text: Column, pages: Column) -> Column:
    """(chars_per_page, outcome) of a local conversion; thin text is re-filed as scanned."""
    density = F.length(text) / F.greatest(pages, F.lit(1))
    return F.struct(
        round_exact(density, 1).alias("chars_per_page"),
        F.when(density < QUALITY_CHARS_PER_PAGE, "reclassify").otherwise("ok").alias("outcome"),
    )
