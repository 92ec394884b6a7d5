"""File-drop ingestion as idempotent batch steps over stage tables.

Each step reads one table, drops what its own output table already holds
(anti-join on the folder id) and appends the rest.  A step that dies half-way is
simply run again; nothing is locked and nothing is lost.  The steps are

    files -> staged / quarantined -> raw -> clean -> named -> indexed | sent | archived -> done

The last three are branches: they run side by side, none waits for or stops another,
and each leaves a row per book and run in ``branches``.  Calls that cost money or have an
effect (models, page conversion, mail) keep their results in a ledger, one by one, so
neither a repeated task nor a run that died makes them again.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import InheritableThread, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.text import book_slug, stem
from shelfmark.models import Embedder
from shelfmark.operators import bookmaps, cleaning, conversion, delivery as D, staging as G, triage as T
from shelfmark.plans.library import Library
from shelfmark.schemas import BOOK_MAP_DDL, CLOUD_PAGE_BATCH, LOCAL_PAGE_BATCH
from shelfmark.sources import files, readers, tables
from shelfmark.sources.config import Cleanup, Kindle
from shelfmark.sources.ledger import Ledger, key_of, opened
from shelfmark.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])
log = logging.getLogger(__name__)

STAGED_DDL = (
    "folder_id string, sha256 string, path string, original_name string, file_type string, classification string, "
    "staging_category string, probe struct<avg_chars_per_page:double,sampled_pages:int,total_pages:int,classification:string>, "
    "modification_time timestamp")
RAW_DDL = "folder_id string, raw_text string, page_count int, raw_chars int, chars_per_page double, outcome string, method string, error string"
CLEAN_DDL = ("folder_id string, clean_text string, quality_score double, cleanup_method string, clean_chars int, "
             "quality_score_after_repair double")
RANGES_DDL = "file string, part int, text string, error string"
NAMED_DDL = INDEXED_DDL = "folder_id string, book_id string"
ARCHIVED_DDL = "folder_id string, copied_to string, error string"
BRANCHES_DDL = "folder_id string, branch string, ok boolean, error string, at timestamp"
BRANCHES = ("index", "deliver", "archive")
DONE_DDL = ("folder_id string, book_id string, sha256 string, path string, original_name string, file_type string, "
            "classification string")
SENT_DDL = "folder_id string, sent boolean, outbox_name string"


@dataclass(frozen=True)
class Readers:
    """Per-file services: each gets the bytes of one file."""

    probe: Callable[[bytes], dict] = readers.pdf_probe
    native_pdf: Callable[[bytes], tuple[str, int]] = readers.pdf_markdown
    cloud_pdf: Callable[[bytes], tuple[str, int]] | None = None
    epub: Callable[[bytes], str] = readers.epub_markdown
    # (content, first page, stop page) -> text: native PDFs are then converted by ranges that are stored one by one.
    page_range: Callable[[bytes, int, int], str] | None = None
    # The same for the cloud converter, in longer ranges.
    cloud_range: Callable[[bytes, int, int], str] | None = None


def copy_file(path: str, folder: str) -> str:
    """Copy a file below ``folder`` from a task; copying it again changes nothing."""
    from pyarrow import fs

    (source, at), (target, root) = opened(path), opened(folder)
    target.create_dir(root, recursive=True)
    to = f"{root.rstrip('/')}/{at.rsplit('/', 1)[-1]}"
    fs.copy_files(at, to, source_filesystem=source, destination_filesystem=target)
    return to


class Ingest:
    def __init__(self, spark: SparkSession, root: str, library: Library | None = None,
                 services: Readers = Readers(), cleanup: Cleanup = Cleanup(), kindle: D.Delivery | None = None,
                 normalize: cleaning.Rewrite | None = None, repair: cleaning.Rewrite | None = None,
                 pdf_engine: str = "cloud", map_model: bookmaps.Model | None = None, done_folder: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.library = library or Library(spark, f"{self.root}/index", Embedder())
        self.services = services
        self.cleanup = cleanup
        self.kindle = kindle or D.Delivery(Kindle())
        self.normalize, self.repair = normalize, repair
        self.pdf_engine = pdf_engine
        # map_model(kind, prompt) makes the map of every new book; done_folder gets a copy of every finished file.
        self.map_model, self.done_folder = map_model, done_folder
        self.ledger = Ledger(f"{self.root}/ledger")

    def table(self, name: str, ddl: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not tables.exists(self.spark, path):
            return self.spark.createDataFrame([], ddl)
        # the stream writes a folder per micro-batch
        return self.spark.read.schema(ddl).option("recursiveFileLookup", True).parquet(path)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def staged(self) -> DataFrame:
        return self.table("staged", STAGED_DDL)

    def quarantined(self) -> DataFrame:
        return self.table("quarantined", STAGED_DDL)

    # -- steps -----------------------------------------------------------

    def looked(self, files: DataFrame) -> DataFrame:
        """Digest and probe of arriving files, in one pass over their bytes; only small columns leave the scan."""
        probe = self.services.probe

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = []
                for row in frame.itertuples(index=False):
                    try:
                        found.append(probe(bytes(row.content)) if row.name.lower().endswith(".pdf") else None)
                    except Exception:  # an unreadable PDF has no text layer to read
                        found.append({"avg_chars_per_page": 0.0, "sampled_pages": 0, "total_pages": 0,
                                      "classification": "scanned"})
                yield frame.drop(columns="content").assign(
                    **{k: [p[k] if p else None for p in found]
                       for k in ("avg_chars_per_page", "sampled_pages", "total_pages", "classification")})

        hashed = files.withColumn("sha256", T.sha256_hex(F.col("content"))).withColumn(
            "content", F.when(F.lower("name").endswith(".pdf"), F.col("content")))  # only PDFs are probed
        return hashed.mapInPandas(look, (
            "path string, name string, modification_time timestamp, length bigint, sha256 string, "
            "avg_chars_per_page double, sampled_pages int, total_pages int, classification string"))

    def known_files(self) -> DataFrame:
        """(sha256, path) of every staged or quarantined file, one per digest."""
        both = self.staged().select("sha256", "path").unionByName(self.quarantined().select("sha256", "path"))
        return both.groupBy("sha256").agg(F.min("path").alias("path"))

    def stage(self, files: DataFrame) -> None:
        """Fingerprint, drop copies, classify and route arriving files."""
        scratch = shared_dir(self.spark, "arrivals")
        self.looked(files).write.parquet(scratch)
        arrivals = self.spark.read.parquet(scratch)
        self._file_away(T.unseen(T.first_copies(arrivals), self.known_files()), shared_dir(self.spark, "routed"))

    def stage_fresh(self, fresh: DataFrame, batch: str) -> None:
        """Route the files of a micro-batch, none of which was met before; the same batch again replaces itself."""
        self._file_away(fresh, f"{self.root}/arrived/{batch}", batch)

    def _file_away(self, fresh: DataFrame, scratch: str, batch: str | None = None) -> None:
        routed = self.spark.createDataFrame([], STAGED_DDL).unionByName(T.routed(fresh))
        routed.write.mode("overwrite").parquet(scratch)  # evaluated once: the rows come from keyed state
        done = self.spark.read.schema(STAGED_DDL).parquet(scratch)
        for name, rows in (("staged", done.where("staging_category is not null")), ("quarantined", done.where("staging_category is null"))):
            if batch is None:
                self._append(name, rows)
            else:
                rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{batch}")

    def _content(self, rows: DataFrame) -> DataFrame | None:
        """(path, content) of the inbox files behind ``rows``, None when there are none.

        The scan is limited to the inbox folders and to files no older than the
        oldest one wanted; the time filter is pushed to the source, which then
        does not open the files it excludes.
        """
        folder = F.regexp_replace("path", "/[^/]*$", "")
        span = rows.agg(F.min("modification_time").alias("oldest"), F.collect_set(folder).alias("folders")).first()
        if span.oldest is None:
            return None
        files = self.spark.read.format("binaryFile").load(span.folders)
        return files.where(F.col("modificationTime") >= F.lit(span.oldest)).select("path", "content")

    def convert(self, retry: bool = False) -> None:
        """Read every staged file that has no raw text yet, one file per call; with ``retry`` also those that failed.

        Scanned files wait for batch OCR, whose results come in by ``accept_ocr``.
        """
        services, engine = self.services, self.pdf_engine
        cloud = engine == "cloud" and services.cloud_pdf is not None
        by_range = services.cloud_range if engine == "cloud" and services.cloud_range else None if cloud else services.page_range
        tried = self.table("raw", RAW_DDL)
        if retry:
            tried = tried.where("outcome <> 'failed'")
        todo = self.staged().where("staging_category <> 'cloud'").join(tried.select("folder_id"), "folder_id", "left_anti")
        if by_range is not None:
            ranged = F.coalesce((F.col("classification") == "native") & (F.col("probe.total_pages") > 0), F.lit(False))
            in_cloud = by_range is services.cloud_range
            self._convert_ranges(todo.where(ranged), by_range, "cloud" if in_cloud else "native", CLOUD_PAGE_BATCH if in_cloud else LOCAL_PAGE_BATCH)
            todo = todo.where(~ranged)
        content = self._content(todo)
        if content is None:
            return
        work = todo.join(content, "path").select("folder_id", "classification", "content")

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for row in frame.itertuples(index=False):
                    text, pages, error, method = None, None, None, row.classification
                    try:
                        data = bytes(row.content)
                        if row.classification == "epub":
                            text = services.epub(data)
                        elif cloud:
                            (text, pages), method = services.cloud_pdf(data), "cloud"
                        else:
                            text, pages = services.native_pdf(data)
                    except Exception as exc:
                        error = str(exc)
                    rows.append((row.folder_id, text, pages, method, error))
                yield pd.DataFrame(rows, columns=["folder_id", "raw_text", "page_count", "method", "error"])

        got = work.mapInPandas(read, "folder_id string, raw_text string, page_count int, method string, error string")
        self._append("raw", self._raw_rows(got))

    def _convert_ranges(self, todo: DataFrame, convert: Callable[[bytes, int, int], str], method: str, size: int) -> None:
        """Convert PDFs by page ranges, each a row of its own.

        Ranges with a stored text are not planned again; those that a run converted before it died are in the ledger.
        """
        ledger = self.ledger
        items = conversion.work_items(todo.select(F.col("folder_id").alias("file"), "path", F.col("probe.total_pages").alias("total_pages")), size)
        keyed = items.withColumn("file", F.concat_ws("/", "file", F.lit(method)))  # ranges of two converters differ
        good = self.table("ranges", RANGES_DDL).where("text is not null")
        rest = conversion.remaining(keyed, good).groupBy("file", "path").agg(F.collect_list(F.struct("part", "first", "stop")).alias("ranges"))
        content = self._content(todo)
        if content is None:
            return

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for row in frame.itertuples(index=False):
                    text, error = None, None
                    try:
                        key = key_of("pages", row.file, row.first, row.stop)
                        text = ledger.kept(key, lambda: convert(bytes(row.content), row.first, row.stop))
                    except Exception as exc:
                        error = str(exc) or type(exc).__name__
                    rows.append((row.file, row.part, text, error))
                yield pd.DataFrame(rows, columns=["file", "part", "text", "error"])

        # A file meets its bytes once; its ranges are spread inside the row.
        work = rest.join(content, "path").select("file", "content", F.explode("ranges").alias("r")).select("file", "r.*", "content")
        self._append("ranges", work.mapInPandas(read, RANGES_DDL))
        own = todo.select(F.concat_ws("/", "folder_id", F.lit(method)).alias("file"), "folder_id", F.col("probe.total_pages").alias("page_count"))
        parts = self.table("ranges", RANGES_DDL).join(own.select("file"), "file", "left_semi")
        best = parts.groupBy("file", "part").agg(F.max("text").alias("text"), F.max("error").alias("error"))
        whole = conversion.whole_documents(best.withColumn("error", F.when(F.col("text").isNull(), F.col("error")))).join(own, "file")
        self._append("raw", self._raw_rows(whole.select("folder_id", "raw_text", "page_count", F.lit(method).alias("method"), "error")))

    @staticmethod
    def _raw_rows(got: DataFrame) -> DataFrame:
        """Rows of the raw table with the quality gate's verdict."""
        gate = T.quality_gate(F.col("raw_text"), F.col("page_count"))
        thin = (F.col("method") == "native") & (gate["outcome"] == "reclassify")
        return got.select(
            "folder_id", "raw_text", "page_count", F.length("raw_text").alias("raw_chars"),
            F.when(F.col("page_count").isNotNull(), gate["chars_per_page"]).alias("chars_per_page"),
            F.when(F.col("raw_text").isNull(), "failed").when(thin, "reclassify").otherwise("ok").alias("outcome"),
            "method", "error")

    def quarantine_failed(self) -> None:
        """File the rows of conversions that failed, and never succeeded later, under quarantine."""
        raw = self.table("raw", RAW_DDL)
        good = raw.where("outcome <> 'failed'").select("folder_id")
        bad = raw.where("outcome = 'failed'").join(good, "folder_id", "left_anti").select("folder_id").distinct()
        have = self.quarantined().select("folder_id")
        self._append("quarantined", self.staged().join(bad, "folder_id", "left_semi").join(have, "folder_id", "left_anti"))

    def accept_ocr(self, results: DataFrame) -> None:
        """Take finished OCR texts (custom_id, raw_text) as raw text of their folders."""
        have = self.table("raw", RAW_DDL).where("outcome = 'ok'").select("folder_id")
        texts = results.where(F.col("raw_text").isNotNull()).select(F.col("custom_id").alias("folder_id"), "raw_text")
        fresh = texts.join(have, "folder_id", "left_anti").groupBy("folder_id").agg(F.max("raw_text").alias("raw_text"))
        none = F.lit(None)
        self._append("raw", fresh.select(
            "folder_id", "raw_text", none.cast("int").alias("page_count"), F.length("raw_text").alias("raw_chars"),
            none.cast("double").alias("chars_per_page"), F.lit("ok").alias("outcome"), F.lit("ocr").alias("method"),
            none.cast("string").alias("error")))

    def _todo(self, stage: str, ddl: str, *columns: str) -> DataFrame:
        """Small columns of the folders that ``stage`` lacks.

        Narrowed down before any text is joined, so texts are shuffled once at most.
        """
        return self.staged().select("folder_id", *columns).join(
            self.table(stage, ddl).select("folder_id"), "folder_id", "left_anti")

    def clean(self) -> None:
        raw = self.table("raw", RAW_DDL).where("outcome = 'ok'").select("folder_id", "raw_text")
        todo = raw.join(self._todo("clean", CLEAN_DDL, "file_type"), "folder_id")
        done = cleaning.clean(todo, self.cleanup, self.normalize, self.repair)
        self._append("clean", done.drop("raw_text", "file_type"))

    def name(self) -> None:
        """Give every cleaned text its book id, for all branches alike."""
        marked = shared_dir(self.spark, "named")
        self._book_ids(self._todo("named", NAMED_DDL, "original_name")).write.parquet(marked)
        self._append("named", self.spark.read.parquet(marked))

    def _named(self, stage: str, ddl: str, where: str = "true") -> DataFrame:
        """(folder_id, book_id) of the named books that ``stage`` lacks."""
        return self.table("named", NAMED_DDL).join(self.table(stage, ddl).where(where).select("folder_id"), "folder_id", "left_anti")

    def maps(self) -> DataFrame:
        """Maps made so far; each carries its book's id."""
        path = f"{self.root}/maps"
        if not tables.exists(self.spark, path):
            return self.spark.createDataFrame([], BOOK_MAP_DDL)
        return files.generated_maps(self.spark, path).dropDuplicates(["id"])

    def make_maps(self) -> None:
        """Map every named book that has no map; a map that failed is tried again by the next run, whose other
        prompts are answered from the ledger."""
        texts = self.table("clean", CLEAN_DDL).select("folder_id", F.col("clean_text").alias("text"))
        todo = self.table("named", NAMED_DDL).join(self.maps().select(F.col("id").alias("book_id")), "book_id", "left_anti")
        answers = shared_dir(self.spark, "answers")
        books = todo.join(texts, "folder_id").select("book_id", "text")
        bookmaps.ask(bookmaps.prompts(books), self.map_model, self.ledger).write.parquet(answers)
        made = bookmaps.assemble(self.spark.read.parquet(answers)).where("error is null").withColumn("id", F.col("book_id"))
        files.write_maps(made.drop("book_id", "error", "prompt_tokens", "completion_tokens"), f"{self.root}/maps")

    def index(self, maps: DataFrame | None = None) -> int:
        """Index the named texts under their book id; only indexed books are marked."""
        texts = self.table("clean", CLEAN_DDL).select("folder_id", F.col("clean_text").alias("text"))
        marked = shared_dir(self.spark, "marked")
        self._named("indexed", INDEXED_DDL).write.parquet(marked)
        named = self.spark.read.schema(INDEXED_DDL).parquet(marked)
        count = self.library.add_books(named.join(texts, "folder_id").select("book_id", "text"), maps, force=True)
        self._append("indexed", named)
        return count

    def _book_ids(self, todo: DataFrame) -> DataFrame:
        """(folder_id, book_id): the slug of the name, made distinct where another file has it.

        Different files are different books: one file per slug keeps it plain, the
        others carry part of their digest.
        """
        slugs = todo.join(self.table("clean", CLEAN_DDL).select("folder_id"), "folder_id", "left_semi").select(
            "folder_id", book_slug(F.col("original_name")).alias("slug"))
        first = slugs.groupBy("slug").agg(F.min("folder_id").alias("first"))
        taken = self.table("named", NAMED_DDL).select(F.col("book_id").alias("slug"), F.lit(True).alias("taken"))
        rows = slugs.join(first.join(taken, "slug", "left"), "slug")
        plain = F.col("taken").isNull() & (F.col("folder_id") == F.col("first"))
        return rows.select("folder_id", F.when(plain, F.col("slug")).otherwise(
            F.concat_ws("-", "slug", F.left("folder_id", F.lit(32)))).alias("book_id"))

    def deliver(self, maps: DataFrame | None = None) -> None:
        none = self.spark.createDataFrame([], "id string, title string, author string, summary string, key_themes array<string>")
        # A delivery that failed is not done and is tried again.
        todo = self._named("sent", SENT_DDL, "sent").join(self.staged().select("folder_id", "path", "original_name", "file_type", "modification_time"), "folder_id")
        about = bookmaps.delivery_metadata(
            todo.withColumn("fallback_title", stem(F.col("original_name"))), maps if maps is not None else none)
        if self.kindle.configured:
            content = self._content(todo)
            if content is None:
                return
            about = about.join(self.table("clean", CLEAN_DDL).select("folder_id", "clean_text"), "folder_id")
            about = about.join(content, "path")
        self._append("sent", D.deliver(about, self.kindle, self.ledger.uri))

    def archive(self) -> None:
        """Copy the files of named books to the done folder, where there is one, and write that down."""
        folder = self.done_folder
        todo = self._named("archived", ARCHIVED_DDL, "error is null").join(self.staged().select("folder_id", "path"), "folder_id")

        def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for row in frame.itertuples(index=False):
                    try:
                        rows.append((row.folder_id, copy_file(row.path, f"{folder}/{row.folder_id}") if folder else None, None))
                    except Exception as exc:
                        rows.append((row.folder_id, None, str(exc) or type(exc).__name__))
                yield pd.DataFrame(rows, columns=["folder_id", "copied_to", "error"])

        self._append("archived", todo.select("folder_id", "path").mapInPandas(copy, ARCHIVED_DDL))

    def finish(self) -> None:
        """Record books that went through all branches, with their provenance."""
        ended = self.staged().join(self.done(), "folder_id").select(
            "folder_id", "book_id", "sha256", "path", "original_name", "file_type", "classification")
        kept = self.table("done", DONE_DDL).select("folder_id")
        self._append("done", ended.join(kept, "folder_id", "left_anti"))

    def _branch_open(self, branch: str) -> DataFrame:
        """Folders a branch has not done."""
        stage, ddl, where = {"index": ("indexed", INDEXED_DDL, "true"), "deliver": ("sent", SENT_DDL, "sent"), "archive": ("archived", ARCHIVED_DDL, "error is null")}[branch]
        return self._named(stage, ddl, where).select("folder_id")

    def fan_out(self, maps: DataFrame | None = None) -> dict[str, str | None]:
        """Run the branches side by side; returns each one's error, None where it went through.

        A branch runs in a thread and scheduler pool of its own. Whatever becomes of it, each
        of its books gets a row in ``branches``; what it has not done is left to the next run.
        """
        work = {"index": lambda: self.index(maps), "deliver": lambda: self.deliver(maps), "archive": self.archive}
        waiting = {b: shared_dir(self.spark, f"waiting-{b}") for b in BRANCHES}
        for branch, path in waiting.items():
            self._branch_open(branch).write.parquet(path)
        errors: dict[str, str | None] = {}

        def run(branch: str) -> None:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", branch)
            try:
                work[branch]()
                errors[branch] = None
            except Exception as exc:
                log.warning("branch %s failed: %s", branch, exc)
                errors[branch] = (str(exc) or type(exc).__name__).split("\n")[0]

        threads = [InheritableThread(target=run, args=(b,), session=self.spark) for b in BRANCHES]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        for branch, path in waiting.items():
            asked = self.spark.read.schema("folder_id string").parquet(path)
            left = self._branch_open(branch).withColumn("left", F.lit(True))
            rows = asked.join(left, "folder_id", "left").select(
                "folder_id", F.lit(branch).alias("branch"), F.col("left").isNull().alias("ok"),
                F.when(F.col("left"), F.lit(errors[branch])).cast("string").alias("error"), F.current_timestamp().alias("at"))
            self._append("branches", rows)
        return errors

    def done(self) -> DataFrame:
        """Finished folders: indexed, delivered and archived."""
        sent = self.table("sent", SENT_DDL).where("sent").select("folder_id")
        kept = self.table("archived", ARCHIVED_DDL).where("error is null").select("folder_id")
        return self.table("indexed", INDEXED_DDL).join(sent, "folder_id", "left_semi").join(kept, "folder_id", "left_semi")

    def state(self) -> DataFrame:
        """The staging table with its markers, for the pending, ready and OCR queries."""
        def flag(name: str, df: DataFrame) -> DataFrame:
            return df.select("folder_id").distinct().withColumn(name, F.lit(True))

        raw = self.table("raw", RAW_DDL)
        thin = raw.where("outcome = 'reclassify'").select("folder_id", "page_count", F.lit("failed").alias("quality_gate"))
        rows = self.staged().withColumn("created_at", F.col("modification_time"))
        rows = rows.join(flag("has_raw", raw.where("outcome = 'ok'")), "folder_id", "left")
        rows = rows.join(flag("has_clean", self.table("clean", CLEAN_DDL)), "folder_id", "left")
        rows = rows.join(flag("is_done", self.done()), "folder_id", "left").join(thin, "folder_id", "left")
        return G.reclassify(rows.fillna(False, ["has_raw", "has_clean", "is_done"]).withColumns(
            {"has_meta": F.lit(True), "is_locked": F.lit(False),
             "page_count": F.coalesce("page_count", "probe.total_pages")}))

    def scanned(self, contents: bool = False) -> DataFrame:
        """Books that wait for batch OCR; ``contents`` adds their bytes, for the tasks that upload them."""
        rows = self.state().where("staging_category = 'cloud' and not has_raw")
        if not contents:
            return rows
        files = self._content(rows)
        return rows.withColumn("content", F.lit(None).cast("binary")).limit(0) if files is None else rows.join(files, "path")

    def run_once(self, files: DataFrame | None = None, maps: DataFrame | None = None) -> None:
        if files is not None:
            self.stage(files)
        self.convert()
        self.quarantine_failed()
        self.clean()
        self.name()
        if self.map_model is not None:
            try:
                self.make_maps()
            except Exception as exc:  # a book is indexed without its map
                log.warning("maps failed: %s", exc)
            maps = self.maps() if maps is None else maps
        self.fan_out(maps)
        self.finish()
