"""Command line: search, index, convert, maps, watch, batch."""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import uuid
from datetime import datetime
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.cleanup import markdown_cleanup, strip_cover_images
from shelfmark.models import Embedder
from shelfmark.operators import bookmaps, ocr
from shelfmark.operators.delivery import Delivery
from shelfmark.plans.ingest import Ingest
from shelfmark.plans.library import MODES, Library
from shelfmark.plans.ocr_batches import OcrBatches
from shelfmark.schemas import TOP_K
from shelfmark.sources import files, readers, tables
from shelfmark.sources.config import ensure_config, ensure_directories

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfmark")
    p.add_argument("--config")
    p.add_argument("--embedder", help="module:attribute of an Embedder; needed by query, index and watch ('offline' for the hashing stand-in)")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("query")
    q.add_argument("--top-k", type=int, default=TOP_K)
    q.add_argument("--mode", choices=MODES, default="hybrid")
    q.add_argument("--book-filter")
    q.add_argument("--author-filter")
    q.add_argument("--format", choices=("pretty", "json", "obsidian"), default="pretty")
    i = sub.add_parser("index")
    i.add_argument("--force", action="store_true")
    i.add_argument("--book")
    c = sub.add_parser("convert")
    c.add_argument("--force", action="store_true")
    m = sub.add_parser("maps")
    m.add_argument("--model", required=True, help="module:attribute called as model(kind, prompt) -> (answer, usage)")
    m.add_argument("--force", action="store_true")
    m.add_argument("--book")
    w = sub.add_parser("watch")
    w.add_argument("--once", action="store_true")
    w.add_argument("--services", help="module:attribute called with the configuration; returns keyword arguments of Ingest "
                                      "(services, map_model, normalize, repair) and, under sender, builder and confirm, those of the delivery")
    b = sub.add_parser("batch")
    b.add_argument("action", choices=("submit", "status", "cancel", "poll", "list", "pending"))
    b.add_argument("batch_id", nargs="?", help="the batch to cancel")
    b.add_argument("--client", help="module:attribute of an OCR client; needed by all actions but list and pending")
    return p


def ingest_of(spark: SparkSession, cfg, lib: Library, services: str | None = None) -> Ingest:
    """The ingest of a configuration, with the outside services that the user names."""
    given = dict(load(services)(cfg)) if services else {}
    delivery = Delivery(cfg.kindle, *(given.pop(n, None) for n in ("sender", "builder", "confirm")))
    return Ingest(spark, cfg.paths.staging, lib, cleanup=cfg.cleanup, pdf_engine=cfg.conversion.pdf_engine,
                  kindle=delivery, done_folder=cfg.paths.done, **given)


def run_batch(args, ingest: Ingest, root: str) -> DataFrame | str:
    """One action on the OCR batches; a listing or a line to print."""
    if args.action == "pending":
        return ingest.scanned().select("folder_id", "original_name").orderBy("folder_id")
    if args.action not in ("list", "pending") and not args.client:
        raise SystemExit("--client module:attribute is needed")
    jobs = OcrBatches(ingest.spark, root, load(args.client) if args.client else None)
    if args.action == "list":
        return ocr.batch_listing(jobs.batches())
    if args.action == "status":
        return jobs.status()
    if args.action == "cancel":
        if not args.batch_id:
            raise SystemExit("which batch?")
        return jobs.cancel(args.batch_id)
    if args.action == "submit":
        return jobs.submit(ingest.scanned(contents=True)) or "nothing to submit"
    closed = jobs.poll(ingest.scanned())
    ingest.accept_ocr(jobs.results().where("batch_status = 'complete'"))
    return f"{len(closed)} batches closed"


def load(spec: str):
    """Object named ``module:attribute``."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def embedder_of(args) -> Embedder:
    """The embedder named on the command line; the stand-in only where it is asked for or none is used."""
    if args.command in ("query", "index", "watch") and not args.embedder:
        raise SystemExit("--embedder module:attribute is needed (or --embedder offline)")
    return Embedder() if args.embedder in (None, "offline") else load(args.embedder)


def search(lib: Library, args, vault: str, now: datetime) -> str:
    """Results in the chosen format; the row count is bounded by ``top_k``."""
    hits = lib.search(args.query, args.top_k, args.mode, args.book_filter, args.author_filter)
    if args.format == "pretty":
        lines = [r.line for r in lib.as_pretty(hits).collect()]
        return "\n".join(lines) if lines else "No results found."
    if args.format == "json":
        rows = [json.loads(r.line) for r in lib.as_json(hits).collect()]
        return json.dumps(rows, indent=2, ensure_ascii=False) if rows else "No results found."
    if hits.isEmpty():
        return "No results found."
    note = lib.as_notes(hits, args.query, now).first()
    target = Path(vault, "Queries", f"{note.filename}.md")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(note.content, encoding="utf-8")
    return f"{target}\n{note_uri(vault, note.filename)}"


def note_uri(vault: str, filename: str) -> str:
    return f"obsidian://open?vault={quote(Path(vault).name)}&file={quote(f'Queries/{filename}')}"


def convert_epubs(spark: SparkSession, source: str, target: str, force: bool = False) -> None:
    """EPUBs to (book_id, text) rows; those already converted are skipped unless forced."""
    books = files.epub_files(spark, source).select(files.stem(F.col("name")).alias("book_id"), "content")
    if not force and tables.exists(spark, target):
        books = books.join(spark.read.parquet(target).where("error is null").select("book_id"), "book_id", "left_anti")

    def read(frames):
        for frame in frames:
            texts, errors = [], []
            for content in frame["content"]:
                try:
                    texts.append(readers.epub_markdown(bytes(content)))
                    errors.append(None)
                except Exception as exc:  # a broken file is reported and does not stop the others
                    texts.append(None)
                    errors.append(str(exc) or type(exc).__name__)
            yield frame[["book_id"]].assign(text=texts, error=errors)

    raw = books.mapInPandas(read, "book_id string, text string, error string")
    clean = raw.withColumn("text", markdown_cleanup(strip_cover_images(F.col("text"))))
    clean.write.mode("overwrite" if force else "append").parquet(target)
    failed = spark.read.parquet(target).where("error is not null")
    for row in failed.select("book_id", "error").orderBy("book_id").limit(20).collect():
        log.warning("%s was not converted: %s", row.book_id, row.error)


def make_maps(spark: SparkSession, books, folder: str, model, force: bool = False):
    """Generate maps for the books that have none (or for all); returns cost totals."""
    if not force and tables.exists(spark, folder):
        books = books.join(files.generated_maps(spark, folder).select(F.col("id").alias("book_id")), "book_id", "left_anti")
    # The model is paid once: maps and cost are both read from the stored answers.
    stored = f"{folder.rstrip('/')}-answers/{uuid.uuid4().hex}"
    bookmaps.ask(bookmaps.prompts(books), model).write.parquet(stored)
    answers = spark.read.parquet(stored)
    maps = bookmaps.assemble(answers)
    files.write_maps(maps.where("error is null").drop("book_id", "error", "prompt_tokens", "completion_tokens"), folder)
    return bookmaps.token_cost(answers)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    cfg = ensure_config(args.config)
    ensure_directories(cfg)
    spark = SparkSession.builder.appName("shelfmark").getOrCreate()
    lib = Library(spark, cfg.paths.index, embedder_of(args))
    if args.command == "query":
        print(search(lib, args, cfg.paths.obsidian_vault, datetime.now()))
    elif args.command == "index":
        maps = files.book_maps(spark, cfg.paths.maps)
        generated = f"{cfg.paths.maps}/generated"
        if tables.exists(spark, generated):
            maps = maps.unionByName(files.generated_maps(spark, generated)).dropDuplicates(["id"])
        books = files.markdown_books(spark, cfg.paths.markdown, args.book)
        converted = f"{cfg.paths.repo_root}/books"
        if tables.exists(spark, converted):
            fresh = spark.read.parquet(converted).where("error is null").select("book_id", "text")
            fresh = fresh.where(F.col("book_id") == args.book) if args.book else fresh
            books = books.select("book_id", "text").unionByName(fresh.join(books.select("book_id"), "book_id", "left_anti"))
        lib.add_books(books, maps, args.force)
    elif args.command == "maps":
        books = files.markdown_books(spark, cfg.paths.markdown, args.book)
        make_maps(spark, books, f"{cfg.paths.maps}/generated", load(args.model), args.force).show()
    elif args.command == "convert":
        convert_epubs(spark, f"{cfg.paths.repo_root}/source", f"{cfg.paths.repo_root}/books", args.force)
    elif args.command == "watch":
        from shelfmark.streaming.inbox import watch
        watch(ingest_of(spark, cfg, lib, args.services), cfg.paths.inbox, f"{cfg.paths.staging}/.checkpoint", continuous=not args.once).awaitTermination()
    else:
        shown = run_batch(args, ingest_of(spark, cfg, lib), cfg.paths.batches)
        print(shown) if isinstance(shown, str) else shown.show(truncate=False)


if __name__ == "__main__":
    main()
