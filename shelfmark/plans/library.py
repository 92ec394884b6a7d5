"""The library: build and maintain the index, and answer questions from it.

Tables under one root, in append-only segments by batch and hash bucket of the book
id: ``parents``, ``children`` (with vectors), ``postings`` (in blocks), ``terms`` (document
frequencies), ``corpus`` (counts) and ``books`` (what each batch holds).  A batch
counts from the moment its one-row entry is in ``log``, which is written last; a
run that dies before leaves folders nothing reads, and its books are indexed by the
next run.  A newer version of a book hides the older one, whose share of the keyword
statistics is taken back by negative rows.  ``compact`` rewrites what is alive into one
batch, and ``vacuum`` removes the folders nothing reads any more.
"""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions import render
from shelfmark.models import Embedder, embed_children
from shelfmark.operators import bookmaps, fusion, keyword, structure
from shelfmark.schemas import CHILDREN_DDL, PARENTS_DDL, TOP_K
from shelfmark.sources import tables

TERMS_DDL = "term string, df bigint"
CORPUS_DDL = "n bigint, total_dl bigint"
SETTINGS_DDL = "embedder string, dims int, buckets int"
BOOKS_DDL = "book_id string, parents bigint, children bigint"
LOG_DDL = "seq bigint, batch string, base boolean, replaced bigint, books bigint"
TABLES = ("parents", "children", "postings", "terms", "corpus", "books")
MODES = ("hybrid", "semantic", "keyword")
# Stored bytes of parents whose postings one task makes.
TASK_BYTES = 4_000_000


class IndexNotBuilt(LookupError):
    pass


class Library:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None,
                 buckets: int = 64, token_counter: structure.TokenCounter | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.embedder = embedder or Embedder()
        self.token_counter = token_counter
        self._seen, self._log = [], []
        self.buckets = self._settings(buckets)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _settings(self, buckets: int) -> int:
        """Bucket count of an existing index; its embedder must match ours."""
        if not tables.exists(self.spark, self._path("settings")):
            return buckets
        row = self.spark.read.schema(SETTINGS_DDL).json(self._path("settings")).first()
        if (row.embedder, row.dims) != (self.embedder.name, self.embedder.dims):
            raise ValueError(f"index was built with embedder {row.embedder}/{row.dims}")
        return row.buckets

    def _write_settings(self) -> None:
        if not tables.exists(self.spark, self._path("settings")):
            row = [(self.embedder.name, self.embedder.dims, self.buckets)]
            self.spark.createDataFrame(row, SETTINGS_DDL).coalesce(1).write.json(self._path("settings"))

    # -- tables ----------------------------------------------------------

    def log(self) -> list:
        """Committed batches since the last compaction, oldest first; one small row each."""
        names = sorted(tables.folders(self.spark, self._path("log")))
        if names != self._seen:
            rows = self.spark.read.schema(LOG_DDL).parquet(*names).orderBy("seq").collect() if names else []
            start = max((i for i, r in enumerate(rows) if r.base), default=0)
            self._seen, self._log = names, rows[start:]
        return self._log

    def _committed(self, name: str, ddl: str) -> DataFrame:
        known = [r.batch for r in self.log()]
        return tables.open_segments(self.spark, self._path(name), ddl).where(F.col("batch").isin(known) if known else F.lit(False))

    def versions(self) -> DataFrame:
        """The newest version of each book: book_id, batch, parents, children."""
        order = self.spark.createDataFrame([(r.batch, r.seq) for r in self.log()], "batch string, seq bigint")
        rows = self._committed("books", BOOKS_DDL).join(F.broadcast(order), "batch")  # one row per batch
        newest = rows.groupBy("book_id").agg(F.max(F.struct("seq", "batch", "parents", "children")).alias("v"))
        return newest.select("book_id", "v.batch", "v.parents", "v.children")

    def _alive(self, name: str, ddl: str) -> DataFrame:
        return self._newest(self._committed(name, ddl))

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Rows (book_id, batch, ...) of the newest versions; the join is skipped while no book was ever replaced."""
        if not sum(r.replaced for r in self.log()):
            return rows
        every = self._committed("books", BOOKS_DDL).select("book_id", "batch")
        hidden = every.join(self.versions().select("book_id", "batch"), ["book_id", "batch"], "left_anti")
        return rows.join(hidden, ["book_id", "batch"], "left_anti")

    def parents(self) -> DataFrame:
        return self._alive("parents", PARENTS_DDL).drop("batch")

    def children(self) -> DataFrame:
        return self._alive("children", CHILDREN_DDL).drop("batch")

    def postings(self) -> DataFrame:
        return self._newest(keyword.entries(self._committed("postings", keyword.BLOCKS_DDL), "batch", "bucket")).drop("batch")

    def indexed_books(self) -> DataFrame:
        """Every indexed book id; no cap on how many are recognised."""
        return self.versions().where("parents > 0").select("book_id")

    def counts(self) -> DataFrame:
        """Parents and children per book."""
        return self.versions().where("parents > 0").select("book_id", "parents", "children")

    def run_counters(self) -> DataFrame:
        """Per committed batch: books, those that replaced another version, parents and children."""
        sums = self._committed("books", BOOKS_DDL).groupBy("batch").agg(F.sum("parents").alias("parents"), F.sum("children").alias("children"))
        entries = self.spark.createDataFrame([(r.seq, r.batch, r.books, r.replaced) for r in self.log()], "seq bigint, batch string, books bigint, replaced bigint")
        return entries.join(sums, "batch", "left").fillna(0)

    # -- writing ---------------------------------------------------------

    def to_index(self, books: DataFrame, force: bool = False) -> DataFrame:
        return books if force else books.join(self.indexed_books(), "book_id", "left_anti")

    def add_books(self, books: DataFrame, maps: DataFrame | None = None, force: bool = False) -> int:
        """Index (book_id, text); a book already present is replaced when ``force`` is set.

        Writes only the rows of these books. Returns the number of books indexed.
        """
        todo = self.to_index(books.select("book_id", "text"), force)
        none = self.spark.createDataFrame([], "id string, author string, title string")
        batch = uuid.uuid4().hex
        ids = f"{self._path('arrivals')}/batch={batch}"
        todo.select("book_id").write.parquet(ids)
        new_ids = self.spark.read.schema("book_id string").parquet(ids)
        if new_ids.isEmpty():
            return 0
        named = bookmaps.book_metadata(todo, maps if maps is not None else none)
        parents = self._segment_of("parents", PARENTS_DDL, batch, structure.build_parents(named, count=self.token_counter), ["id"])
        embedded = embed_children(structure.build_children(parents.drop("bucket"), count=self.token_counter), self.embedder)
        children = self._segment_of("children", CHILDREN_DDL, batch, embedded, ["id"])
        self._add_keywords(batch, parents, new_ids)
        return self._commit(batch, new_ids, parents, children)

    def _segment_of(self, name: str, ddl: str, batch: str, rows: DataFrame, sort: list[str], dealt: bool = True) -> DataFrame:
        """Write a segment and read it back."""
        if "bucket" not in rows.columns:
            rows = rows.withColumn("bucket", tables.bucket_of(F.col("book_id"), self.buckets))
        tables.write_segment(rows, self._path(name), batch, sort, dealt)
        return tables.open_segments(self.spark, self._path(name), ddl).where(F.col("batch") == batch).drop("batch")

    def _blocks_of(self, batch: str, parents: DataFrame) -> DataFrame:
        parts = ceil(tables.stored_bytes(self.spark, f"{self._path('parents')}/batch={batch}") / TASK_BYTES)
        # neighbouring buckets, or a part of a large one, for each task
        placed = keyword.placed_postings(parents.repartitionByRange(max(1, parts), "bucket", "id"), ("bucket",))
        # numbers of blocks start anew in every batch
        placed = placed.withColumn("block", F.xxhash64(F.lit(batch), "block"))
        return self._segment_of("postings", keyword.BLOCKS_DDL, batch, keyword.in_blocks(placed, ("bucket",)), ["term", "block"], dealt=False)

    def _add_keywords(self, batch: str, parents: DataFrame, new_ids: DataFrame) -> None:
        """Postings and statistics of a batch, with negative statistics for the versions it replaces."""
        index = self._blocks_of(batch, parents)
        terms, corpus = keyword.block_stats(index, "bucket"), keyword.corpus_stats(parents, "bucket")
        if self.log():
            gone = new_ids.join(self.versions().where("parents > 0").select("book_id"), "book_id", "left_semi")
            old_terms = keyword.term_stats(self.postings().join(gone, "book_id", "left_semi"), "bucket")
            old_corpus = keyword.corpus_stats(self.parents().join(gone, "book_id", "left_semi"), "bucket")
            terms = terms.unionByName(old_terms.withColumn("df", -F.col("df")))
            corpus = corpus.unionByName(old_corpus.withColumns({"n": -F.col("n"), "total_dl": -F.col("total_dl")}))
        self._segment_of("terms", TERMS_DDL, batch, terms, ["term"])
        self._segment_of("corpus", CORPUS_DDL, batch, corpus, [])

    def _commit(self, batch: str, new_ids: DataFrame, parents: DataFrame, children: DataFrame, base: bool = False) -> int:
        """The books of a batch, then its entry in the log: one file, the last thing written."""
        per = lambda rows, name: rows.groupBy("book_id").agg(F.count("*").alias(name))
        counted = new_ids.distinct().join(per(parents, "parents"), "book_id", "full_outer").join(per(children, "children"), "book_id", "left")
        books = self._segment_of("books", BOOKS_DDL, batch, counted.fillna(0, ["parents", "children"]), [])
        log = self.log()
        replaced = 0 if base or not log else books.join(self.versions(), "book_id", "left_semi").count()
        added = books.count()
        self._write_settings()
        seq = log[-1].seq + 1 if log else 0
        (self.spark.createDataFrame([(seq, batch, base, replaced, added)], LOG_DDL).coalesce(1)
         .write.parquet(f"{self._path('log')}/{seq:012d}-{batch}"))
        return added

    def compact(self) -> None:
        """Rewrite everything that is alive as one batch; readers switch when its log entry appears."""
        if not self.log():
            return
        batch = uuid.uuid4().hex
        ids = self.versions().select("book_id")
        parents = self._segment_of("parents", PARENTS_DDL, batch, self.parents(), ["id"])
        children = self._segment_of("children", CHILDREN_DDL, batch, self.children(), ["id"])
        self._segment_of("terms", TERMS_DDL, batch, keyword.block_stats(self._blocks_of(batch, parents), "bucket"), ["term"])
        self._segment_of("corpus", CORPUS_DDL, batch, keyword.corpus_stats(parents, "bucket"), [])
        self._commit(batch, ids, parents, children, base=True)

    def vacuum(self) -> None:
        """Remove segments that no committed batch names; run it when no writer is at work."""
        known = {r.batch for r in self.log()}
        for name in (*TABLES, "arrivals"):
            for folder in tables.folders(self.spark, self._path(name)):
                if folder.rsplit("=", 1)[-1] not in known or name == "arrivals":
                    tables.remove(self.spark, folder)

    # -- reading ---------------------------------------------------------

    def _guard(self) -> None:
        if not self.log():
            raise IndexNotBuilt("There is no index here yet: add_books builds one.")

    def _segment(self, rows: DataFrame, book_id: str | None) -> DataFrame:
        """With a book filter only that book's bucket can hold hits; prune to it."""
        if not book_id:
            return rows
        return rows.where(F.col("bucket") == tables.bucket_of(F.lit(book_id), self.buckets))

    def _found(self, ranked: DataFrame, rows: int) -> DataFrame:
        """The parents behind a ranked list of at most ``rows`` (id, bucket, ...); its buckets prune the partitions."""
        return self.parents().join(fusion.small(ranked, rows), ["bucket", "id"]).drop("bucket")

    def keyword_list(self, query: str, n: int, book_id: str | None, author: str | None) -> DataFrame:
        """Ranked keyword hits; filters and replaced books are taken out of the blocks that are read."""
        blocks = self._segment(self._committed("postings", keyword.BLOCKS_DDL), book_id).where(F.col("term").isin(keyword.query_terms(query)))
        ranking = keyword.BlockRanking(
            blocks, self._committed("terms", TERMS_DDL), self._committed("corpus", CORPUS_DDL), self.spark.createDataFrame([(0, query)], "qid int, text string"), n,
            visible=lambda rows: self._newest(keyword.apply_filters(rows, book_id, author)), carry=("bucket", "batch"))
        return ranking.best().select("id", "bucket", "_score", F.col("place").alias("rn"))

    def vector_list(self, vector: list[float], n: int, book_id: str | None, author: str | None) -> DataFrame:
        near = fusion.nearest(self._segment(self.children(), book_id), vector, n, book_id, author, carry=("bucket",))
        return fusion.numbered(near, "_distance", "id")

    def semantic_list(self, query: str, k: int, book_id: str | None, author: str | None) -> DataFrame:
        """The ``k`` best parents by their nearest child: fetches on until there are k or the children end."""
        vector, n = self.embedder.embed_query(query), fusion.fetch_size(k)
        while True:
            near = self.vector_list(vector, n, book_id, author)
            got = near.agg(F.count("*").alias("rows"), F.count_distinct("parent_id").alias("parents")).first()
            if got.parents >= k or got.rows < n:
                return fusion.best_children(near, ("bucket",)).orderBy("place").limit(k)
            n *= 2

    def search(self, query: str, k: int = TOP_K, mode: str = "hybrid", book_id: str | None = None,
               author: str | None = None) -> DataFrame:
        """Best parents with their score and ``place``; both filters apply together."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        fetched = fusion.fetch_size(k)
        self._guard()
        if mode == "keyword":
            hits = self.keyword_list(query, fetched, book_id, author).where(F.col("rn") <= k).withColumnRenamed("rn", "place")
        elif mode == "semantic":
            hits = self.semantic_list(query, k, book_id, author)
        else:
            near = self.vector_list(self.embedder.embed_query(query), fetched, book_id, author)
            hits = fusion.fuse(near, self.keyword_list(query, fetched, book_id, author), k, ("bucket",))
        return self._found(hits, k).orderBy("place")

    # -- output ----------------------------------------------------------

    @staticmethod
    def as_pretty(results: DataFrame) -> DataFrame:
        return results.select("place", render.pretty(results).alias("line")).orderBy("place")

    @staticmethod
    def as_json(results: DataFrame) -> DataFrame:
        return results.select("place", render.json_object(results).alias("line")).orderBy("place")

    @staticmethod
    def as_notes(results: DataFrame, query: str, now=None) -> DataFrame:
        return render.notes(results, query, F.current_timestamp() if now is None else F.lit(now))
