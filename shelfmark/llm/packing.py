"""Best-fit packing of tokenised documents into fixed-length sequences.

``pieces`` encodes every document whole, ends it with one id and cuts only
documents longer than a sequence, from the back, so that just the first piece may
be short. ``pack`` places pieces by bounded-space online best fit: a task keeps a
fixed number of open sequences in a bitset keyed by free space, puts a piece where
the least room stays free, and closes the fullest when it may open no more.

Pieces are dealt by a hash of all their columns into groups of about
``GROUP_PIECES``; each group is packed by itself in order of falling length, which
leaves the small pieces to fill the gaps. A group has only a few numbers per piece,
the texts and ids are never shuffled, and the same input always gives the same
sequences, also when a task is run again.

Defined cases: a null or empty text is the end id alone; equal rows are separate
documents (they are counted before the shuffle and spread again); ties are broken
by id, piece and checksum; an empty table gives no rows; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.bpe import encoder_of, vocabulary
from shelfmark.llm.common import carried, table, written

carried(__name__)

LENGTH = 2048
OPEN = 1 << 15
GROUP_PIECES = 20_000
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; with ``with_ids`` also the ids themselves."""
    whole_path, ranks_path = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    width, end = 4 * length, struct.pack("<I", END)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(whole_path, ranks_path)
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = encoder.ids(text.as_py() or "") + end
                cut = len(packed) % width or min(width, len(packed))
                bounds = [0, *range(cut, len(packed) + 1, width)]
                for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = packed[a:b]
                    row = (doc_id, n, a // 4, (b - a) // 4, zlib.crc32(part), part if with_ids else None)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], list(out)[:len(arrays) if with_ids else -1])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES + (", ids binary" if with_ids else ""))


class Bins:
    """Open sequences of one task, by free space."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free = 0  # bit f is set when some open sequence has f places left
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.n_open = self.n_made = 0

    def _take(self, space: int) -> int:
        held = self.by_free[space]
        number = held.pop()
        if not held:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """The sequence for a piece and the offset in it."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.n_open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.length, self.n_made
            self.n_made += 1
        left = space - size
        if left:
            self.by_free[left].append(number)
            self.free |= 1 << left
            self.n_open += 1
        return number, self.length - space


def pack(rows: DataFrame, length: int = LENGTH, most_open: int = OPEN, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = written(rows.select(*names), "pieces")  # encoded once; the count and the packing read it
    groups = max(1, -(-rows.count() // group_pieces))
    copies = rows.groupBy(*names).count().select(*names, F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    dealt = copies.withColumn("group", F.pmod(F.xxhash64("copy", *names), F.lit(groups)))
    ordered = dealt.repartition(groups, "group").sortWithinPartitions("group", F.desc("length"), *names[:3], "ids_crc32", "copy")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for now, size in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if now != group:
                    group, bins = now, Bins(length, most_open)
                number, at = bins.place(size)
                sequence.append((group << 40) + number)
                offset.append(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*names, "sequence_id", "offset"])

    return ordered.mapInArrow(fill, PIECES + ", sequence_id long, offset long")


def sequences(docs: DataFrame, placed: DataFrame, length: int = LENGTH) -> DataFrame:
    """The packed sequences themselves: ids in order, one row of at most ``length`` ids each."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces(docs, length, with_ids=True).dropDuplicates(keys)
    parts = placed.join(ids.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).withColumnRenamed("doc_id", "_id"),
                        [F.coalesce(placed["doc_id"], F.lit(-1)) == F.col("_id"), *(placed[k] == ids[k] for k in keys[1:])])
    ordered = F.sort_array(F.collect_list(F.struct(placed["offset"], ids["ids"])))
    return parts.groupBy("sequence_id").agg(F.array_join(F.transform(ordered, lambda x: F.hex(x["ids"])), "").alias("hex")).select(
        "sequence_id", F.unhex("hex").alias("ids"))


def op1_best_fit(spark, sf_dir):
    """Every document's pieces and their places."""
    return pack(pieces(table(spark, sf_dir, "documents")))


def stage(spark, docs, sf_dir):
    """Last pipeline stage: the packed pieces of all documents that are left."""
    return pack(pieces(docs))
