"""Benchmark decontamination by templates.

A text's tokens are canonicalised: numbers become ``<num>``, units after a number
``<unit>``, capitalised words ``<name>``. Windows of ``WINDOW`` canonical tokens of
the benchmark items are hash-joined with those of the documents; a second set of
windows, of lower-case words with numbers and units typed only, finds copies in other
case. Where a document has at least ``COVERAGE`` of an item's windows, the slots under
them are compared: each value of the item must stand for one value of the document and
the other way round (two numbers may become equal), over all windows or over those of
one passage. So a question with other numbers or names, or with words put in or left
out, is caught as well, while texts that only share a form of words are not.

Whatever the length of the item, ``RUN`` tokens in a row that match with consistent
slots are a leak too, so a conflict costs only the runs it lies in.

A text is read once for its windows: its tokens are hashed as typed and in folded case
together, a block of texts at a time. The windows' hashes of the benchmark travel to the
tasks below a checked number and are joined by shuffle beyond it; only hits are shuffled,
and each text once, to meet its candidates.

Defined cases: null and empty texts have no windows; an item shorter than a window
is one window of its own length; a window needs literal words for half of its
tokens; an item of ``WINDOW`` tokens or more without such a window is found by windows
with its own names and numbers, a shorter one is never matched; items with equal text
are each reported; equal documents are each flagged; an empty benchmark flags
nothing; other columns pass through untouched, but for one named ``leaks``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfmark.functions.text import let
from shelfmark.llm.common import carried, keyed, others, restored, slim, table, unkeyed

carried(__name__)

WINDOW, COVERAGE = 8, 0.5
RUN = 20
BROADCAST_ROWS = 200_000
TOKEN = r"\p{N}+(?:[.,:/]\p{N}+)*|\p{L}[\p{L}\p{M}]*"
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
# Units that follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "lb", "oz", "ml", "l", "s", "min", "h", "hours", "days", "years",
         "minutes", "seconds", "miles", "meters", "metres", "percent", "dollars", "euros", "cents", "degrees")
UNIT_SET = frozenset(UNITS)
# Tokens hashed together and token forms remembered: they bound a task's memory, not results.
BLOCK_TOKENS, REMEMBERED = 100_000, 500_000
MULTIPLIER, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
IS_NUMBER, IS_UNIT, IS_FOLDED_UNIT = 1, 2, 4
Forms = tuple[np.ndarray, np.ndarray, np.ndarray]


class Tokens:
    """Token forms of texts; one per task."""

    def __init__(self):
        self.find = regex.compile(TOKEN).findall
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.empty((0, 4), np.uint64)

    def _learn(self, new: list[str]) -> None:
        """Rows (typed hash, folded hash, plain hash, what it is) of tokens not met yet."""
        low = [x.lower() for x in new]
        plain = np.fromiter(map(xxhash.xxh3_64_intdigest, low), np.uint64, len(new))
        number = np.array([not x[0].isalpha() for x in new], bool)  # a token starts with a letter or a number
        capital = np.array([category(x[0]) == "Lu" for x in new], bool)
        what = IS_NUMBER * number + IS_UNIT * np.array([x in UNIT_SET for x in new], bool) + IS_FOLDED_UNIT * np.array([x in UNIT_SET for x in low], bool)
        folded = np.where(number, np.uint64(xxhash.xxh3_64_intdigest(NUMBER)), plain)
        typed = np.where(capital, np.uint64(xxhash.xxh3_64_intdigest(NAME)), folded)
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, np.stack([typed, folded, plain, what.astype(np.uint64)], 1)])

    def canonical(self, raw: list[str]) -> list[str]:
        """The typed tokens, one per raw token."""
        numbers = [not x[0].isalpha() for x in raw]
        return [NAME if category(x[0]) == "Lu" else NUMBER if numbers[i] else UNIT if x in UNITS and i and numbers[i - 1] else x.lower() for i, x in enumerate(raw)]

    def forms(self, raw: list[str], first: np.ndarray) -> Forms:
        """Hashes of the tokens as typed, folded and plain; ``first`` marks those that open a text."""
        if len(self.places) > REMEMBERED:
            self._clear()
        at = list(map(self.places.get, raw))
        if None in at:
            missing = [i for i, place in enumerate(at) if place is None]
            self._learn(list(dict.fromkeys(raw[i] for i in missing)))
            for i in missing:
                at[i] = self.places[raw[i]]
        typed, folded, plain, what = self.rows[np.array(at, np.int64)].T
        after = ~first
        after[1:] &= (what[:-1] & np.uint64(IS_NUMBER)) > 0
        unit = np.uint64(xxhash.xxh3_64_intdigest(UNIT))
        return (np.where(after & ((what & np.uint64(IS_UNIT)) > 0), unit, typed), np.where(after & ((what & np.uint64(IS_FOLDED_UNIT)) > 0), unit, folded), plain)


def window_hashes(hashes: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Hash of the window of ``size`` tokens that starts at each token, as long as it fits."""
    mixed = np.full(max(len(hashes) - size + 1, 0), size * 4 + kind, np.uint64)
    for k in range(size):
        mixed = mixed * MULTIPLIER + hashes[k:len(hashes) - size + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= FINISH
    return mixed ^ (mixed >> np.uint64(29))


TYPED, FOLDED, PLAIN = 0, 0, 1  # folded windows may meet typed ones; plain ones only plain ones


def items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per item its tokens, the size of its windows, their hashes and which of them have enough literal words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = tokens.find(text or "")
                if not raw:
                    continue
                canon, size = tokens.canonical(raw), min(len(raw), window)
                typed, folded, plain = tokens.forms(raw, np.arange(len(raw)) == 0)
                literal = np.convolve([not x.startswith("<") for x in canon], np.ones(size, int), "valid")
                good = np.flatnonzero(literal * 2 >= size)
                both = [(int(k), int(h[k])) for h in (window_hashes(typed, size, TYPED), window_hashes(folded, size, FOLDED)) for k in good]
                if not both and len(raw) >= window:
                    both = list(enumerate(window_hashes(plain, size, PLAIN).tolist()))
                out.append((item_id, raw, canon, size, len({k for k, _ in both}), [{"at": k, "h": h - (1 << 64) if h >= 1 << 63 else h} for k, h in set(both)], len(good) == 0))
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())])), pa.bool_()]
    names = ["item_id", "raw", "canon", "size", "windows", "hashes", "plain"]
    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        read, "item_id long, raw array<string>, canon array<string>, size int, windows int, hashes array<struct<at: int, h: long>>, plain boolean")


@F.arrow_udf(T.StructType().add("raw", T.ArrayType(T.StringType())).add("canon", T.ArrayType(T.StringType())))
def both_forms(texts: pa.Array) -> pa.Array:
    """Raw and typed tokens of a text; null for a null text."""
    tokens = Tokens()
    raw = [None if t is None else tokens.find(t) for t in texts.to_pylist()]
    canon = [None if r is None else tokens.canonical(r) for r in raw]
    strings = pa.list_(pa.string())
    return pa.StructArray.from_arrays([pa.array(raw, strings), pa.array(canon, strings)], ["raw", "canon"])


def document_windows(docs: DataFrame, sizes: list[int], plain: bool, wanted: np.ndarray | None) -> DataFrame:
    """(d, c, pos, h) of the windows of each text; with ``wanted``, only those whose hash is among them."""

    def probe(hashes: np.ndarray) -> np.ndarray:
        if wanted is None:
            return np.arange(len(hashes))
        some = np.flatnonzero(marked[hashes >> np.uint64(44)])  # a table of first bits spares most of the search
        return some[np.isin(hashes[some], wanted)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            texts, block, size = batch.column(2), [], 0
            for row in range(batch.num_rows + 1):
                if block and (row == batch.num_rows or size >= BLOCK_TOKENS):
                    yield from hits(tokens, batch, block)
                    block, size = [], 0
                if row < batch.num_rows:
                    found = tokens.find(texts[row].as_py())
                    block.append((row, found))
                    size += len(found) + 1

    def hits(tokens: Tokens, batch: pa.RecordBatch, block: list) -> Iterator[pa.RecordBatch]:
        counts = np.array([len(t) for _, t in block])
        owner = np.repeat([row for row, _ in block], counts)
        start = np.repeat(np.cumsum(counts) - counts, counts)
        place = np.arange(len(owner)) - start
        typed, folded, own = tokens.forms([x for _, t in block for x in t], place == 0)
        for size in sizes:
            fits = owner[:len(owner) - size + 1] == owner[size - 1:]
            of_typed = window_hashes(typed, size, TYPED)
            found = [(of_typed, fits)]
            of_folded = window_hashes(folded, size, FOLDED)
            found.append((of_folded, fits & (of_folded != of_typed)))
            if plain:
                found.append((window_hashes(own, size, PLAIN), fits))
            for hashes, valid in found:
                at = probe(hashes)
                at = at[valid[at]]
                if len(at):
                    rows = pa.array(owner[at])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[at], pa.int32()),
                                                      pa.array(hashes[at].view(np.int64))], ["d", "c", "pos", "h"])

    if wanted is not None:
        marked = np.zeros(1 << 20, bool)
        marked[wanted >> np.uint64(44)] = True
    return docs.filter("body is not null").select("d", "c", "body").mapInArrow(read, "d long, c long, pos int, h long")


def item_windows(known: DataFrame) -> DataFrame:
    """(h, item_id, at, size, windows) of the windows by which items are found."""
    return known.select("item_id", "size", "windows", F.explode("hashes").alias("w")).select("w.h", "item_id", "w.at", "size", "windows")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """With a broadcast hint if ``df`` has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _longest(places: Column, size: Column) -> Column:
    """Tokens of the longest stretch that windows of one diagonal cover without a break."""
    start = F.struct(*(F.lit(0).alias(n) for n in ("diagonal", "first", "last", "best")))

    def step(acc: Column, p: Column) -> Column:
        on = (acc["best"] > 0) & (p["diagonal"] == acc["diagonal"]) & (p["at"] - acc["last"] <= size)
        first = F.when(on, acc["first"]).otherwise(p["at"])
        return F.struct(p["diagonal"].alias("diagonal"), first.alias("first"), p["at"].alias("last"), F.greatest(acc["best"], p["at"] + size - first).alias("best"))

    return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["best"])


def candidates(docs: DataFrame, known: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(d, c, item_id, places, windows, size, hits): items with enough windows or a long stretch in a document, and where these lie."""
    index = item_windows(known)
    # at most ``window`` sizes, each with or without plain windows
    sizes = known.filter(F.size("hashes") > 0).groupBy("size").agg(F.max("plain").alias("plain")).orderBy("size").collect()
    few = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = np.unique(np.array([r.h for r in index.select("h").distinct().collect()], np.int64).view(np.uint64)) if few else None
    found = document_windows(docs, [r["size"] for r in sizes], any(r.plain for r in sizes), wanted)
    hits = found.join(F.broadcast(index) if few else index, "h").select("d", "c", "item_id", "at", "size", (F.col("pos") - F.col("at")).alias("diagonal"), "windows")
    places = F.collect_list(F.struct("diagonal", "at"))
    per = hits.distinct().groupBy("d", "c", "item_id").agg(places.alias("places"), F.first("windows").alias("windows"), F.first("size").alias("size"))
    found = per.withColumn("hits", F.size(F.array_distinct(F.transform("places", lambda x: x["at"]))))
    # windows at the ends of a run may lack literal words, so less than ``RUN`` is looked at closely
    return found.filter((F.col("hits") >= F.col("windows") * coverage) | (_longest(F.col("places"), F.col("size")) >= RUN - window))


def _slots(item: Column, places: Column, raw: Column) -> Column:
    """Pairs (item's value, document's value) of the slots under matched windows."""
    each = F.transform(places, lambda p: F.transform(F.sequence(p["at"], p["at"] + item["size"] - 1), lambda i: F.struct(
        F.lower(F.get(item["raw"], i)).alias("of"), F.lower(F.get(raw, i + p["diagonal"])).alias("to"), F.get(item["canon"], i).alias("kind"))))
    return F.array_distinct(F.filter(F.flatten(each), lambda x: x["kind"].startswith("<")))


def _consistent(pairs: Column) -> Column:
    kinds = lambda of, f: F.size(F.array_distinct(F.transform(of, f)))
    both = lambda p: F.struct(p["of"], p["to"])
    others = F.filter(pairs, lambda p: p["kind"] != NUMBER)  # other numbers may happen to be equal
    return (kinds(pairs, both) == kinds(pairs, lambda p: p["of"])) & (kinds(others, both) == kinds(others, lambda p: p["to"]))


def _run(item: Column, raw: Column, canon: Column) -> Column:
    """Some ``RUN`` tokens in a row match on a diagonal, with consistent slots."""

    def at(n: Column) -> Column:
        return F.transform(item["raw"], lambda x, i: F.struct(
            F.lower(x).alias("of"), F.lower(F.get(raw, i + n)).alias("to"), F.get(item["canon"], i).alias("kind"),
            F.coalesce((F.get(item["canon"], i) == F.get(canon, i + n)) | (F.lower(x) == F.lower(F.get(raw, i + n))), F.lit(False)).alias("same")))

    def holds(part: Column) -> Column:
        return F.when(F.forall(part, lambda x: x["same"]), _consistent(F.filter(part, lambda x: x["kind"].startswith("<")))).otherwise(F.lit(False))

    starts = F.sequence(F.lit(1), F.size(item["raw"]) - (RUN - 1))
    diagonals = F.array_distinct(F.transform(item["places"], lambda p: p["diagonal"]))
    found = F.exists(diagonals, lambda n: let(at(n), lambda all_: F.exists(starts, lambda s: let(F.slice(all_, s, F.lit(RUN)), holds))))
    return F.when(F.size(item["raw"]) >= RUN, found).otherwise(F.lit(False))


def flag(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``leaks``: the items found in a document (null where none was looked at closely)."""
    rows = keyed(docs)
    known = items(benchmark, window)
    near = candidates(rows, known, window, coverage).join(_bounded(known.select("item_id", "raw", "canon").dropDuplicates(["item_id"]), BROADCAST_ROWS), "item_id")
    per_doc = near.groupBy("d", "c").agg(F.collect_list(F.struct("item_id", "places", "hits", "windows", "size", "raw", "canon")).alias("near"))
    joined = rows.join(per_doc, ["d", "c"], "left")

    def one_passage(item: Column, raw: Column) -> Column:
        """Some diagonal alone has enough windows and consistent slots: one of several passages in the document."""
        diagonal = lambda n: F.filter(item["places"], lambda p: p["diagonal"] == n)
        return F.exists(F.array_distinct(F.transform(item["places"], lambda p: p["diagonal"])), lambda n: let(diagonal(n), lambda own: (
            F.size(own) >= item["windows"] * coverage) & let(_slots(item, own, raw), _consistent)))

    def enough(item: Column, pairs: Column, raw: Column) -> Column:
        return (item["hits"] >= item["windows"] * coverage) & (_consistent(pairs) | one_passage(item, raw))

    def confirmed(raw: Column, canon: Column) -> Column:
        return F.filter(F.transform("near", lambda item: let(_slots(item, item["places"], raw), lambda pairs: F.struct(
            item["item_id"].alias("item_id"), item["hits"].alias("hits"), item["windows"].alias("windows"),
            F.exists(pairs, lambda p: p["of"] != p["to"]).alias("changed"),
            (enough(item, pairs, raw) | _run(item, raw, canon)).alias("consistent")))), lambda x: x["consistent"])

    # other texts are null to the function, so only candidates are read again
    read = joined.withColumn("forms", both_forms(F.when(F.col("near").isNotNull(), F.col("body"))))
    leaks = F.when(F.col("near").isNotNull(), confirmed(F.col("forms.raw"), F.col("forms.canon")))
    return read.select(*unkeyed(others(docs, "leaks")), leaks.alias("leaks"))


def op5_templates(spark, sf_dir):
    """Every pair of a document and a benchmark item found in it."""
    flagged = flag(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    each = flagged.select("doc_id", F.explode("leaks").alias("x"))
    return (each.groupBy("doc_id", "x.item_id").agg(F.max("x.hits").alias("hits"), F.max("x.windows").alias("windows"),
                                                    F.min("x.changed").alias("changed")))


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents with a benchmark item in them go."""
    flagged = flag(slim(docs), table(spark, sf_dir, "benchmark"))
    return restored(flagged.filter(F.coalesce(F.size("leaks"), F.lit(0)) <= 0), docs.columns)
