"""Language identification by hyperdimensional profiles.

Each letter stands for a random vector of +1 and -1 (drawn from its code point, so
every task and run has the same one and no alphabet is fixed). A trigram binds its
letters: their vectors, moved on by two, one and no places, are multiplied. A text's
profile bundles (adds up) its trigrams' vectors, a language's prototype those of all
its training documents. A text is of the language whose prototype has the greatest
cosine with its profile.

Letters are lower-cased; every run of other characters, and each end of the text,
counts as one blank. Sums are of whole numbers and exact, so neither the order of
rows nor their partition changes a result. Counting a block's trigrams first and
multiplying the counts with the trigrams' vectors makes the same sums as adding
vectors one by one.

Texts stay where they are read: a task sends one partial prototype per language it
saw, and prototypes (``LANGUAGES`` times ``DIMENSIONS`` numbers at most) travel with
the second pass. Tasks hold a block of trigrams, a table of letter vectors and one text.

Defined cases: a text that is null or without a letter is ``und`` with score 0, and so
is every text if there is nothing to learn from; null ids are not learned from and not
held out; equal cosines (to nine digits) go to the first language by name; negative
cosines score 0; of more than ``LANGUAGES`` languages those with most training
documents are learned; repeated rows count each; an empty table gives no rows; only
``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import carried, table

carried(__name__)

DIMENSIONS, SEED = 2048, 20_260
# A bound of the classifier, far above the number of languages in use.
LANGUAGES = 1024
UNKNOWN = "und"
BLANK = 32
# Trigrams and texts counted together, trigram vectors made together, letter vectors kept: they bound memory, not results.
BLOCK, ROWS, TOGETHER, KEPT = 1 << 20, 256, 4096, 4096


class Bundler:
    """Profiles of texts; one per task."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.kind = np.zeros(0x110000, np.int8)  # per code point: 0 not met yet, 1 letter, 2 other
        self.drawn: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        vector = self.drawn.get(code)
        if vector is None:
            if len(self.drawn) >= KEPT:
                self.drawn.clear()
            bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, self.dimensions, np.int8)
            vector = self.drawn[code] = bits * 2 - 1
        return vector

    def letters(self, text: str | None) -> np.ndarray:
        """Code points of the letters with blanks between and around them; empty without a letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        new = np.unique(codes[self.kind[codes] == 0])
        self.kind[new] = [1 if chr(c).isalpha() else 2 for c in new.tolist()]
        is_letter = self.kind[codes] == 1
        if not is_letter.any():
            return codes[:0]
        keep = is_letter | np.r_[True, is_letter[:-1]]
        out = np.where(is_letter, codes, BLANK)[keep]
        ends = ([BLANK] if out[0] != BLANK else []), ([BLANK] if out[-1] != BLANK else [])
        return np.concatenate([np.array(ends[0], np.uint32), out, np.array(ends[1], np.uint32)]) if ends[0] or ends[1] else out

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of trigrams, given as rows of three code points."""
        codes, at = np.unique(grams, return_inverse=True)
        known = np.stack([self.letter(c) for c in codes.tolist()])
        first, second, third = at.reshape(grams.shape).T
        return np.roll(known, 2, 1)[first] * np.roll(known, 1, 1)[second] * known[third]

    def _add(self, sums: np.ndarray, codes: np.ndarray, owner: np.ndarray) -> None:
        """Add the trigrams of ``codes`` to the rows ``owner`` of ``sums``; owner is -1 where none starts."""
        alphabet, at = np.unique(codes, return_inverse=True)
        n = len(alphabet)
        keys = ((at[:-2] * n + at[1:-1]) * n + at[2:])
        starts = owner[:-2] >= 0
        keys, rows = keys[starts], owner[:-2][starts]
        if n ** 3 <= 4 * BLOCK:  # a small alphabet: number the trigrams by counting
            used = np.flatnonzero(np.bincount(keys, minlength=n ** 3))
            number = np.zeros(n ** 3, np.int64)
            number[used] = np.arange(len(used))
            keys = number[keys]
        else:
            used, keys = np.unique(keys, return_inverse=True)
        grams = alphabet[np.stack([used // (n * n), used // n % n, used % n], 1)]
        for low in range(0, len(used), TOGETHER):
            width = min(TOGETHER, len(used) - low)
            here = (keys >= low) & (keys < low + width) if len(used) > TOGETHER else slice(None)
            counts = np.bincount(rows[here] * width + keys[here] - low, minlength=len(sums) * width).reshape(len(sums), width)
            # exact: no sum reaches 2^24, as a block has fewer trigrams
            sums += counts.astype(np.float32) @ self.vectors(grams[low:low + width]).astype(np.float32)

    def profiles(self, texts: list[np.ndarray], owners: list[int], rows: int) -> np.ndarray:
        """``rows`` bundles; text i (from ``letters``) is added to bundle ``owners[i]``."""
        sums = np.zeros((rows, self.dimensions))
        codes, owner, size = [], [], 0

        def flush():
            nonlocal codes, owner, size
            if size:
                self._add(sums, np.concatenate(codes), np.concatenate(owner))
            codes, owner, size = [], [], 0

        for text, own in zip(texts, owners, strict=True):
            for start in range(0, max(len(text) - 2, 0), BLOCK):  # a longer text in pieces that share two letters
                piece = text[start:start + BLOCK + 2]
                mark = np.full(len(piece), own)
                mark[-2:] = -1
                if size + len(piece) > BLOCK:
                    flush()
                codes.append(piece)
                owner.append(mark)
                size += len(piece)
        flush()
        return sums


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def prototypes(training: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages by name and their prototypes, from all rows (text, lang)."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, total = Bundler(dimensions), {}
        for batch in _blocks(batches):
            own = batch.column(1).to_pylist()
            here = {name: i for i, name in enumerate(dict.fromkeys(own))}
            sums = bundler.profiles([bundler.letters(t.as_py()) for t in batch.column(0)], [here[name] for name in own], len(here))
            for name, i in here.items():
                total[name] = total.get(name, 0) + sums[i].astype(np.int64)
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], ["lang", "at", "v"])

    rows = training.select("text", F.col("lang").cast("string")).filter("lang is not null")
    learned = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    parts = rows.join(F.broadcast(learned), "lang", "left_semi").select("text", "lang").mapInArrow(bundle, "lang string, at int, v long")
    each = parts.groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found = sorted(each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("all")).select("lang", F.col("all.v").alias("v")).collect())
    return [r.lang for r in found], np.array([r.v for r in found], float).reshape(-1, dimensions)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors ** 2).sum(1, keepdims=True)), 1)


def predict(docs: DataFrame, languages: list[str], vectors: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of rows (doc_id, held_out, text)."""
    against, dimensions = _units(vectors).T, vectors.shape[1]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions)
        for batch in _blocks(batches):
            texts = [bundler.letters(t.as_py()) for t in batch.column(2)]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if languages:
                near = np.round(_units(bundler.profiles(texts, list(range(len(texts))), len(texts))) @ against, 9)
                best = near.argmax(1)
                lettered = np.array([len(t) > 0 for t in texts], bool)
                scores = np.where(lettered, np.clip(near[np.arange(len(texts)), best], 0, 1), 0.0)
                names = [languages[i] if there else UNKNOWN for i, there in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(look, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """A fixed quarter of the documents, by the id's CRC."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op11_profiles(spark, sf_dir):
    """Every document's language, learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    languages, vectors = prototypes(docs.filter("not held_out and doc_id is not null"))
    return predict(docs, languages, vectors)
