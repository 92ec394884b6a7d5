"""Token counts per section of a document, by offsets of one whole encoding.

A document is encoded once as a whole; encoding its sections one by one would cut
tokens that run over a boundary. The bytes of the tokens give their character
spans, which are joined to the sections' intervals by binary search. A token that
lies in several sections is allocated by one rule:

* ``majority`` (default): the section with most of its characters, the earlier one on a tie;
* ``first`` / ``last``: the section of its first / last character.

Every token is counted once, so the counts of a document add up to its length;
tokens outside all sections are returned under section -1. A document is one row
with its sections in an array, so nothing is shuffled.

Defined cases: a null or empty text has no tokens and one row per section it names;
sections may be empty (count 0) but must not overlap; equal rows are counted each;
an empty table gives no rows; only ``doc_id``, ``text`` and ``sections`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.bpe import encoder_of, token_widths, vocabulary
from shelfmark.llm.common import carried, table

carried(__name__)

OUTSIDE = -1
RULES = ("majority", "first", "last")


def line_sections(text: Column) -> Column:
    """The lines of a text as sections (start, end) in characters; a line ends with its line feed."""
    lines = F.split(text, "\n", -1)
    sizes = F.transform(lines, lambda x, i: F.length(x) + F.when(i < F.size(lines) - 1, F.lit(1)).otherwise(F.lit(0)))
    return F.coalesce(sizes, F.array().cast("array<int>"))


def token_spans(text: str, ids: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token; a token of part of a character spans that character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    stops = np.cumsum(widths[ids])
    return character[stops - widths[ids]], character[stops - 1] + 1


def owners(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; ``starts`` and ``ends`` are sorted and do not overlap."""
    def at(character: np.ndarray) -> np.ndarray:
        i = np.searchsorted(starts, character, "right") - 1
        return np.where((i >= 0) & (character < ends[np.maximum(i, 0)]), i, OUTSIDE) if len(starts) else np.full(len(character), OUTSIDE)

    a, b = at(first), at(end - 1)
    if rule == "first":
        return a
    if rule == "last":
        return b
    out = a.copy()
    for k in np.flatnonzero(a != b):  # the few tokens over a boundary
        lo = max(0, int(np.searchsorted(ends, first[k], "right")))
        hi = int(np.searchsorted(starts, end[k], "left"))
        share = np.minimum(ends[lo:hi], end[k]) - np.maximum(starts[lo:hi], first[k])
        out[k] = lo + int(np.argmax(share)) if len(share) and share.max() > 0 else OUTSIDE
    return out


def count(docs: DataFrame, rule: str = "majority") -> DataFrame:
    """Rows (doc_id, section, start, chars, tokens, crossing).

    ``docs`` has ``doc_id``, ``text`` and ``sizes``: the lengths of its consecutive
    sections in characters. ``crossing`` counts the section's tokens that also lie
    in another one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    whole_path, ranks_path = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, widths = encoder_of(whole_path, ranks_path), token_widths(ranks_path)
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text, sizes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, sizes = text.as_py() or "", np.array(sizes or [], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                ids = np.frombuffer(encoder.ids(text), "<u4")
                if len(ids):
                    first, end = token_spans(text, ids, widths)
                    used = np.flatnonzero(sizes)  # an empty section owns no character
                    own = owners(first, end, starts[used], ends[used], rule)
                    own = np.where(own >= 0, used[own] if len(used) else OUTSIDE, OUTSIDE)
                    i = np.searchsorted(ends[used], first, "right")
                    over = (end > ends[used][np.minimum(i, len(used) - 1)]) & (i < len(used)) if len(used) else np.zeros(len(ids), bool)
                else:
                    own, over = np.empty(0, np.int64), np.empty(0, bool)
                n = np.bincount(own + 1, minlength=len(sizes) + 1)
                crossing = np.bincount(own[over] + 1, minlength=len(sizes) + 1)
                keep = range(0 if n[0] else 1, len(sizes) + 1)
                out[0] += [doc_id] * len(keep)
                out[1] += [k - 1 for k in keep]
                out[2] += [int(starts[k - 1]) if k else None for k in keep]
                out[3] += [int(sizes[k - 1]) if k else None for k in keep]
                out[4] += n[keep.start:].tolist()
                out[5] += crossing[keep.start:].tolist()
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)],
                                             ["doc_id", "section", "start", "chars", "tokens", "crossing"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("sizes").cast("array<long>"))
    return rows.mapInArrow(run, "doc_id long, section int, start long, chars long, tokens long, crossing long")


def op7_offset_counts(spark, sf_dir):
    """Tokens of every line of every document."""
    docs = table(spark, sf_dir, "documents")
    return count(docs.select("doc_id", "text", line_sections(F.col("text")).alias("sizes")))
