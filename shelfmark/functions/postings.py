"""Postings of batches of parents and their scores for many questions, counted with Arrow and NumPy inside the tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words counted in one go; a piece holds one block of parents at least.
WORDS_AT_ONCE = 1_000_000
# Parents scored in one go.
ROWS_AT_ONCE = 512


def term_counts(terms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of term lists: the distinct terms, (term number, row, count) ordered by both, and the lists' lengths."""
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(terms).dictionary_encode()
    rows = max(1, len(sizes))
    keys = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * rows + np.repeat(np.arange(len(sizes)), sizes)
    keys, counts = np.unique(keys, return_counts=True)
    code, row = np.divmod(keys, rows)
    return words.dictionary, code, row, counts.astype(np.int32), sizes


def blocks_of(carry: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over parents (*carry, block, id, book_id, author, terms) whose blocks are neighbouring rows: a row per term and block."""
    marks = (*carry, "block")

    def starts_of(t: pa.Table) -> np.ndarray:
        """The first row of each block."""
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for name in marks:
            code = t[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def counted(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        terms, code, row, tf, dl = term_counts(t["terms"].combine_chunks())
        at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (group[row[1:]] != group[row[:-1]]))[:len(code)])
        first, dl = pa.array(row[at]), dl.astype(np.int32)
        column = lambda name: t[name].combine_chunks()
        kept = [column(name).take(pa.array(row)) for name in ("id", "book_id", "author")]
        entries = pa.StructArray.from_arrays([*kept, pa.array(tf), pa.array(dl[row])], ["id", "book_id", "author", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), entries)
        n = np.diff(np.append(at, len(row))).astype(np.int32)
        most, least = (np.maximum.reduceat(tf, at), np.minimum.reduceat(dl[row], at)) if len(at) else (tf, dl[:0])
        return pa.RecordBatch.from_arrays([*(column(name).take(first) for name in carry), terms.take(pa.array(code[at])), column("block").take(first),
                                           pa.array(n), pa.array(most), pa.array(least), lists],
                                          [*carry, "term", "block", "n", "max_tf", "min_dl", "entries"])

    def pieces(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = pc.fill_null(pc.list_value_length(t["terms"].combine_chunks()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.add.reduceat(sizes, starts).cumsum() // WORDS_AT_ONCE
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(starts))
        ends = np.append(starts, t.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield counted(t.slice(ends[a], ends[b] - ends[a]), starts[a:b] - ends[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if t.num_rows:
                starts = starts_of(t)  # the last block may go on in the next batch
                held = t.slice(starts[-1])
                if len(starts) > 1:
                    yield from pieces(t.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from pieces(held, np.zeros(1, np.int64))

    return run


def best_matches(
    terms: Sequence[str], idf: Sequence[float], wanted: Sequence[tuple[int, int]], questions: int, saturation: Callable, k: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over parents (id, terms): the ``k`` best of each question, as (q, id, _score).

    ``wanted`` pairs a question with a term it asks for. A matrix product scores a block of
    parents against all questions. Scores have nine digits, so equal texts tie wherever they
    are met, and ties go by id. A task holds at most k rows per question and one block.
    """
    names = ["q", "id", "_score"]

    def best(found: list[tuple]) -> tuple:
        q, ids, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], ids[keep], score[keep]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = pa.array(terms, pa.string()), np.asarray(idf)
        gains = np.zeros((len(terms), questions))
        for q, t in wanted:
            gains[t, q] = weights[t]
        held, limit = None, np.zeros(questions)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                block = batch.slice(start, ROWS_AT_ONCE)
                found, code, row, tf, dl = term_counts(block.column(1))
                place = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)[code]
                asked = place >= 0
                row, tf, place = row[asked], tf[asked], place[asked]
                shares = np.zeros((block.num_rows, len(terms)))
                shares[row, place] = saturation(tf, dl[row])
                scores = shares @ gains
                rounded = np.round(scores, 9)
                if len(rounded) > k:
                    limit = np.maximum(limit, -np.partition(-rounded, k - 1, axis=0)[k - 1])
                at, q = np.nonzero((rounded >= limit) & (scores > 0))
                ids = np.array(block.column(0).take(pa.array(at)).to_pylist(), dtype=object).astype(str)
                new = (q, ids, rounded[at, q])
                held = best([held, new] if held else [new])
                full = np.flatnonzero(np.bincount(held[0], minlength=questions) >= k)
                limit[full] = np.maximum(limit[full], held[2][np.searchsorted(held[0], full, "right") - 1])
        if held:
            q, ids, score = held
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids.tolist(), pa.string()), pa.array(score, pa.float64())], names)

    return search
