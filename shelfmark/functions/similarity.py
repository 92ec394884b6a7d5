"""Vector distances: one question as a column expression, many as blocked matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T
import sys

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def squared_l2(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance in double precision, one Arrow batch at a time.

    Null for a vector that is null, has another width, or holds a null or a NaN.
    """
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def distance(batch: pa.Array) -> pa.Array:
        widths = batch.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        fits = widths == target.size
        out = np.full(len(batch), np.nan)
        if fits.any():
            flat = batch.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            gaps = flat.reshape(-1, target.size) - target
            out[fits] = np.einsum("ij,ij->i", gaps, gaps)
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return distance(vector)


ROWS_AT_ONCE, PAIRS_AT_ONCE = 2048, 16_384


def nearest_of(questions: Sequence[Sequence[float]], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches of (id, parent_id, vector): the ``n`` nearest rows of each question, as (q, id, parent_id, _distance).

    A matrix product ranks a block of rows against all questions at once; only rows near
    enough to matter are measured exactly, as ``squared_l2`` does, so results are the same.
    A task holds at most n rows per question and one block.
    """
    asked = np.asarray(questions, dtype=np.float64)
    names = ["q", "id", "parent_id", "_distance"]

    def best(found: list[tuple]) -> tuple:
        q, ids, parents, distance = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids, distance, q))
        q, ids, parents, distance = q[order], ids[order], parents[order], distance[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < n
        return q[keep], ids[keep], parents[keep], distance[keep]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (asked ** 2).sum(1)
        usable = np.isfinite(size)
        held, limit = None, np.full(len(asked), np.inf)
        for batch in batches:
            widths = batch.column(2).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(widths == asked.shape[1]))
            for start in range(0, some.num_rows, ROWS_AT_ONCE):
                block = some.slice(start, ROWS_AT_ONCE)
                rows = block.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, asked.shape[1])
                lengths = (rows ** 2).sum(1)
                near = lengths[:, None] + size - 2 * rows @ asked.T
                near[np.isnan(near)] = np.inf
                if len(near) > n:
                    limit = np.minimum(limit, np.partition(near, n - 1, axis=0)[n - 1])
                slack = 1e-9 * (1 + size + np.nan_to_num(lengths).max(initial=0))
                at, q = np.nonzero((near <= limit + slack) & np.isfinite(near) & usable)
                distance = np.concatenate([np.einsum("ij,ij->i", g, g) for g in (
                    rows[at[k:k + PAIRS_AT_ONCE]] - asked[q[k:k + PAIRS_AT_ONCE]] for k in range(0, len(at), PAIRS_AT_ONCE))] or [np.empty(0)])
                ids, parents = (np.array(block.column(c).take(pa.array(at)).to_pylist(), dtype=object) for c in (0, 1))
                new = (q, ids.astype(str), parents, distance)
                held = best([held, new] if held else [new])
                full = np.flatnonzero(np.bincount(held[0], minlength=len(asked)) >= n)
                limit[full] = np.minimum(limit[full], held[3][np.searchsorted(held[0], full, "right") - 1])
        if held:
            q, ids, parents, distance = held
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids.tolist(), pa.string()), pa.array(parents.tolist(), pa.string()), pa.array(distance)], names)

    return search
