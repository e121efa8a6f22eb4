"""The k rows nearest to each query, pair by pair: rows pass by in batches, queries are told to all tasks in blocks, and products are numpy's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that are told to all tasks at once, about; queries that meet a batch together.
QUERY_BLOCK, TOGETHER = 16_384, 512


def plain(v: Column, dim: int | None) -> Column:
    """Whether a vector has ``dim`` components, all finite."""
    return F.coalesce((F.size(v) == F.lit(dim or 0)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """``queries`` (query_id, ...) in blocks of about QUERY_BLOCK."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    for block in range(n):
        yield (queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block)).toArrow().combine_chunks()


def _norms(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1))
    return np.where(n == 0, 1.0, n)


def near(rows: DataFrame, told: pa.Table, dim: int, k: int, wanted: np.ndarray | None = None, least: np.ndarray | None = None, within: float | None = None) -> DataFrame:
    """(query_id, vec_id, score): of each batch of ``rows`` (vec_id, embedding), plain ones, those that may be of the k nearest to a query of ``told`` (query_id, q), by cosine to 6 digits.

    ``wanted`` are bits by query and cell: a query meets rows (cell) of its cells alone.  ``least`` is a score that k rows of a query reach.  With ``within`` pairs are those that lie closer and share a
    value of ``h`` in its place; scores are then 1 - d * d / 2.
    """
    tell = rows.sparkSession.sparkContext.broadcast
    ids, q = told["query_id"].combine_chunks(), matrix(told["q"].combine_chunks(), dim)
    h = matrix(told["h"].combine_chunks(), told["h"].combine_chunks().value_lengths()[0].as_py()) if within and len(ids) else None
    shared = tell((ids, q, _norms(q), wanted, np.full(len(ids), -np.inf) if least is None else least, h))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, q_norm, wanted, least, h = shared.value
        tops = np.repeat(least[:, None], k, axis=1)  # the k best scores of each query so far, ascending
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = matrix(batch.column("embedding"), dim)
            norm = _norms(x)
            hx = matrix(batch.column("h"), h.shape[1]) if within else None
            key = batch.column("vec_id")
            cells = batch.column("cell").to_numpy(zero_copy_only=False) if wanted is not None else np.zeros(len(x), int)
            for cell in np.unique(cells):
                own = np.flatnonzero(cells == cell)
                asking = np.arange(len(ids)) if wanted is None else np.flatnonzero(wanted[:, cell >> 3] >> (7 - (cell & 7)) & 1)
                for at in range(0, len(asking), TOGETHER):
                    of = asking[at : at + TOGETHER]
                    s = q[of] @ x[own].T
                    if within:
                        s = 1 - np.maximum((q[of] ** 2).sum(axis=1)[:, None] + (x[own] ** 2).sum(axis=1) - 2 * s, 0) / 2
                        s[(hx[own][None, :, :] == h[of][:, None, :]).any(axis=2) < 1] = -np.inf
                        s[s <= 1 - within * within / 2] = -np.inf
                    else:
                        s /= q_norm[of][:, None] * norm[own]
                    low = tops[of, 0]
                    if len(own) > k and np.isneginf(low).any():
                        low = np.maximum(low, np.partition(s, len(own) - k, axis=1)[:, len(own) - k])
                    a, b = np.nonzero((s >= low[:, None] - 2e-6) & (s > -np.inf))
                    score = np.round(s[a, b], 6)
                    keep = score >= tops[of[a], 0]
                    a, b, score = of[a[keep]], own[b[keep]], score[keep]
                    if not len(a):
                        continue
                    rank = np.empty(len(x), np.int64)
                    rank[pc.sort_indices(key).to_numpy()] = np.arange(len(x))
                    order = np.lexsort((rank[b], -score, a))
                    a, b, score = a[order], b[order], score[order]
                    first = np.arange(len(a)) - np.searchsorted(a, a) < k
                    a, b, score = a[first], b[first], score[first]
                    each, begin, n = np.unique(a, return_index=True, return_counts=True)
                    for one, i, m in zip(each, begin, n):
                        tops[one] = np.sort(np.concatenate([tops[one], score[i : i + m]]))[-k:]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), key.take(pa.array(b)), pa.array(score)], names=["query_id", "vec_id", "score"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    asked = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}[ids.type]
    return rows.select("vec_id", "embedding", *(["cell"] if wanted is not None else []), *(["h"] if within else [])).mapInArrow(pairs, f"query_id {asked}, vec_id {kind}, score double")
