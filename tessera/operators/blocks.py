"""Top-k of all queries against all rows, block by block: the ground truth that an index is held against.

Rows are dealt into parts of about PART and queries into blocks of about BLOCK; each block meets each part in one task,
which holds both as matrices. A product of unit vectors, CHUNK queries at a time, says which rows may be among the k best;
of those the cosine is computed as :func:`tessera.functions.vectors.cosine` does, term by term, so equal vectors have
equal scores and what decides is the exact score, then the id. A task gives k rows a query, whatever the table's size.

Defined cases are those of ``cosine``: null where a vector, or a component of two of equal length, is null, which comes last;
0 for vectors of different lengths or without a direction; a score that isn't a number comes first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows and queries that meet in a task, queries in one product, and by how much products may be off.
PART, BLOCK, CHUNK, SLACK = 8192, 4096, 256, 1e-9


class _Side:
    """Vectors of a list column, by their lengths."""

    def __init__(self, column: pa.Array):
        n = len(column)
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        self.width = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, size = column.flatten(), np.maximum(self.width, 0)
        values, gaps = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), flat.is_null().to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        self.bad, self.norm, self.row, self.groups = np.zeros(n, bool), np.zeros(n), np.zeros(n, np.int64), {}
        for w in np.unique(self.width[~self.null]).tolist():
            at = np.flatnonzero(self.width == w)
            places = start[at, None] + np.arange(w)
            by_term = np.ascontiguousarray(values[places].T)
            norm = np.zeros(len(at))
            for x in by_term:
                norm += x * x
            norm = np.sqrt(norm)
            self.bad[at], self.norm[at], self.row[at] = gaps[places].any(axis=1), norm, np.arange(len(at))
            fine = np.isfinite(norm) & (norm > 0)
            self.groups[w] = (at, by_term, np.where(fine, by_term / np.where(fine, norm, 1), 0).T, at[~np.isfinite(norm)])


def _scores(one: _Side, two: _Side, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the pairs (a, b), and which are null."""
    out, null = np.zeros(len(a)), one.null[a] | two.null[b]
    same = ~null & (one.width[a] == two.width[b])
    null |= same & (one.bad[a] | two.bad[b])
    for w in one.groups.keys() & two.groups.keys():
        own = np.flatnonzero(same & (one.width[a] == w))
        i, j, dot = one.row[a[own]], two.row[b[own]], np.zeros(len(own))
        for x, y in zip(one.groups[w][1], two.groups[w][1]):
            dot += x[i] * y[j]
        size = one.norm[a[own]] * two.norm[b[own]]
        out[own] = np.where(size == 0, 0.0, dot / np.where(size == 0, 1.0, size))
    return out, null


def _key(score: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Larger is better: no number first, null last."""
    return np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))


def _best(asked: _Side, rows: _Side, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score, null) of the k best rows of each query, by score, then by place."""
    m, n = len(asked.null), len(rows.null)
    near = np.zeros((m, n))
    for w in asked.groups.keys() & rows.groups.keys():
        (at, _, units, odd), (to, _, stored, strange) = asked.groups[w], rows.groups[w]
        near[np.ix_(at, to)] = units @ stored.T
        for i, j in ((odd, to), (at, strange)):
            if len(i) and len(j):
                a, b = np.repeat(i, len(j)), np.tile(j, len(i))
                near[a, b] = _key(*_scores(asked, rows, a, b))
        near[np.ix_(at[asked.bad[at]], to)] = near[np.ix_(at, to[rows.bad[to]])] = -np.inf
    near[asked.null] = near[:, rows.null] = -np.inf
    least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(m, -np.inf)
    q, r = np.nonzero(near >= (least - SLACK)[:, None])
    score, null = _scores(asked, rows, q, r)
    order = np.lexsort((r, -_key(score, null), q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    order = order[place < k]
    return q[order], r[order], score[order], null[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str, vector_col: str) -> DataFrame:
    """(query, id, score): the k best rows of every part of ``vectors`` for each query."""
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, PART), (queries, BLOCK)))
    kinds = {df.schema[vector_col].dataType.simpleString() for df in (vectors, queries)}
    vector = F.col(vector_col).cast("array<float>" if kinds == {"array<float>"} else "array<double>").alias("vector")
    kind, asked = vectors.schema[id_col].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(every(blocks).alias("block"), deal(id_col, parts).alias("part"), F.lit(0).alias("side"), F.col(id_col).alias("id"), F.lit(None).cast(asked).alias("query"), vector)
    right = queries.select(deal(query_col, blocks).alias("block"), every(parts).alias("part"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("id"), F.col(query_col).alias("query"), vector)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = None, [], None
        for batch in batches:
            block, part, side = (batch.column(c).to_numpy() for c in ("block", "part", "side"))
            ends = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *ends], [*ends, batch.num_rows]):
                if lo == hi:
                    continue
                if (block[lo], part[lo]) != at:
                    at, held, rows = (block[lo], part[lo]), [], None
                if side[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if not held:
                    continue
                if rows is None:
                    stored = pa.Table.from_batches(held).select(["id", "vector"]).combine_chunks().to_batches()[0]
                    rows, held = _Side(stored.column("vector")), [stored]
                for first in range(lo, hi, CHUNK):
                    some = batch.slice(first, min(CHUNK, hi - first))
                    q, r, score, null = _best(_Side(some.column("vector")), rows, k)
                    yield pa.RecordBatch.from_arrays([some.column("query").take(pa.array(q)), held[0].column("id").take(pa.array(r)), pa.array(score, mask=null)], names=["query", "id", "score"])

    # a row meets every block and a query every part: what is dealt grows with rows x queries / PART or BLOCK
    both = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "side", "id")
    return both.mapInArrow(work, f"query {asked}, id {kind}, score double").select(F.col("query").alias(query_col), F.col("id").alias(id_col), "score")
