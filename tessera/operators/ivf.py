"""Dense top-k through an inverted file: vectors bucketed by the nearest of a few centroids, queries held against few buckets.

``build`` fits the centroids on at most SAMPLE rows, chosen by a hash, and stores every row in the bucket (a partition of
the table) of its nearest centroid. ``search`` reads only buckets that some query probes and scores their rows exactly.
Without ``exact`` it stops after the nearest ``probes`` buckets of each query. With it, the k-th best score found there
decides which other buckets can still hold a better row: no row of a bucket is nearer to a query than the angle to its
centroid less the bucket's widest angle. Those are searched too, so the result is that of comparing with all rows.

Queries never meet rows as joined pairs: a bucket is cut into parts of PART rows and its queries into blocks of BLOCK, and a
task multiplies one by the other and keeps k rows for each query.

Rows whose vector is null, without a direction, or of another length than the centroids are in bucket -1; as their cosine
counts as 0, an exact search reads it if it needs to, except for null vectors, which are never found. Queries of such kinds
find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Rows that the centroids are fitted to; buckets at most; rows and queries that meet in one product.
SAMPLE, MOST_CELLS, PART, BLOCK = 20_000, 4096, 4096, 512
PROBES, SLACK = 8, 1e-9


@dataclass
class Index:
    """A table of (id, vector, angle, cell) at ``path``, with its centroids (unit vectors) and the widest angle of each bucket."""

    path: str
    centroids: np.ndarray
    widest: np.ndarray
    rows: dict[int, int]
    schema: str

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column, and which rows have one."""
    lengths = np.array([len(x) if x.is_valid else -1 for x in column])
    able = lengths == width
    values = column.filter(pa.array(able)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if able.any() else np.empty((0, width))
    norms = np.sqrt((values * values).sum(axis=1))
    fine = np.isfinite(norms) & (norms > 0)
    able[np.flatnonzero(able)[~fine]] = False
    return values[fine] / norms[fine, None], able


def _nearest(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Angles of each vector (row) to each centroid."""
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def build(vectors: DataFrame, path: str, id_col: str, vector_col: str = "embedding", cells: int | None = None, seed: int = 7) -> Index:
    """Write an index of all rows to ``path``; by default as many buckets as the square root of the rows."""
    spark = vectors.sparkSession
    n = vectors.count()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = rows.filter(F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    part = rows.sparkSession.createDataFrame([], rows.schema) if not n else usable.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < min(1 << 30, math.ceil((1 << 30) * SAMPLE / n)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    part = part.withColumn("unit", F.transform("vector", lambda x: x / norm))
    widths = part.groupBy(F.size("unit").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 1
    k = max(1, min(cells or math.ceil(math.sqrt(n)), MOST_CELLS, widths["count"] if widths else 1))
    if widths:
        model = KMeans(k=k, maxIter=8, initMode="random", seed=seed, featuresCol="features").fit(part.filter(F.size("unit") == width).select(array_to_vector("unit").alias("features")))
        centroids = np.array([list(c) for c in model.clusterCenters()])
        size = np.sqrt((centroids * centroids).sum(axis=1))
        centroids = centroids[size > 0] / size[size > 0, None]
    else:
        centroids = np.ones((1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                units, able = _matrix(some.column(1), width)
                cell, angle = np.full(some.num_rows, -1), np.zeros(some.num_rows)
                angles = _nearest(units, centroids)
                cell[able], angle[able] = angles.argmin(axis=1), angles.min(axis=1, initial=4.0)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(angle), pa.array(cell.astype(np.int32))], names=["id", "vector", "angle", "cell"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, vector array<double>, angle double, cell int"
    placed = rows.mapInArrow(assign, schema)
    placed.hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(path)
    per = spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.max("angle").alias("widest"), F.count("*").alias("n")).collect()  # one row a bucket
    widest = np.zeros(len(centroids))
    for r in per:
        if r["cell"] >= 0:
            widest[r["cell"]] = r["widest"]
    return Index(path, centroids, widest, {r["cell"]: r["n"] for r in per}, schema)


def _probes(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """(query_id, vector, cell) of the first ``probes`` buckets of each query, or, where ``least`` is not null, of the others
    that can hold a row as near as that."""
    kind, centroids, widest = queries.schema["query_id"].dataType.simpleString(), index.centroids, index.widest
    there = np.array([index.rows.get(c, 0) > 0 for c in range(len(centroids))])
    odd = index.rows.get(-1, 0) > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                units, able = _matrix(some.column(1), centroids.shape[1])
                angles = np.where(there, _nearest(units, centroids), np.inf)
                order = np.argsort(angles, axis=1, kind="stable")
                row, cell = [], []
                for i, (r, least) in enumerate(zip(np.flatnonzero(able), np.array(some.column(2).to_pylist(), object)[able], strict=True)):
                    near, far = order[i, :probes], order[i, probes:]
                    if least is None:
                        found = [int(c) for c in near if there[c]]
                    else:
                        best = np.cos(np.maximum(0.0, angles[i, far] - widest[far] - SLACK))
                        found = [int(c) for c in far[there[far] & (best + SLACK >= least)]] + ([-1] if odd and least <= 0 else [])
                    row += [r] * len(found)
                    cell += found
                at = pa.array(np.array(row, np.int64))
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(cell, pa.int32())], names=["query_id", "vector", "cell"])

    return queries.select("query_id", "vector", "least").mapInArrow(work, f"query_id {kind}, vector array<double>, cell int")


def _scored(spark: SparkSession, index: Index, probed: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best rows of each part of each probed bucket."""
    cells = [r["cell"] for r in probed.select("cell").distinct().collect()]  # at most as many as buckets: they prune the table's partitions
    rows = index.table(spark).filter(F.col("cell").isin(cells) & F.col("vector").isNotNull())
    parts = F.create_map(*[F.lit(x) for c in cells for x in (c, -(-index.rows.get(c, 1) // PART))]) if cells else F.create_map(F.lit(0), F.lit(1))
    blocks = probed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    kind, asked = rows.schema["id"].dataType.simpleString(), probed.schema["query_id"].dataType.simpleString()
    left = probed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)).alias("part"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("id"), "query_id", "vector")
    right = rows.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), parts[F.col("cell")]).cast("int").alias("part"), F.lit(0).alias("side"), "id", F.lit(None).cast(asked).alias("query_id"), "vector")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, stored, out = None, [], [], ([], [], [])
        matrix = None

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa_query), pa.array(out[1], pa_id), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])
            for x in out:
                x.clear()
            return made

        pa_query = pa_id = None
        for batch in batches:
            pa_query, pa_id = batch.schema.field("query_id").type, batch.schema.field("id").type
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "part")), strict=True))
            sides, own, asks, lists = (batch.column(c).to_pylist() for c in ("side", "id", "query_id", "vector"))
            for key, side, ident, query, vector in zip(keys, sides, own, asks, lists, strict=True):
                if key != at:
                    at, ids, stored, matrix = key, [], [], None
                if not side:
                    ids.append(ident)
                    stored.append(vector)
                    continue
                if not ids:
                    continue
                if matrix is None:
                    matrix = [(np.array(v), math.sqrt(sum(x * x for x in v))) for v in stored] if at[0] < 0 else np.array(stored)
                    norms = None if at[0] < 0 else np.sqrt((matrix * matrix).sum(axis=1))
                q = np.array(vector)
                # rows are summed one by one, so equal rows have equal scores
                scores = np.zeros(len(ids)) if at[0] < 0 else (matrix * q).sum(axis=1) / (norms * math.sqrt(float((q * q).sum())))
                best = np.argsort(-scores, kind="stable")[:k]  # rows come in order of their ids
                out[0].extend([query] * len(best))
                out[1].extend(ids[b] for b in best)
                out[2].extend(scores[best].tolist())
                if len(out[0]) > 50_000:
                    yield flush()
            if out[0]:
                yield flush()

    both = left.unionByName(right).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "side", "id")
    return both.select("cell", "block", "part", "side", "id", "query_id", "vector").mapInArrow(work, f"query_id {asked}, id {kind}, score double")


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, query_col: str = "query_id", vector_col: str = "embedding", probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k rows of largest cosine for each query, ties by id."""
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("least"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = _scored(spark, index, _probes(asked, index, probes), k)
    if exact:
        best = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        rest = asked.drop("least").join(best, "query_id", "left").withColumn("least", F.coalesce("reached", F.lit(-2.0)))
        found = found.unionByName(_scored(spark, index, _probes(rest, index, probes), k))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
