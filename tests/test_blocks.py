"""Blocks of queries and rows against the cosine of every pair."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tessera.functions.vectors import cosine
from tessera.operators import blocks, ranking as K

SCHEMA = "id long, embedding array<double>"


def every_pair(vectors, queries, k):
    pairs = vectors.crossJoin(queries.select("query_id", F.col("embedding").alias("query")))
    scored = pairs.select("query_id", "id", cosine(F.col("embedding"), F.col("query")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def same(one, two):
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], repr(r["score"])) for r in df.collect())
    found = rows(one)
    assert found == rows(two)
    return found


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_small_blocks(spark, monkeypatch, kind):
    for name, n in (("PART", 64), ("BLOCK", 8), ("CHUNK", 3)):
        monkeypatch.setattr(blocks, name, n)
    pick = np.random.default_rng(3)
    rows = [(k, pick.normal(size=9).round(2 if k % 3 else 0).tolist()) for k in range(500)]
    rows += [(1000 + k, rows[k % 4][1]) for k in range(90)]  # copies: ties go by id
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast(kind))
    queries = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    for k in (1, 10, 700):
        assert same(K.dense_top_k_each(df, queries, k, "id"), every_pair(df, queries, k))


def test_hard_vectors(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 2.0, 3.0]), (6, [2.0, 0.0]), (7, []), (8, [0.0, -3.0]), (9, [None, 1.0]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [1e200, 1e200]), (13, [1e-200, 0.0]), (14, [None, None, None])]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = df.select((F.col("id") + 100).alias("query_id"), "embedding")
    for k in (2, 6, 20):
        assert same(K.dense_top_k_each(df, queries, k, "id"), every_pair(df, queries, k))
    none = df.limit(0)
    assert K.dense_top_k_each(none, queries, 3, "id").count() == K.dense_top_k_each(df, queries.limit(0), 3, "id").count() == 0


def test_any_number_of_queries_without_joined_pairs(spark):
    df = spark.range(10_050).select("id", F.array(F.col("id") % 7 + 1.0, F.lit(1.0)).alias("embedding"))
    out = K.dense_top_k_each(df, df.withColumnRenamed("id", "query_id"), 1, "id")
    assert "NestedLoop" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    assert out.count() == 10_050
