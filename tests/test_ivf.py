"""The inverted file of vectors against comparing with all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ivf


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        if v is None or len(v) == 0 or not any(v):
            continue
        v = np.array(v, float)
        found = []
        for i, u in rows:
            if u is None:
                continue
            u = np.array(u, float)
            fine = len(u) == len(v) and (u != 0).any()
            found.append((-(round(float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)), 9) if fine else 0.0), i))
        out[q] = sorted(found)[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["id"]))
    return out


@pytest.fixture(scope="module")
def clouds():
    pick = np.random.default_rng(11)
    centres = pick.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + 0.3 * pick.normal(size=16)).tolist()) for k in range(3000)]
    return rows + [(5000 + k, rows[k][1]) for k in range(40)]  # repeated vectors


SCHEMA = "id long, embedding array<double>"


def test_recall_and_probed_buckets(spark, clouds, tmp_path):
    df = spark.createDataFrame(clouds, SCHEMA)
    index = ivf.build(df, str(tmp_path / "i"), "id")
    assert sum(index.rows.values()) == index.table(spark).count() == len(clouds)
    queries = df.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = exact(clouds, [(r["query_id"], r["embedding"]) for r in queries.collect()], 10)
    found = got(ivf.search(spark, index, queries, 10))
    hits = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    one = ivf.search(spark, index, queries.limit(1), 5, probes=3)
    assert one.count() == 5
    read = ivf._probes(queries.limit(1).select("query_id", F.col("embedding").alias("vector"), F.lit(None).cast("double").alias("least")), index, 3)
    plan = ivf._scored(spark, index, read, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    cells = {r["cell"] for r in read.collect()}
    assert len(cells) == 3 and sum(index.rows[c] for c in cells) < len(clouds) / 4


def test_exact(spark, clouds, tmp_path):
    df = spark.createDataFrame(clouds, SCHEMA)
    index = ivf.build(df, str(tmp_path / "i"), "id", cells=40)
    queries = df.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = exact(clouds, [(r["query_id"], r["embedding"]) for r in queries.collect()], 7)
    for probes in (1, 4, 100):
        assert got(ivf.search(spark, index, queries, 7, probes=probes, exact=True)) == want


def test_small_parts(spark, clouds, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 16)
    monkeypatch.setattr(ivf, "BLOCK", 2)
    df = spark.createDataFrame(clouds[:500], SCHEMA)
    index = ivf.build(df, str(tmp_path / "i"), "id", cells=3)
    queries = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    assert got(ivf.search(spark, index, queries, 9, probes=1, exact=True)) == exact(clouds[:500], [(r["query_id"], r["embedding"]) for r in queries.collect()], 9)


def test_hard_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 2.0, 3.0]), (6, [2.0, 0.0]), (7, []), (8, [0.0, -3.0])]
    queries = [(10, [1.0, 0.0]), (11, None), (12, [0.0, 0.0]), (13, [-1.0, -1.0])]
    index = ivf.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"), "id")
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    assert got(ivf.search(spark, index, asked, 6, probes=1, exact=True)) == exact(rows, queries, 6)
    assert set(got(ivf.search(spark, index, asked, 2, probes=1))) == {10, 13}


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = ivf.build(none, str(tmp_path / "i"), "id")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert ivf.search(spark, index, asked, 3, exact=True).count() == 0


def test_text_ids(spark, tmp_path):
    rows = [(f"v{k}", [float(k % 5), 1.0]) for k in range(20)]
    df = spark.createDataFrame(rows, "name string, v array<float>")
    index = ivf.build(df, str(tmp_path / "i"), "name", "v", cells=3)
    found = ivf.search(spark, index, df.filter("name = 'v3'"), 4, "name", "v", exact=True).orderBy("rank").collect()
    assert [r["id"] for r in found] == ["v13", "v18", "v3", "v8"]
