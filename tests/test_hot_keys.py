"""Percentiles, rolling windows and breakers by parts of a group, against plain versions over whole groups."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from tessera.operators import analytics as A

INF = float("inf")


@pytest.mark.parametrize("case", ["spread", "skewed", "ends", "same"])
def test_percentiles_equal_sorted_lists(spark, case):
    rng = random.Random(7)
    make = {"spread": lambda: rng.uniform(-5, 5), "skewed": lambda: rng.choice([0.0, 1e-9, 2e-9, 1e12]) * rng.random(), "ends": lambda: rng.choice([-INF, INF, 1.0, 2.0, 3.5, -7.0]), "same": lambda: 4.0}[case]
    rows = [(g, make()) for g in ("hot",) * 400 + ("cold",) * 9 + (None,) * 30 + ("one",)] + [("hot", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    ranks = {(r["g"], r["v"]): (r["c"], r["upto"], r["n"]) for r in A.ranked(df, "v", ["g"]).collect()}
    assert ranks == {(g, v): (vs.count(v), sum(x <= v for x in vs), len(vs)) for g, vs in groups.items() for v in set(vs)}
    near = {r["g"]: r["percentile"] for r in A.percentile_nearest(df, "v", 0.95, ["g"]).collect()}
    assert near == {g: sorted(vs)[math.floor(len(vs) * 0.95)] for g, vs in groups.items()}
    found = {r["g"]: r for r in A.percentiles_linear(df, "v", ["g"], p50=0.5, p95=0.95).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(A.percentile_linear("v", 0.5).alias("p50"), A.percentile_linear("v", 0.95).alias("p95")).collect()}
    assert set(found) == set(want) and found["void"]["p50"] is None
    if case != "ends":
        assert all(found[g][p] == want[g][p] for g in want for p in ("p50", "p95"))
    whole = A.percentile_nearest(df, "v", 0.5, []).first()["percentile"]
    assert whole == sorted(v for _, v in rows if v is not None)[sum(v is not None for _, v in rows) // 2]


def test_nan_is_the_greatest(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(8)] + [("a", float("nan"))] * 2 + [("b", float("nan"))], "g string, v double")
    got = {r["g"]: r["percentile"] for r in A.percentile_nearest(df, "v", 0.7, ["g"]).collect()}
    assert got["a"] == 7.0 and math.isnan(got["b"])
    assert A.ranked(df.limit(0), "v", ["g"]).count() == 0


@pytest.fixture(scope="module")
def calls(spark):
    rng, start, rows = random.Random(11), datetime(2024, 1, 1), []
    for key, n in (("hot", 900), ("cold", 7), (None, 40)):
        at = start
        for k in range(n):
            at += timedelta(microseconds=rng.choice([0, 1, 999_999, 30_000_000, 59_999_999, 60_000_000, 7_200_000_000]))
            rows.append((len(rows), key, None if k % 97 == 5 else at, rng.choice([1, 2, None]), rng.random() < 0.85, "mine"))
    return spark.createDataFrame(rows, "id int, key string, ts timestamp, v int, bad boolean, slot string").repartition(5)


def test_rolling_equals_one_window_per_key(calls):
    w = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-59_999_999, 0)
    want = calls.withColumns({"recent": F.count("*").over(w), "recent_sum": F.sum("v").over(w)})
    got = A.rolling(calls, "key", "ts", 60, F.col("v"))
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(want.collect(), key=lambda r: r["id"])
    assert A.rolling(calls.limit(0), "key", "ts", 60, F.col("v")).count() == 0
    again = A.rolling(got, "key", "ts", 60, F.col("v"))
    assert again.columns == got.columns and again.count() == got.count()


@pytest.mark.parametrize("slot", [None, "date_trunc('minute', ts)", "1"])
def test_breaker_equals_one_scan_per_key(calls, slot):
    """Streaks within a slot, over many of them, and with all calls in one."""
    rows = sorted(calls.collect(), key=lambda r: (r["ts"] is not None, r["ts"] or datetime.min, r["id"]))
    want, run = {}, defaultdict(int)
    for r in rows:
        run[r["key"]] = run[r["key"]] + 1 if r["bad"] else 0
        want[r["id"]] = (run[r["key"]], run[r["key"]] == 3)
    got = A.breaker(calls, "key", ["ts", "id"], F.col("bad"), slot=slot and F.expr(slot))
    assert got.columns == [*calls.columns, "streak", "trips"]
    assert {r["id"]: (r["streak"], r["trips"]) for r in got.collect()} == want
    assert A.breaker(calls.limit(0), "key", ["ts", "id"], F.col("bad")).count() == 0


def test_links_are_borne_out_by_rows(spark):
    from tessera.operators import keys

    a = spark.createDataFrame([(1,), (2,), (3,)], "a_itemkey long")
    b = spark.createDataFrame([(1, 9), (1, 8), (3, 7), (None, 6)], "b_itemkey int, b_otherkey int")
    c = spark.createDataFrame([(1, 5), (4, 4)], "c_itemkey long, c_otherkey long")
    empty = spark.createDataFrame([], "d_itemkey long")
    got = sorted(map(tuple, keys.discover({"a": a, "b": b, "c": c, "d": empty}).collect()))
    assert got == [("b", "b_itemkey", "a", "a_itemkey", 2)]
    assert keys.discover({"a": a}).count() == 0 and keys.discover({"a": a.limit(0), "d": empty}).count() == 0
    hot = spark.range(50_000).selectExpr("if(id % 3 = 0, 1L, 1L + id % 3) as b_itemkey")
    assert sorted(map(tuple, keys.discover({"a": a, "b": hot}).collect())) == [("b", "b_itemkey", "a", "a_itemkey", 3)]


def test_names_suggest_links(spark):
    from tessera.operators import catalog as C

    cols = spark.createDataFrame([("sale", "id"), ("sale", "party_id"), ("sale", "financial_id"), ("sale", "ghost_id"), ("party", "id"), ("financial_year", "id")], "`table` string, `column` string")
    aliases = spark.createDataFrame([("financial", "financial_year")], "prefix string, `table` string")
    assert sorted(map(tuple, C.infer_keys(cols, aliases).collect())) == [("sale", "financial_id", "financial_year", "id"), ("sale", "party_id", "party", "id")]
