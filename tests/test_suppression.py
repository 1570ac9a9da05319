"""Suppression of near repeats in lists of any length against the greedy rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup as D

SCHEMA = "q string, id string, text string, place long"


def greedy(rows, threshold=0.9, least=12):
    kept, out = {}, set()
    for q, ident, text, _ in sorted(rows, key=lambda r: (r[3], r[1])):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        t, f = set(words), " ".join(words)
        own = kept.setdefault(q, [])
        if any(f == g for g, _ in own) or len(t) >= least and any(u and len(t & u) / len(t | u) >= threshold for _, u in own):
            continue
        own.append((f, t))
        out.add((q, ident))
    return out


def passages(n, seed, families):
    pick = random.Random(seed)
    base = [[f"w{pick.randrange(400)}" for _ in range(pick.choice([5, 11, 12, 30, 60]))] for _ in range(families)]
    rows = []
    for k in range(n):
        words = list(pick.choice(base))
        for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
            words[pick.randrange(len(words))] = f"x{pick.randrange(50)}"
        rows.append((f"q{k % 3}" if families < 90 else "q", f"r{k:05d}", " ".join(words).upper() if k % 7 == 0 else ", ".join(words), k * 7919 % 10_007))
    return rows


@pytest.mark.parametrize(("n", "families"), [(308, 40), (5000, 700)])
@pytest.mark.parametrize("threshold", [0.9, 0.7])
def test_equals_the_rule(spark, n, families, threshold):
    rows = passages(n, n, families)
    df = spark.createDataFrame(rows, SCHEMA)
    want = greedy(rows, threshold)
    assert len(want) < n
    assert {tuple(r) for r in D.suppress(df, "q", "id", "text", "place", threshold).collect()} == want
    if n < 1000:
        lists = df.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("o"), "id", "text"))).alias("items"))
        assert {tuple(r) for r in lists.select("q", F.explode(D.near_duplicates(F.col("items"), threshold))).collect()} == want


def test_chain(spark):
    words = [f"c{k}" for k in range(140)]
    rows = [("q", f"r{k:03d}", " ".join(words[k : k + 60]), k) for k in range(40)]  # each repeats its neighbours
    assert {tuple(r) for r in D.suppress(spark.createDataFrame(rows, SCHEMA), "q", "id", "text", "place").collect()} == greedy(rows)


def test_hard(spark):
    long = " ".join(f"t{k}" for k in range(20_000))
    rows = [(None, "a", None, 1), (None, "b", "", 2), ("q", "c", "!!", 3), ("q", "d", None, 3), ("q", "e", long, 4), ("q", "f", long + " more", 5), (None, "g", long, None), ("q", "h", "one two", 0), ("q", "i", "Two one", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).withColumn("t", F.lit(1))
    assert {tuple(r) for r in D.suppress(df, "q", "id", "text", "place").collect()} == {(None, "a"), ("q", "c"), ("q", "e"), (None, "g"), ("q", "h"), ("q", "i")}
    assert {r["id"] for r in D.suppress(df, "q", "id", "text", "place", 1.5).collect()} == {"a", "c", "e", "f", "g", "h", "i"}
    assert D.suppress(df.limit(0), "q", "id", "text", "place").count() == 0
    with pytest.raises(ValueError):
        D.suppress(df, "q", "id", "text", "place", 0.0)
