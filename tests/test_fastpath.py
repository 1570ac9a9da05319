"""Answers by template: what allows them, what they say, and when they are switched off."""

from pyspark.sql import functions as F

from tessera.operators import evaluation as E, fastpath as P


def test_questions_of_fact(spark):
    asked = [("How many customers had issues due to the billing policy?", False), ("Why did total production drop compared to last month?", False), ("How many delivery challans are there?", True), ("sales north vs south", False), ("", False), (None, False), ("canvas total", True)]
    got = spark.createDataFrame(asked, "q string, fact boolean").select("q", P.factual("q")).collect()
    assert list(map(tuple, got)) == asked


def test_sentences(spark):
    rows = [("How many delivery challans are there?", "COUNT", 1500.0), ("What is the total invoice amount for customer?", "SUM", 52450.75), ("count", "COUNT", 2.0), ("sum", "SUM", 3.0), ("List all", "LIST", 1.0), ("How many orders?", "COUNT", None), (None, "COUNT", 4.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, kind string, v double").select(P.sentence("q", F.col("kind"), F.col("v"))).collect()]
    assert got == ["There are 1,500 delivery challans.", "The total invoice amount is 52,450.75.", "There are 2 records.", "The total amount is 3.", None, None, "There are 4 records."]


def _attempts(outcomes):
    """(kind, k, failed): half an hour apart, in order of k."""
    return [(kind, k, bad) for kind, bads in outcomes.items() for k, bad in enumerate(bads)]


def test_trips_are_those_of_a_counter(spark):
    ok = [False]
    outcomes = {"calm": ok * 400, "early": [True] + ok * 60, "late": ok * 120 + [True] + ok * 5 + [True] + ok * 80, "rare": ok * 150 + [True] + ok * 200, "short": [True] * 49, "null": [None] + ok * 70}
    expected = set()
    for kind, bads in outcomes.items():
        failures = 0
        for n, bad in enumerate(bads, 1):
            failures += bad is not False
            if n >= 50 and failures / n >= 0.01:
                expected.add((kind, n - 1))
                break
    rows = spark.createDataFrame(_attempts(outcomes), "kind string, k long, bad boolean").withColumn("ts", F.timestamp_seconds(F.col("k") * 1800))
    got = {(r["kind"], r["tripped_order"]) for r in P.tripped(rows, "kind", "ts", "k", F.col("bad")).collect()}
    assert got == expected and {kind for kind, _ in got} == {"early", "late", "null"}
    assert P.tripped(rows.limit(0), "kind", "ts", "k", F.col("bad")).count() == 0
    # all in one moment, and without a time: the order alone decides
    for ts in ("timestamp'2024-01-01'", "cast(null as timestamp)"):
        same = rows.withColumn("ts", F.expr(ts))
        assert {(r["kind"], r["tripped_order"]) for r in P.tripped(same, "kind", "ts", "k", F.col("bad")).collect()} == expected


def test_answers_stop_after_the_trip(spark):
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("How many orders?").alias("question"), F.when(F.col("id") < 90, "COUNT").otherwise("LIST").alias("kind"), F.when(F.col("id") != 10, F.lit(5.0)).alias("value"))
    got = {r["id"]: r["answer"] for r in P.answers(rows, "kind", "ts", "id", "question", "value").collect()}
    assert len(got) == 100 and got[0] == "There are 5 orders." and got[10] is None
    assert got[49] == "There are 5 orders." and all(got[k] is None for k in range(50, 100))
    off = P.answers(rows, "kind", "ts", "id", "question", "value", disabled=["COUNT"])
    assert off.filter("answer is not null").count() == 0 and off.columns == [*rows.columns, "answer"]


def test_summary_of_a_run(spark):
    rows = [("q1", 1.0, "sql", "sql", True, "easy"), ("q2", 0.0, "sql", "rag", False, "hard"), ("q3", None, None, "rag", None, None), ("q4", 0.5, "rag", "rag", True, "hard")]
    run = spark.createDataFrame(rows, "id string, score double, expected string, observed string, twist boolean, level string")
    args = ("id", "score", "expected", "observed", "twist", "level")
    got = sorted(map(tuple, E.summary(run, *args, worst=2).collect()), key=str)
    assert got == sorted([("score", None, 0.375, 4), ("routing", None, 0.5, 4), ("twists", None, 0.5, 4), ("difficulty", "easy", 1.0, 1), ("difficulty", "hard", 0.25, 2), ("difficulty", "unknown", 0.0, 1), ("worst", "q2", 0.0, 1), ("worst", "q3", 0.0, 1)], key=str)
    assert E.summary(run.limit(0), *args).count() == 0
