"""What joins send to every task: fixed tables, never the rows that questions are cut into."""

import pytest

from tessera import session as S
from tessera.operators import catalog as C, ranking as K

ASKED = [(f"q{k}", "Total revenue by client of sales orders, how many buyers " * (k + 1)) for k in range(5)]


def _glossary(spark, questions):
    return C.match_glossary(questions, spark.createDataFrame([("revenue", ["turnover"]), ("customer", ["client", "buyer"])], "concept string, synonyms array<string>"))


def _patterns(spark, questions):
    return K.match_patterns(questions, spark.createDataFrame([("p1", ["total revenue", "revenue by"], 0.9), ("p2", ["how many"], 1.0)], "pattern_id string, trigger_phrases array<string>, quality double"))


@pytest.mark.parametrize("match", [_glossary, _patterns])
def test_fixed_side_is_sent(spark, tmp_path, monkeypatch, match):
    spark.createDataFrame(ASKED, "question_id string, question string").write.parquet(str(tmp_path / "q"))
    questions = spark.read.parquet(str(tmp_path / "q"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = match(spark, questions)
    assert "BuildRight" in plan(few) and "BuildLeft" not in plan(few)
    monkeypatch.setattr(S, "SMALL", 1)
    many = match(spark, questions)
    assert "Broadcast" not in plan(many)
    rows = sorted(map(tuple, few.collect()))
    assert rows and rows == sorted(map(tuple, many.collect()))
