"""Measures that statements can call by name. They are SQL functions: the optimizer puts their bodies into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "text_tokens(t STRING) RETURNS BIGINT": "CASE WHEN t IS NULL THEN NULL ELSE greatest(1L, CAST(floor(length(t) / 4) AS BIGINT)) END",
    "text_words(t STRING) RETURNS ARRAY<STRING>": "array_distinct(regexp_extract_all(lower(t), '[a-z0-9]+', 0))",
    "text_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) = 0 THEN 0D ELSE size(array_intersect(a, b)) / CAST(size(array_union(a, b)) AS DOUBLE) END",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) <> size(b) THEN 0D ELSE coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D) END",
}
TABLE_FUNCTIONS = {
    "text_chunks(t STRING, width INT, step INT) RETURNS TABLE (place INT, chunk STRING)": "SELECT k, substring(t, k * step + 1, width) FROM (SELECT explode(CASE WHEN length(t) > 0 THEN sequence(0, CAST(greatest(0, ceil((length(t) - width) / step)) AS INT)) END) AS k)",
}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS and TABLE_FUNCTIONS known to a session; doing it again changes nothing."""
    for head, body in {**FUNCTIONS, **TABLE_FUNCTIONS}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
