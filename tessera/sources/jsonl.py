"""Line-wise JSON logs: telemetry with prefixes, metrics, failures, traces and question banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT = "query_id string, stage string, timestamp string, input_tokens string, output_tokens string, latency_ms string, success boolean, failure_type string, provider string, model string, extra struct<rows_returned:bigint,empty_result:boolean>"


def parse_events(lines: DataFrame) -> DataFrame:
    """Telemetry events of (value) lines: JSON, alone or behind a log prefix; lines without an object are left out.

    Missing names become 'unknown', missing or unreadable numbers 0, and a missing outcome a success."""
    body = lines.select(F.regexp_extract("value", r"(?s)(\{.*\})", 1).alias("body")).filter("body <> ''")
    # a body that isn't an object gives nulls only, and to_json of it is an empty object
    e = body.withColumn("e", F.from_json("body", EVENT)).filter(F.expr("try_parse_json(body) is not null"))
    number = lambda c, kind: F.coalesce(F.expr(f"try_cast(e.{c} as {kind})"), F.lit(0)).cast(kind)
    return e.select(
        F.trim(F.coalesce(F.nullif("e.query_id", F.lit("")), F.lit("unknown_query"))).alias("query_id"),
        F.coalesce("e.stage", F.lit("unknown")).alias("stage"),
        F.col("e.timestamp").alias("timestamp"),
        number("input_tokens", "long").alias("input_tokens"),
        number("output_tokens", "long").alias("output_tokens"),
        number("latency_ms", "double").alias("latency_ms"),
        F.coalesce("e.success", F.lit(True)).alias("success"),
        F.col("e.failure_type").alias("failure_type"),
        F.when(F.coalesce("e.extra.empty_result", F.lit(False)), 0).otherwise(F.col("e.extra.rows_returned")).alias("rows_returned"),
        F.col("e.provider").alias("provider"),
        F.col("e.model").alias("model"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file with a known schema; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def questions_of_markdown(lines: DataFrame) -> DataFrame:
    """(number, question) of the numbered list items of (value) lines."""
    got = lines.select(F.regexp_extract("value", r"^\s*(\d+)[.)]\s+(.*\S)\s*$", 1).alias("n"), F.regexp_extract("value", r"^\s*(\d+)[.)]\s+(.*\S)\s*$", 2).alias("question"))
    return got.filter("n <> ''").select(F.col("n").cast("int").alias("number"), F.regexp_replace("question", r"[*`]", "").alias("question"))
