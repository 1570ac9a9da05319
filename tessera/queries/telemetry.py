"""Telemetry analytics on ``events`` as stand-in: a user is a query, event types are stages, ``value`` is a latency."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import analytics as A
from .registry import Registry

R = Registry()

# What each event type stands for.
STAGE = "CASE event_type WHEN 'click' THEN 'sql_execution' WHEN 'view' THEN 'sql_generation' WHEN 'purchase' THEN 'final_response' WHEN 'signup' THEN 'sql_repair' ELSE 'synthesis_bypassed' END"
FAILURE = "CASE WHEN event_id % 97 = 0 THEN 'rate_limit_error' WHEN event_id % 89 = 0 THEN 'timeout_error' END"
QUERY = "user_id || '/' || event_id % 20"


def as_telemetry(events):
    """Telemetry events: every twentieth event of a user is one query's."""
    seq = F.col("event_id")
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), (seq % 20).cast("string")).alias("query_id"), seq.alias("seq"), F.expr(STAGE).alias("stage"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), (seq % 50).alias("output_tokens"), F.col("value").alias("latency_ms"),
        (seq % 89 != 0).alias("success"), F.expr(FAILURE).alias("failure_type"), F.when(seq % 13 == 0, 0).otherwise(5).alias("rows_returned"),
    )


T_SQL = f"""t AS (SELECT {QUERY} AS query_id, event_id AS seq, {STAGE} AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, event_id % 50 AS output_tokens, value AS latency_ms,
event_id % 89 <> 0 AS success, {FAILURE} AS failure_type, CASE WHEN event_id % 13 = 0 THEN 0 ELSE 5 END AS rows_returned FROM events)"""
Q_SQL = f"""{T_SQL},
q AS (SELECT query_id, CAST(sum(CASE WHEN stage IN ('sql_generation', 'synthesis', 'llm_call', 'sql_repair', 'intent_extraction') THEN input_tokens + output_tokens ELSE 0 END) AS BIGINT) AS tokens,
CAST(count(*) FILTER (stage IN ('sql_generation', 'sql_repair')) AS BIGINT) AS model_calls, bool_or(NOT success OR failure_type IS NOT NULL) AS failed,
coalesce(min_by(failure_type, seq) FILTER (stage = 'final_response' AND NOT success), min_by(failure_type, seq) FILTER (failure_type IS NOT NULL)) AS failure_type,
coalesce(min_by(latency_ms, seq) FILTER (stage = 'final_response'), sum(latency_ms)) AS latency_ms,
bool_or(stage = 'sql_execution' AND (rows_returned = 0 OR coalesce(failure_type = 'empty_result', FALSE))) AS empty_result,
CAST(count(*) FILTER (stage = 'sql_repair') AS BIGINT) AS repairs, CAST(count(*) FILTER (stage = 'sql_repair' AND success) AS BIGINT) AS repairs_ok, CAST(count(*) FILTER (stage = 'synthesis_bypassed') AS BIGINT) AS bypasses FROM t GROUP BY 1)"""


@R.add(f"WITH {Q_SQL} SELECT query_id, tokens, model_calls, failed, failure_type, round(latency_ms, 4) AS latency_ms, empty_result, repairs, repairs_ok, bypasses FROM q", "events")
def telemetry_rollup(events):
    return A.per_query(as_telemetry(events)).withColumn("latency_ms", F.round("latency_ms", 4))


@R.add(f"""WITH {Q_SQL} SELECT count(*) AS total_queries, count(*) FILTER (NOT failed) AS successful, round(count(*) FILTER (NOT failed) * 100.0 / count(*), 2) AS success_rate, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(avg(tokens), 2) AS avg_tokens,
round(quantile_cont(tokens, 0.5), 2) AS median_tokens, round(quantile_cont(tokens, 0.95), 2) AS p95_tokens, round(avg(latency_ms), 2) AS avg_latency_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms, count(*) FILTER (empty_result) AS empty_results,
round(sum(repairs_ok) * 100.0 / sum(repairs), 2) AS repair_success_rate, round(sum(bypasses) * 100.0 / count(*), 2) AS fast_path_rate, max(model_calls) AS max_model_calls FROM q""", "events")
def telemetry_baseline(events):
    return A.baseline(A.per_query(as_telemetry(events)))


@R.add(f"WITH {Q_SQL}, f AS (SELECT coalesce(failure_type, 'unknown_error') AS failure_type, count(*) AS n FROM q WHERE failed GROUP BY 1) SELECT failure_type, n, round(n * 100.0 / sum(n) OVER (), 2) AS share FROM f", "events")
def failure_distribution(events):
    return A.failure_distribution(A.per_query(as_telemetry(events)))


@R.add("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(avg(value), 4) AS mean FROM events GROUP BY 1", "events")
def percentile_linear(events):
    found = A.percentiles_linear(events, "value", ["event_type"], p50=0.5, p95=0.95)
    return found.select("event_type", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "mean")])


@R.add("SELECT event_type, value AS percentile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = floor(n * 0.95)", "events")
def percentile_nearest(events):
    return A.percentile_nearest(events, "value", 0.95, ["event_type"])


@R.add("""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase'),
g AS (SELECT user_id, max(n) AS n, max(value) AS top, max(value) FILTER (r = least(greatest(floor((n + 1) * 0.95), 1), n - 1)) AS a, max(value) FILTER (r = least(greatest(floor((n + 1) * 0.95), 1), n - 1) + 1) AS b FROM s GROUP BY 1)
SELECT user_id, round(CASE WHEN n < 21 THEN top ELSE a + (b - a) * ((n + 1) * 0.95 - least(greatest(floor((n + 1) * 0.95), 1), n - 1)) END, 4) AS percentile FROM g""", "events")
def percentile_exclusive(events):
    return A.percentile_exclusive(events.filter("event_type = 'purchase'"), "value", 0.95, ["user_id"]).withColumn("percentile", F.round("percentile", 4))


@R.add("""SELECT source AS guard, count(*) FILTER (toxic = 1 AND n_chars > 600) AS tp, count(*) FILTER (toxic = 0 AND n_chars > 600) AS fp, count(*) FILTER (toxic = 0 AND n_chars <= 600) AS tn, count(*) FILTER (toxic = 1 AND n_chars <= 600) AS fn, round(avg(n_chars / 8.0), 3) AS avg_latency_ms,
CASE WHEN count(*) FILTER (toxic = 0) > 0 THEN round(count(*) FILTER (toxic = 0 AND n_chars > 600) * 100.0 / count(*) FILTER (toxic = 0), 2) ELSE 0.0 END AS fpr,
CASE WHEN CASE WHEN count(*) FILTER (toxic = 0) > 0 THEN round(count(*) FILTER (toxic = 0 AND n_chars > 600) * 100.0 / count(*) FILTER (toxic = 0), 2) ELSE 0.0 END < 2.5 THEN 'SAFE_TO_ENFORCE' ELSE 'REMAIN_IN_SHADOW' END AS advice
FROM labels JOIN documents USING (doc_id) GROUP BY 1""", "labels", "documents")
def guard_confusion_matrix(labels, documents):
    """A length rule against labels stands for a guard's verdict against the truth."""
    df = labels.join(documents.select("doc_id", "source", "n_chars"), "doc_id").withColumnRenamed("source", "guard")
    return A.confusion(df, "guard", F.col("n_chars") > 600, F.col("toxic") == 1, F.col("n_chars") / 8.0)


@R.add("""WITH v AS (SELECT CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'treatment_a' ELSE 'treatment_b' END AS variant, count(*) AS n, count(*) FILTER (value > 20) AS wins, round(avg(value), 3) AS latency FROM events GROUP BY 1),
z AS (SELECT v.*, CAST(v.wins AS DOUBLE) / v.n AS p, CAST(c.wins AS DOUBLE) / c.n AS p0, c.n AS n0 FROM v, (SELECT * FROM v WHERE variant = 'control') c),
y AS (SELECT *, (p0 * n0 + p * n) / (n0 + n) AS q FROM z), x AS (SELECT *, CASE WHEN variant <> 'control' AND q * (1 - q) > 0 THEN (p - p0) / sqrt(q * (1 - q) * (1.0 / n0 + 1.0 / n)) END AS zz FROM y)
SELECT variant, n, wins, round(p, 4) AS rate, latency, round(zz, 4) AS z, round(2 * (1 - least(0.9999, abs(zz) / 3.5)), 4) AS p_rough FROM x""", "events")
def ab_test(events):
    variant = F.when(F.col("user_id") % 3 == 0, "control").when(F.col("user_id") % 3 == 1, "treatment_a").otherwise("treatment_b")
    return A.ab_test(events.withColumn("variant", variant), "variant", F.col("value") > 20, "control", latency=F.col("value")).drop("p_normal", "significant")


@R.add("""SELECT event_id, count(*) OVER w AS recent, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER w AS BIGINT) AS recent_tokens FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW)""", "events")
def rolling_60s(events):
    """Requests and tokens of the minute up to each event, per stage."""
    out = A.rolling(events, "event_type", "ts", 60, F.get_json_object("props", "$.k").cast("long"))
    return out.select("event_id", "recent", F.col("recent_sum").alias("recent_tokens"))


@R.add("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, greatest(0, 500 - count(*)) AS remaining FROM events GROUP BY ALL", "events")
def provider_usage(events):
    """Daily totals and what is left of a quota."""
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"), F.greatest(F.lit(0), 500 - F.count("*")).alias("remaining"))


@R.add("""WITH c AS (SELECT event_id, user_id, ts, value > 30 AS bad FROM events), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
s AS (SELECT event_id, user_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i)
SELECT event_id, user_id, streak, streak = 3 AS trips FROM s WHERE streak > 0""", "events")
def breaker_islands(events):
    """Consecutive failures of each provider, and the calls that open its breaker."""
    out = A.breaker(events, "user_id", ["ts", "event_id"], F.col("value") > 30)
    return out.select("event_id", "user_id", "streak", "trips").filter("streak > 0")


@R.add("""SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 30 THEN -2 WHEN value > 10 THEN 0 ELSE 1 END) AS BIGINT) AS score, count(*) FILTER (value <= 10) AS catches, count(*) FILTER (value > 30) AS blunders FROM events GROUP BY 1""", "events")
def score_summary(events):
    return A.score_summary(events.withColumn("score_delta", F.when(F.col("value") > 30, -2).when(F.col("value") > 10, 0).otherwise(1)))


@R.add("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50", "events")
def recent_events(events):
    return A.last_rows(events, 50, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


TRACES = """tr AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'FALLBACK' WHEN conv_id % 11 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status, CAST(conv_id % 3 AS BIGINT) AS retry_count, conv_id % 2 = 0 AS retry_improved FROM (SELECT DISTINCT conv_id FROM conversations))"""


def _traces(conversations):
    """Traces from conversations: turns are spans, each with one guard."""
    k = F.col("conv_id")
    guard = F.struct(F.concat(F.lit("guard_"), F.col("role")).alias("guard_name"), (F.length("text") % 4 != 0).alias("passed"), F.when(F.col("turn") % 2 == 0, "ENFORCED").otherwise("SHADOW").alias("mode"))
    span = F.struct(F.col("role").alias("name"), F.when(F.col("turn") % 5 == 3, "ERROR").otherwise("OK").alias("status"), F.when(F.col("turn") % 5 == 3, "timeout").alias("failure_category"), F.array(guard).alias("guard_results"))
    t = conversations.groupBy("conv_id").agg(F.collect_list(span).alias("spans"))
    return t.withColumns({"status": F.when(k % 7 == 0, "FALLBACK").when(k % 11 == 0, "ERROR").otherwise("SUCCESS"), "retry_count": (k % 3).cast("long"), "retry_improved": k % 2 == 0})


@R.add(f"""WITH {TRACES} SELECT count(*) AS total, round(count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*), 1) AS success_rate, round(count(*) FILTER (status = 'FALLBACK') * 100.0 / count(*), 1) AS fallback_rate,
round(count(*) FILTER (retry_count > 0 AND retry_improved) * 100.0 / sum(retry_count), 1) AS recovery_rate FROM tr""", "conversations")
def trace_overview(conversations):
    return A.overview(_traces(conversations))


@R.add("SELECT role AS stage, 'timeout' AS category, count(*) AS n FROM conversations WHERE turn % 5 = 3 GROUP BY 1", "conversations")
def span_failures(conversations):
    return A.span_failures(_traces(conversations))


@R.add("""SELECT 'guard_' || role AS guard, count(*) AS checks, count(*) FILTER (length(text) % 4 = 0 AND turn % 2 <> 0) AS shadow_blocks, count(*) FILTER (length(text) % 4 = 0 AND turn % 2 = 0) AS enforced_blocks,
round(count(*) FILTER (length(text) % 4 = 0) * 100.0 / count(*), 2) AS block_rate FROM conversations GROUP BY 1""", "conversations")
def guard_blocks(conversations):
    return A.guard_stats(_traces(conversations))


@R.add("""SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, max_by(event_type, event_id) FILTER (event_type <> 'view') AS last_provider FROM events GROUP BY 1""", "events")
def token_usage(events):
    """Tokens so far and the last provider that is named."""
    return events.groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"), F.max_by("event_type", F.when(F.col("event_type") != "view", F.col("event_id"))).alias("last_provider"))


@R.add("""SELECT o_orderkey, round(greatest(0, least(1, (CASE WHEN o_orderkey % 6 > 0 THEN least(1.0, 0.85 + (o_orderkey % 6) / 5.0 * 0.15) ELSE 0.85 END) * 0.30 + greatest(0, least(1, 1 - (o_orderkey % 2) * 0.3 - (o_orderkey % 4) * 0.1)) * 0.40
+ (CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE greatest(0.1, 1 - (o_orderkey % 3) / 3.0) END) * 0.20 + greatest(0, 1 - (CASE WHEN o_orderkey % 8 > 5 THEN 0.1 ELSE 0 END) - (CASE WHEN o_orderkey % 5 > 2 THEN 0.15 ELSE 0 END) - (CASE WHEN o_orderkey % 10 = 0 THEN 0.3 ELSE 0 END)) * 0.10)), 6) AS confidence FROM orders""", "orders")
def confidence_score(orders):
    k = F.col("o_orderkey")
    raw = A.confidence(k % 6, F.lit(5.0), k % 2, k % 4, k % 3, 3, k % 8, k % 5, k % 10 == 0, digits=6)
    return orders.select("o_orderkey", raw.alias("confidence"))


@R.add("""WITH d AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) SELECT 'clicks' AS metric, CAST(sum(a) AS DOUBLE) AS baseline, CAST(sum(b) AS DOUBLE) AS optimised, round((sum(b) - sum(a)) * 100.0 / sum(a), 1) AS change, sum(b) >= sum(a) AS better FROM d""", "events")
def metric_comparison(events):
    one = events.filter("event_type = 'click'").agg(F.count("*").alias("clicks"))
    two = events.filter("event_type = 'view'").agg(F.count("*").alias("clicks"))
    return A.compare(one, two, {"clicks": True})


@R.add("SELECT round(avg(v), 4) AS average, max(abs(v - a)) > 10 * abs(any_value(a)) AS has_outlier FROM (SELECT v, avg(v) OVER () AS a FROM (SELECT s_acctbal AS v FROM supplier ORDER BY s_suppkey LIMIT 100))", "supplier")
def result_outliers(supplier):
    return A.outliers(supplier, ["s_acctbal"], ["s_suppkey"]).withColumn("average", F.round("average", 4))
