"""Telemetry and evaluation analytics: rollups, percentiles, experiments, guards, breakers and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Stages that call a language model.
MODEL_STAGES = ["sql_generation", "synthesis", "llm_call", "sql_repair", "intent_extraction"]


def per_query(events: DataFrame) -> DataFrame:
    """One row per query_id of events (query_id, seq, stage, input_tokens, output_tokens, latency_ms, success, failure_type, rows_returned).

    A query failed if any event failed, even where the last one succeeded; its latency is that of its
    ``final_response``, else the sum over its stages."""
    model = F.col("stage").isin(MODEL_STAGES)
    final = F.col("stage") == "final_response"
    bad = ~F.coalesce("success", F.lit(True)) | F.col("failure_type").isNotNull()
    last = F.min_by("failure_type", F.when(final & ~F.coalesce("success", F.lit(True)), F.col("seq")))
    first = F.min_by("failure_type", F.when(F.col("failure_type").isNotNull(), F.col("seq")))
    return events.groupBy("query_id").agg(
        F.sum(F.when(model, F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).otherwise(0)).cast("long").alias("tokens"),
        F.count_if(model).alias("model_calls"),
        (F.count_if(bad) > 0).alias("failed"),
        F.coalesce(last, first).alias("failure_type"),
        F.coalesce(F.min_by("latency_ms", F.when(final, F.col("seq"))), F.sum(F.coalesce("latency_ms", F.lit(0.0)))).alias("latency_ms"),
        (F.count_if((F.col("stage") == "sql_execution") & (F.coalesce(F.col("rows_returned") == 0, F.lit(False)) | F.coalesce(F.col("failure_type") == "empty_result", F.lit(False)))) > 0).alias("empty_result"),
        F.count_if(F.col("stage") == "sql_repair").alias("repairs"),
        F.count_if((F.col("stage") == "sql_repair") & F.coalesce("success", F.lit(True))).alias("repairs_ok"),
        F.count_if(F.col("stage") == "synthesis_bypassed").alias("bypasses"),
    )


def percent(part: Column, whole: Column, digits: int = 2, empty: float = 0.0) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(empty)


def baseline(queries: DataFrame) -> DataFrame:
    """One row of totals over ``per_query`` rows."""
    n = F.count("*")
    return queries.agg(
        n.alias("total_queries"),
        F.count_if(~F.col("failed")).alias("successful"),
        percent(F.count_if(~F.col("failed")), n).alias("success_rate"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.avg("tokens"), F.lit(0.0)), 2).alias("avg_tokens"),
        F.round(F.coalesce(F.percentile("tokens", 0.5), F.lit(0.0)), 2).alias("median_tokens"),
        F.round(F.coalesce(F.percentile("tokens", 0.95), F.lit(0.0)), 2).alias("p95_tokens"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("avg_latency_ms"),
        F.round(F.coalesce(F.percentile("latency_ms", 0.95), F.lit(0.0)), 2).alias("p95_latency_ms"),
        F.count_if("empty_result").alias("empty_results"),
        percent(F.sum("repairs_ok"), F.sum("repairs")).alias("repair_success_rate"),
        percent(F.sum("bypasses"), n).alias("fast_path_rate"),
        F.coalesce(F.max("model_calls"), F.lit(0)).alias("max_model_calls"),
    )


def failure_distribution(queries: DataFrame) -> DataFrame:
    """(failure_type, n, share of failures in percent)."""
    counts = queries.filter("failed").groupBy(F.coalesce("failure_type", F.lit("unknown_error")).alias("failure_type")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("failure_type", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("share"))


def percentile_linear(value: Column | str, p: float) -> Column:
    """Between the two neighbours of the rank (n - 1) p."""
    return F.percentile(value, p)


def ranked(df: DataFrame, value: str, by: list[str], bins: int = 1024) -> DataFrame:
    """(by, value, c, upto, n): each distinct number with how often it occurs, how many are no greater, and how many there are.

    A group isn't sorted as a whole. Its range is cut into ``bins`` equal parts; counts are summed within parts by
    windows, and over parts by a window over their sums, which is joined back. Infinite ends put all between them
    into one part; NaN is the greatest value. Nulls are left out."""
    at = F.col("at__")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c")).withColumn("at__", F.col(value).cast("double"))
    number = F.when(~F.isnan(at), at)
    ends = counts.groupBy(*by).agg(F.min(number).alias("lo__"), F.max(number).alias("hi__"))
    place = F.floor((at - F.col("lo__")) / (F.col("hi__") - F.col("lo__")) * bins)
    place = F.when(F.isnan(at), bins + 1).when(at >= F.col("hi__"), bins).when(at <= F.col("lo__"), 0).otherwise(F.coalesce(F.greatest(F.least(place, F.lit(bins)), F.lit(0)), F.lit(0)))
    parts = _beside(counts, ends, by).withColumn("part__", place.cast("int")).drop("at__", "lo__", "hi__")
    sums = parts.groupBy(*by, "part__").agg(F.sum("c").alias("in__"))
    before = F.sum("in__").over(Window.partitionBy(*by).orderBy("part__")) - F.col("in__")
    sums = sums.withColumns({"before__": before, "n": F.sum("in__").over(Window.partitionBy(*by))}).drop("in__")
    inside = F.sum("c").over(Window.partitionBy(*by, "part__").orderBy(value))
    return _beside(parts.withColumn("inside__", inside), sums, [*by, "part__"]).withColumn("upto", F.col("before__") + F.col("inside__")).drop("part__", "before__", "inside__")


def _beside(rows: DataFrame, found: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``found``, one row for each of their groups; null is a group."""
    if not by:  # one row for all
        return rows.join(F.broadcast(found), how="left")
    names = {c: f"{c}__group" for c in by}
    same = [F.col(f"rows__.{c}").eqNullSafe(F.col(f"found__.{g}")) for c, g in names.items()]
    return rows.alias("rows__").join(found.withColumnsRenamed(names).alias("found__"), same, how).drop(*names.values())


def percentiles_linear(df: DataFrame, value: str, by: list[str], **ps: float) -> DataFrame:
    """(by, mean, one column for each of ``ps``): as :func:`percentile_linear`, without a group's values in one buffer."""
    out = ranked(df, value, by)
    rank = {name: (F.col("n") - 1) * p for name, p in ps.items()}
    at = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), F.col(value).cast("double")))
    out = out.groupBy(*by).agg(F.max("n").alias("n"), *[x for name, r in rank.items() for x in (at(F.floor(r)).alias(f"{name}__a"), at(F.ceil(r)).alias(f"{name}__b"))])
    line = lambda name, r: F.when(F.floor(r) == F.ceil(r), F.col(f"{name}__a")).otherwise((F.ceil(r) - r) * F.col(f"{name}__a") + (r - F.floor(r)) * F.col(f"{name}__b"))
    found = out.select(*by, *[line(name, r).alias(name) for name, r in rank.items()])
    return _beside(df.groupBy(*by).agg(F.avg(value).alias("mean")), found, by, "left")


def percentile_nearest(df: DataFrame, value: str, p: float, by: list[str]) -> DataFrame:
    """The value at the 0-based rank floor(n p); for the median that is floor(n / 2)."""
    rank = F.floor(F.col("n") * p)
    return ranked(df, value, by).filter((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)).select(*by, F.col(value).alias("percentile"))


def percentile_exclusive(df: DataFrame, value: str, p: float, by: list[str], least: int = 21) -> DataFrame:
    """Between the neighbours of the 1-based rank (n + 1) p; the maximum for groups of fewer than ``least`` values."""
    upto = ranked(df, value, by)
    low = F.least(F.greatest(F.floor((F.col("n") + 1) * p), F.lit(1)), F.col("n") - 1)
    at = lambda r: F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), F.col(value)))
    out = upto.groupBy(*by).agg(F.max("n").alias("n"), F.max(value).alias("top"), at(low).alias("a"), at(low + 1).alias("b"))
    frac = (F.col("n") + 1) * p - F.least(F.greatest(F.floor((F.col("n") + 1) * p), F.lit(1)), F.col("n") - 1)
    return out.select(*by, F.when(F.col("n") < least, F.col("top")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * frac).alias("percentile"))


def overview(traces: DataFrame) -> DataFrame:
    """Health of traces (status, total_latency_ms, retry_count, retry_improved); no traces count as full success."""
    n = F.count("*")
    retried = F.coalesce(F.col("retry_count"), F.lit(0)) > 0
    return traces.agg(n.alias("total"), percent(F.count_if(F.col("status") == "SUCCESS"), n, 1, 100.0).alias("success_rate"), percent(F.count_if(F.col("status") == "FALLBACK"), n, 1).alias("fallback_rate"), percent(F.count_if(retried & F.coalesce("retry_improved", F.lit(False))), F.coalesce(F.sum(F.when(retried, F.col("retry_count"))), F.lit(0)), 1).alias("recovery_rate"))


def span_failures(traces: DataFrame) -> DataFrame:
    """(stage, category, n) of failed spans."""
    spans = traces.select(F.explode("spans").alias("s")).select("s.*")
    return spans.filter("status = 'ERROR' and failure_category is not null").groupBy(F.col("name").alias("stage"), F.col("failure_category").alias("category")).agg(F.count("*").alias("n"))


def guard_stats(traces: DataFrame) -> DataFrame:
    """(guard, checks, shadow_blocks, enforced_blocks, block_rate)."""
    g = traces.select(F.explode("spans").alias("s")).select(F.explode("s.guard_results").alias("g")).select("g.*")
    bad, hard = ~F.coalesce("passed", F.lit(False)), F.col("mode") == "ENFORCED"
    out = g.groupBy(F.col("guard_name").alias("guard")).agg(F.count("*").alias("checks"), F.count_if(bad & ~F.coalesce(hard, F.lit(False))).alias("shadow_blocks"), F.count_if(bad & hard).alias("enforced_blocks"))
    return out.withColumn("block_rate", percent(F.col("shadow_blocks") + F.col("enforced_blocks"), F.col("checks")))


def confusion(df: DataFrame, guard: str, blocked: Column, bad: Column, latency: Column, limit: float = 2.5) -> DataFrame:
    """Per guard: true and false positives and negatives, false-positive rate, mean latency, and whether to enforce it."""
    out = df.groupBy(guard).agg(F.count_if(blocked & bad).alias("tp"), F.count_if(blocked & ~bad).alias("fp"), F.count_if(~blocked & ~bad).alias("tn"), F.count_if(~blocked & bad).alias("fn"), F.round(F.avg(latency), 3).alias("avg_latency_ms"))
    out = out.withColumn("fpr", percent(F.col("fp"), F.col("fp") + F.col("tn")))
    return out.withColumn("advice", F.when(F.col("fpr") < limit, "SAFE_TO_ENFORCE").otherwise("REMAIN_IN_SHADOW"))


def ab_test(events: DataFrame, variant: str, success: Column, control: str, **averages: Column) -> DataFrame:
    """Per variant: size, success rate, averages, and a pooled two-proportion z-test against ``control``.

    ``p_rough`` is a linear approximation kept for comparability (it may exceed 1); ``p_normal`` is the normal tail."""
    stats = events.groupBy(F.col(variant).alias("variant")).agg(F.count("*").alias("n"), F.count_if(success).alias("wins"), *[F.round(F.avg(c), 3).alias(k) for k, c in averages.items()])
    stats = stats.withColumn("rate", F.col("wins") / F.col("n"))
    base = stats.filter(F.col("variant") == control).select(F.col("n").alias("n0"), F.col("rate").alias("r0"))
    both = stats.join(F.broadcast(base), how="left")
    pooled = (F.col("r0") * F.col("n0") + F.col("rate") * F.col("n")) / (F.col("n0") + F.col("n"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n0") + 1 / F.col("n")))
    z = F.when((F.col("variant") != control) & (se > 0), (F.col("rate") - F.col("r0")) / se)
    both = both.withColumn("z_raw", z).withColumn("t", 1 / (1 + 0.2316419 * F.abs("z_raw")))
    # Abramowitz and Stegun's polynomial for the normal tail
    poly = sum((F.lit(c) * F.pow("t", F.lit(k)) for k, c in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 1)), F.lit(0.0))
    tail = F.exp(-F.col("z_raw") * F.col("z_raw") / 2) / F.lit(2.5066282746310002) * poly
    out = both.select("variant", "n", "wins", F.round("rate", 4).alias("rate"), *averages, F.round("z_raw", 4).alias("z"), F.round(2 * (1 - F.least(F.lit(0.9999), F.abs("z_raw") / 3.5)), 4).alias("p_rough"), F.round(2 * tail, 4).alias("p_normal"))
    return out.withColumn("significant", F.col("p_normal") < 0.05)


def score_summary(events: DataFrame) -> DataFrame:
    """(event_type, n, score, catches, blunders) of events with a score_delta."""
    d = F.coalesce("score_delta", F.lit(0))
    return events.groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count("*").alias("n"), F.sum(d).cast("long").alias("score"), F.count_if(d > 0).alias("catches"), F.count_if(d < 0).alias("blunders"))


def rolling(events: DataFrame, key: str, ts: str, seconds: int, value: Column) -> DataFrame:
    """Adds requests and the sum of ``value`` in the ``seconds`` up to each event: (t - seconds, t].

    Time is cut into slots of that length. A window reaches no further than the slot before, so each slot is a
    window's partition of its own, with the (time, value) of the slot before it: a busy key spreads over its slots.
    Events without a time are each other's window."""
    span = seconds * 1_000_000
    known = events.withColumns({"at__": F.unix_micros(ts), "value__": value})
    known = known.withColumn("slot__", F.expr(f"floor(at__ / {span})"))
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns if c not in ("recent", "recent_sum")])
    own = known.select(F.col(key).alias("key__"), "slot__", "at__", "value__", row.alias("row__"))
    before = known.filter("at__ is not null").select(F.col(key).alias("key__"), (F.col("slot__") + 1).alias("slot__"), "at__", "value__", F.lit(None).cast(own.schema["row__"].dataType).alias("row__"))
    w = Window.partitionBy("key__", "slot__").orderBy("at__").rangeBetween(-(span - 1), 0)
    out = own.unionByName(before).withColumns({"recent": F.count("*").over(w), "recent_sum": F.sum("value__").over(w)})
    return out.filter("row__ is not null").select("row__.*", "recent", "recent_sum")


def breaker(calls: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 3, slot: Column | None = None) -> DataFrame:
    """Adds ``streak``, the consecutive failures up to each call, and ``trips``, whether this call opens the breaker.

    Streaks are counted within slots (by default hours of ``order[0]``; any column that never falls in that order
    will do) and carried from slot to slot by a window over the slots' summaries: whether a call succeeded, and how many
    failed since. So a busy key spreads over its slots. A call that is neither failed nor not counts as neither."""
    slot = F.date_trunc("hour", order[0]) if slot is None else slot
    w = Window.partitionBy(key, "slot__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = calls.withColumns({"failed__": F.coalesce(failed.cast("int"), F.lit(0)), "well__": F.coalesce((~failed).cast("int"), F.lit(0)), "slot__": slot})
    out = out.withColumn("island__", F.sum("well__").over(w))
    out = out.withColumn("streak", F.sum("failed__").over(Window.partitionBy(key, "slot__", "island__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # the last island of a slot is the greatest, and its streak only grows
    ends = out.groupBy(key, "slot__").agg(F.max(F.struct("island__", "streak")).alias("end__"))
    in_order = Window.partitionBy(key).orderBy("slot__")
    ends = ends.withColumn("since__", F.sum((F.col("end__.island__") > 0).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    carried = F.sum("end__.streak").over(Window.partitionBy(key, "since__").orderBy("slot__").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("after__", carried).withColumn("carry__", F.coalesce(F.lag("after__").over(in_order), F.lit(0))).select(key, "slot__", "carry__")
    out = _beside(out, ends, [key, "slot__"])
    out = out.withColumn("streak", F.col("streak") + F.when(F.col("island__") == 0, F.col("carry__")).otherwise(0))
    return out.withColumn("trips", F.col("streak") == threshold).drop("failed__", "well__", "slot__", "island__", "carry__")


def last_rows(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The last n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def confidence(patterns: Column, known: Column, critical: Column, warnings: Column, retries: Column, max_retries: int, joins: Column, depth: Column, cross: Column, digits: int = 2) -> Column:
    """0 to 1: pattern match, validation health, retries and complexity, weighted 0.30, 0.40, 0.20 and 0.10."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    pattern = F.when((patterns > 0) & (known > 0), F.least(F.lit(1.0), 0.85 + patterns / known * 0.15)).otherwise(0.85)
    valid = unit(1 - critical * 0.3 - warnings * 0.1)
    run = F.when(retries == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1 - retries / max_retries))
    plain = unit(1 - (joins > 5).cast("int") * 0.1 - (depth > 2).cast("int") * 0.15 - cross.cast("int") * 0.3)
    return F.round(unit(pattern * 0.30 + valid * 0.40 + run * 0.20 + plain * 0.10), digits)


def outliers(df: DataFrame, numeric: list[str], order: list[str], rows: int = 100, factor: float = 10.0) -> DataFrame:
    """(average, has_outlier): whether a number among the first ``rows`` rows in ``order`` is further than ``factor`` times the average's size from it."""
    values = df.orderBy(*order).limit(rows).select(F.explode(F.array(*[F.col(c).cast("double") for c in numeric])).alias("v")).filter("v is not null")
    stats = values.agg(F.avg("v").alias("average"), F.max("v").alias("high"), F.min("v").alias("low"))
    far = F.greatest(F.col("high") - F.col("average"), F.col("average") - F.col("low"))
    return stats.select("average", F.coalesce((F.col("average") != 0) & (far > factor * F.abs("average")), F.lit(False)).alias("has_outlier"))


def compare(base: DataFrame, other: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """(metric, baseline, optimised, change in percent, better) of two one-row tables; metrics name whether more is better."""
    long = lambda df, name: df.select(F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", name))
    both = long(base, "baseline").join(long(other, "optimised"), "metric")
    more = F.create_map(*[x for m, up in metrics.items() for x in (F.lit(m), F.lit(up))])[F.col("metric")]
    change = F.when(F.col("baseline") != 0, F.round((F.col("optimised") - F.col("baseline")) * 100 / F.col("baseline"), 1)).when(F.col("optimised") == 0, 0.0).otherwise(F.when(more, 100.0).otherwise(-100.0))
    return both.withColumn("change", change).withColumn("better", F.when(more, F.col("optimised") >= F.col("baseline")).otherwise(F.col("optimised") <= F.col("baseline")))
