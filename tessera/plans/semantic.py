"""A small semantic layer: questions to metrics, dimensions, filters and periods, and those to DataFrame plans.

Metrics are named expressions over the joined star; a plan groups them by a dimension. Everything is
declared, so Catalyst prunes what a question doesn't need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import has_any, has_word, soft_delete_intent
from ..functions.dates import window

MONEY = "decimal(18,2)"
# What a measure is called, and how it is computed from order lines.
METRICS = {
    "sales value": "sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2))))",
    "gross value": "sum(cast(l_extendedprice as decimal(18,2)))",
    "quantity": "sum(cast(l_quantity as decimal(18,2)))",
    "orders": "count(distinct o_orderkey)",
    "average line": "avg(cast(l_extendedprice as decimal(18,2)))",
}
DIMENSIONS = {"customer": "c_name", "supplier": "s_name", "product": "p_name", "nation": "n_name", "month": "date_format(o_orderdate, 'yyyy-MM')", "segment": "c_mktsegment"}
# Words by metric, dimension and filter, in order of precedence.
METRIC_WORDS = [("quantity", ["qty", "quantity", "volume", "units"]), ("orders", ["number of orders", "how many orders", "order count"]), ("average line", ["average", "mean"]), ("gross value", ["gross"]), ("sales value", ["sales", "revenue", "turnover", "sold", "spent", "bought", "value"])]
DIMENSION_WORDS = [("customer", ["customer", "client", "buyer", "party"]), ("supplier", ["supplier", "vendor"]), ("product", ["product", "item", "goods", "sku", "part"]), ("nation", ["nation", "country"]), ("segment", ["segment"]), ("month", ["month"])]
FILTER_WORDS = [("open", ["open", "pending", "in progress", "in-progress"]), ("shortfall", ["shortfall", "fell short"]), ("inactive", ["inactive", "haven't ordered", "no orders"])]
PERIODS = ["last month", "last quarter", "this year", "last year", "last 6 months", "last 30 days"]


def _first(q: Column, table) -> Column:
    out = F.when(F.lit(False), "")
    for name, words in table:
        out = out.when(has_any(q, words), name)
    return out


def intent(question: Column | str) -> Column:
    """struct(metric, dimensions, filters, period, aggregation, rows, descending, scope, records) of a question."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    named = lambda table: F.array_compact(F.array(*[F.when(has_any(q, w), n) for n, w in table]))
    period = _first(q, [(p, [p, p.replace("last", "past"), p.replace("last", "previous"), p.replace("this", "current")]) for p in PERIODS])
    top = F.regexp_extract(q, r"\btop\s+(\d+)\b", 1)
    best, worst = has_word(q, "best|highest|top|most|maximum|greatest"), has_word(q, "lowest|worst|least|minimum|cheapest")
    agg = F.when(has_word(q, "how many|count|number of"), "COUNT").when(has_word(q, "how much|total|sum|overall"), "SUM").when(has_word(q, "average|mean|avg"), "AVG")
    current, ever = has_word(q, "current|this year|this financial year|this fiscal year|ongoing|present year"), has_word(q, "total|all|all-time|all time|history|historical|overall|cumulative|ever|lifetime|entire")
    scope = F.when(current, "CURRENT_YEAR").when(ever | agg.isNotNull() | period.isNull(), "ALL_TIME").otherwise("SPECIFIC_PERIOD")
    rows = F.when(top != "", top.cast("int")).when(best | worst, 1)
    descending = F.when((top != "") | best, True).when(worst, False)
    return F.struct(_first(q, METRIC_WORDS).alias("metric"), named(DIMENSION_WORDS).alias("dimensions"), named(FILTER_WORDS).alias("filters"), period.alias("period"), agg.alias("aggregation"), rows.alias("rows"), descending.alias("descending"), scope.alias("scope"), soft_delete_intent(question).alias("records"))


@dataclass
class Ask:
    """One question's meaning."""

    metric: str = "sales value"
    dimension: str | None = None
    period: str | None = None
    open_only: bool = False
    rows: int | None = None
    descending: bool = True


def star(frames: dict[str, DataFrame]) -> DataFrame:
    """Order lines with all they refer to; joins that a question doesn't use are pruned or small."""
    f = frames
    out = f["lineitem"].join(f["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(f["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return out.join(f["nation"], F.col("c_nationkey") == F.col("n_nationkey"))


def plan(frames: dict[str, DataFrame], ask: Ask, today: Column) -> DataFrame:
    """(dimension, value) of a question, ordered; the dimension column is missing for a single total."""
    f = frames
    rows = f["lineitem"].join(f["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    if ask.dimension in ("customer", "segment", "nation"):
        rows = rows.join(f["customer"], F.col("o_custkey") == F.col("c_custkey"))
    if ask.dimension == "nation":
        rows = rows.join(f["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    if ask.dimension == "supplier":
        rows = rows.join(f["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    if ask.dimension == "product":
        rows = rows.join(f["part"], F.col("l_partkey") == F.col("p_partkey"))
    if ask.open_only:
        rows = rows.filter(F.col("o_orderstatus") == "O")
    if ask.period:
        low, high = window(ask.period, today)
        rows = rows.filter((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < high))
    value = F.expr(METRICS[ask.metric]).cast("double").alias("value")
    if ask.dimension is None:
        return rows.agg(value)
    out = rows.groupBy(F.expr(DIMENSIONS[ask.dimension]).alias("dimension")).agg(value)
    out = out.orderBy(F.desc("value") if ask.descending else F.asc("value"), "dimension")
    return out.limit(ask.rows) if ask.rows else out


def answer(frames: dict[str, DataFrame], question: str, today: Column) -> DataFrame:
    """The plan of a question in words."""
    spark = next(iter(frames.values())).sparkSession
    i = spark.range(1).select(intent(F.lit(question)).alias("i")).first()["i"]
    ask = Ask(i["metric"] or "sales value", (list(i["dimensions"]) or [None])[0], i["period"], "open" in i["filters"], i["rows"], i["descending"] is not False)
    return plan(frames, ask, today)


def template(kind: Column, value: Column, subject: Column) -> Column:
    """A sentence for a single value, where the type of question allows one."""
    number = F.regexp_replace(F.format_number(value, 2), r"\.00$", "")
    return F.when(kind == "COUNT", F.concat(F.lit("There are "), number, F.lit(" "), subject, F.lit("."))).when(kind == "SUM", F.concat(F.lit("The total "), subject, F.lit(" is "), number, F.lit(".")))
