"""Answers by template, without a model: which questions allow it, what is said, and when a template is switched off."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.classify import has_any

# What makes a question more than a question of fact.
DISQUALIFIERS = ["due to", "because of", "as a result", "given that", "based on", "in the context of", "why", "explain", "compared to", "relative to", "versus", " vs "]
#: A template is off from the attempt on at which, of so many attempts or more, this share has failed.
LEAST_ATTEMPTS, FAILURE_SHARE = 50, 0.01
#: Seconds of attempts that are counted one by one; longer stretches are summed first.
SLOT = 3600


def factual(question: Column | str) -> Column:
    """Whether a question asks for facts only; not so for an empty or null one."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    return (q != "") & ~has_any(q, DISQUALIFIERS)


# What opens a question that counts or sums, and the words that end what it counts or sums.
COUNTS = (["how many", "count of", "number of"], ["are there", "were", "in", "with", "for", "that", "from"])
SUMS = (["what is the total", "sum of", "total", "sum"], ["of", "for", "in", "by"])


def asked_for(openings: list[str], ends: list[str]) -> str:
    """The pattern whose first group is what stands between an opening and an end, a question mark or the end of the text."""
    return rf"(?i)(?:{'|'.join(openings)})\s+([a-z0-9_\s]+?)(?:\s+(?:{'|'.join(ends)})|\s*\?|\s*$)"


def subject(question: Column | str, kind: Column) -> Column:
    """What a question counts or sums, in its own words."""
    q = F.trim(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    found = lambda words, default: F.coalesce(F.nullif(F.trim(F.regexp_extract(q, asked_for(*words), 1)), F.lit("")), F.lit(default))
    return F.when(kind == "COUNT", found(COUNTS, "records")).when(kind == "SUM", found(SUMS, "amount"))


def sentence(question: Column | str, kind: Column, value: Column) -> Column:
    """A single value as a sentence; null where the kind of question has none, or the value is null."""
    number = F.regexp_replace(F.format_number(value, 2), r"\.00$", "")
    what = subject(question, kind)
    return F.when(kind == "COUNT", F.concat(F.lit("There are "), number, F.lit(" "), what, F.lit("."))).when(kind == "SUM", F.concat(F.lit("The total "), what, F.lit(" is "), number, F.lit(".")))


def tripped(attempts: DataFrame, kind: str, ts: str, order: str, failed: Column) -> DataFrame:
    """(kind, tripped_at, tripped_order): the attempt after which a kind's template stays off; kinds that never trip are left out.

    Attempts are in order of ``ts`` and ``order`` (unique). Sums run in two levels: within slots of an hour, and over the
    slots' sums, so that a task holds an hour of a kind; nothing depends on what happens after the trip, for then
    no attempt is made. A null outcome has failed; attempts without a time come first."""
    a = attempts.select(F.col(kind).alias("kind"), F.coalesce(F.unix_micros(F.col(ts)), F.lit(-(2**62))).alias("at"), F.col(order).alias("o"), F.coalesce(failed, F.lit(True)).cast("long").alias("bad"))
    a = a.withColumn("slot", F.expr(f"at div {SLOT * 1_000_000}"))
    sums = a.groupBy("kind", "slot").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    before = Window.partitionBy("kind").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("kind", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bad").over(before), F.lit(0)).alias("bad0"))
    within = Window.partitionBy("kind", "slot").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    running = a.select("kind", "slot", "at", "o", F.count("*").over(within).alias("n1"), F.sum("bad").over(within).alias("bad1")).join(carried, ["kind", "slot"])
    n, bad = F.col("n0") + F.col("n1"), F.col("bad0") + F.col("bad1")
    first = running.filter((n >= LEAST_ATTEMPTS) & (bad >= n * FAILURE_SHARE)).groupBy("kind").agg(F.min(F.struct("at", "o")).alias("x"))
    return first.select(F.col("kind").alias(kind), F.col("x.at").alias("tripped_at"), F.col("x.o").alias("tripped_order"))


def answers(asked: DataFrame, kind: str, ts: str, order: str, question: str, value: str, disabled: Iterable[str] = ()) -> DataFrame:
    """Adds ``answer``: the sentence of a question of fact whose template is on, else null, so that a model has to answer.

    Attempts are the questions of fact of kinds that aren't ``disabled``; one fails where no sentence comes out. As many rows
    as kinds of question come back from ``tripped``."""
    rows = asked.withColumn("__try", factual(question) & F.coalesce(~F.col(kind).isin(list(disabled)), F.lit(True))).withColumn("__said", sentence(question, F.col(kind), F.col(value)))
    off = tripped(rows.filter("__try"), kind, ts, order, F.col("__said").isNull()).withColumnRenamed(kind, "__kind")
    at = F.coalesce(F.unix_micros(F.col(ts)), F.lit(-(2**62)))
    later = F.coalesce((at > F.col("tripped_at")) | ((at == F.col("tripped_at")) & (F.col(order) > F.col("tripped_order"))), F.lit(False))
    out = rows.join(off, F.col(kind).eqNullSafe(F.col("__kind")), "left").withColumn("answer", F.when(F.col("__try") & ~later, F.col("__said")))
    return out.select(*asked.columns, "answer")
