"""Reports on evaluation runs and question banks, as aggregates over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pass_rates(results: DataFrame, category: str, passed: Column) -> DataFrame:
    """(category, total, passed, failed, pass_rate) of each category, and of all results where category is null.

    The rate is a percentage with one decimal. Results without a category are listed as 'unknown'; a null outcome
    counts as failed; no results give one row of zeros."""
    rows = results.select(F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("category"), F.coalesce(passed, F.lit(False)).cast("long").alias("ok"))
    counts = rows.groupBy("category").agg(F.count("*").alias("total"), F.sum("ok").alias("passed"))
    whole = counts.agg(F.lit(None).cast("string").alias("category"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"))
    rate = F.when(F.col("total") > 0, F.floor(F.col("passed") * 1000 / F.col("total") + 0.5) / 10).otherwise(0.0)
    return counts.unionByName(whole).withColumns({"failed": F.col("total") - F.col("passed"), "pass_rate": rate})


def bank_coverage(questions: DataFrame, schema: DataFrame, labels: list[str]) -> DataFrame:
    """(measure, name, n) on a bank of questions (tables: array, and the label columns) and the schema's (table_name).

    Counts of questions, of the schema's tables and of those that some question names; the size of each label;
    'unreferenced' tables with 0, and 'unknown' ones, which the schema lacks, with how many questions name them."""
    named = questions.select(F.explode(F.array_distinct("tables")).alias("name")).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    tables = schema.select(F.col("table_name").alias("name"), F.lit(True).alias("known")).distinct()
    both = tables.join(named, "name", "full").select("name", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("n", F.lit(0)).alias("n"))
    sizes = both.agg(F.count_if("known").alias("tables"), F.count_if(F.col("known") & (F.col("n") > 0)).alias("referenced"))
    sizes = sizes.select(F.explode(F.create_map(F.lit("tables"), "tables", F.lit("referenced"), "referenced")).alias("measure", "n"))
    whole = sizes.unionByName(questions.agg(F.count("*").alias("n")).withColumn("measure", F.lit("questions"))).withColumn("name", F.lit(None).cast("string"))
    gaps = both.filter("not known or n = 0").select(F.when(F.col("known"), "unreferenced").otherwise("unknown").alias("measure"), "name", "n")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("name")) for c in labels]))
    kinds = questions.select(pairs.alias("p")).groupBy("p.measure", "p.name").agg(F.count("*").alias("n"))
    return whole.unionByName(gaps).unionByName(kinds).select("measure", "name", "n")


def summary(results: DataFrame, case: str, score: str, expected: str, observed: str, twist: str, difficulty: str, worst: int = 5) -> DataFrame:
    """(measure, name, value, n) of a run: 'score', 'routing' and 'twists' of all cases, 'difficulty' by name, and 'worst' cases.

    ``routing`` is the share of cases whose observed route is the expected one, ``twists`` of those that handled theirs. A null
    score counts as 0, a null route or twist as missed, a null difficulty is 'unknown'. No results give no rows."""
    r = results.select(F.col(case).cast("string").alias("case"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col(expected) == F.col(observed), F.lit(False)).cast("double").alias("routed"),
                       F.coalesce(F.col(twist).cast("boolean"), F.lit(False)).cast("double").alias("twisted"), F.coalesce(F.col(difficulty).cast("string"), F.lit("unknown")).alias("kind"))
    per = r.groupBy("kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("s", "routed", "twisted")])
    whole = per.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("s", "routed", "twisted")]).filter("n > 0")
    none = F.lit(None).cast("string")
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), none.alias("name"), (F.col(c) / F.col("n")).alias("value")) for m, c in (("score", "s"), ("routing", "routed"), ("twists", "twisted"))]))
    overall = whole.select(measures.alias("m"), "n").select("m.*", "n")
    kinds = per.select(F.lit("difficulty").alias("measure"), F.col("kind").alias("name"), (F.col("s") / F.col("n")).alias("value"), "n")
    low = r.orderBy("s", "case").limit(worst).select(F.lit("worst").alias("measure"), F.col("case").alias("name"), F.col("s").alias("value"), F.lit(1).cast("long").alias("n"))
    return overall.unionByName(kinds).unionByName(low)
