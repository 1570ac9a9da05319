"""Citations in answers: extraction, numbering by source and page, and checks against what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import content_words

ID = r"(?:[a-f0-9]+_chunk_[0-9_]+|live_[a-z0-9]+_[0-9]+)"
BRACKET = rf"\[\s*{ID}(?:\s*,\s*{ID})*\s*\]"


def cited(answers: DataFrame) -> DataFrame:
    """(answer_id, place, bracket, chunk_id) of every id in a citation bracket of (answer_id, answer), in reading order."""
    plain = F.translate("answer", "【】", "[]")
    brackets = answers.select("answer_id", F.posexplode(F.regexp_extract_all(plain, F.lit(f"({BRACKET})"), 1)).alias("b", "bracket"))
    return brackets.select("answer_id", "b", "bracket", F.posexplode(F.split(F.regexp_replace("bracket", r"[\[\]\s]", ""), ",")).alias("i", "chunk_id")).withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("b", "i"))).drop("i")


def footnotes(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(answer_id, chunk_id, source_file, page_number, footnote): one number for each file and page, by first mention.

    retrieved: (answer_id, chunk_id, source_file, page_number). Ids that weren't retrieved have no row."""
    found = cited(answers).join(retrieved, ["answer_id", "chunk_id"])
    first = found.groupBy("answer_id", "source_file", "page_number").agg(F.min("place").alias("first_place"), F.min_by("chunk_id", "place").alias("chunk_id"))
    return first.withColumn("footnote", F.row_number().over(Window.partitionBy("answer_id").orderBy("first_place"))).drop("first_place")


def render(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(answer_id, clean): brackets as footnote numbers, unknown ids removed, sources listed below.

    A source without a file name is listed as Unknown, one without a page without a page."""
    retrieved = retrieved.withColumn("source_file", F.coalesce("source_file", F.lit("Unknown")))
    notes = footnotes(answers, retrieved)
    known = notes.select(F.col("answer_id").alias("of"), F.col("source_file").alias("file"), F.col("page_number").alias("page"), "footnote")
    same = (F.col("answer_id") == F.col("of")) & (F.col("source_file") == F.col("file")) & F.col("page_number").eqNullSafe(F.col("page"))
    each = cited(answers).join(retrieved, ["answer_id", "chunk_id"], "left").join(known, same, "left")
    marks = each.groupBy("answer_id", "b", "bracket").agg(F.array_sort(F.collect_set(F.when(F.col("footnote").isNotNull(), F.struct("footnote")))).alias("n"))
    marks = marks.withColumn("mark", F.array_join(F.transform("n", lambda x: F.concat(F.lit("["), x["footnote"].cast("string"), F.lit("]"))), ""))
    marks = marks.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("b", "mark"))).alias("marks"))
    base = F.regexp_extract(F.col("source_file"), r"([^/\\]*)$", 1)
    line = F.concat(F.col("footnote").cast("string"), F.lit(". "), base, F.when(F.col("page_number").isNotNull(), F.concat(F.lit(" (Page "), F.col("page_number").cast("string"), F.lit(")"))).otherwise(""))
    lists = notes.withColumn("line", line).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("footnote", "line"))).alias("lines"))
    out = answers.join(marks, "answer_id", "left").join(lists, "answer_id", "left")
    # text between brackets and the marks of the brackets alternate
    parts = F.split(F.translate("answer", "【】", "[]"), BRACKET, -1)
    body = F.array_join(F.zip_with(parts, F.coalesce(F.transform("marks", lambda m: m["mark"]), F.array().cast("array<string>")), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    refs = F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n\n**References**\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))).otherwise("")
    return out.select("answer_id", F.concat(body, refs).alias("clean"))


def guard(answers: DataFrame, retrieved: DataFrame, least: float = 0.10, min_words: int = 8) -> DataFrame:
    """(answer_id, passed, reason): an answer fails if it cites what wasn't retrieved or hardly shares words with its context.

    retrieved: (answer_id, chunk_id, content)."""
    unknown = cited(answers).join(retrieved.select("answer_id", "chunk_id"), ["answer_id", "chunk_id"], "left_anti").groupBy("answer_id").agg(F.count("*").alias("unknown"))
    context = retrieved.select("answer_id", F.explode(content_words("content")).alias("w")).distinct()
    words = answers.select("answer_id", F.explode(content_words(F.regexp_replace("answer", BRACKET, " "))).alias("w"))
    share = words.join(context.withColumn("hit", F.lit(1)), ["answer_id", "w"], "left").groupBy("answer_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    any_context = retrieved.groupBy("answer_id").agg(F.count("*").alias("chunks"))
    out = answers.join(unknown, "answer_id", "left").join(share, "answer_id", "left").join(any_context, "answer_id", "left")
    bad_id = (F.coalesce("unknown", F.lit(0)) > 0) & F.col("chunks").isNotNull()
    weak = F.col("chunks").isNotNull() & (F.coalesce("n", F.lit(0)) >= min_words) & (F.coalesce("hits", F.lit(0)) < least * F.coalesce("n", F.lit(0)))
    reason = F.when(bad_id, "citation_mismatch").when(weak, "unsupported_answer_claim")
    return out.select("answer_id", reason.isNull().alias("passed"), reason.alias("reason"))
