"""Checks of SQL statements: one at a time before it runs, or a whole log of statements as a DataFrame.

Parsing and analysis are left to Spark, and the checks walk its trees (``tree``). A log of statements is linted by expressions over its text, so that
millions of logged statements are one scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.classify import temporal_intent
from .tree import TABLE_FUNCTIONS, Trees, analysed, estimated_rows

ROW_CAP, CARTESIAN_CAP = 500, 100
# Functions that reach outside the data, or waste time.
BLOCKED = "load_file loadfile sys_eval sys_exec sys_get lo_import lo_export benchmark sleep get_lock release_lock release_all_locks is_free_lock is_used_lock java_method reflect try_reflect input_file_name".split()


@dataclass
class Verdict:
    """What is wrong with a statement (``errors``), and what to look at (``warnings``)."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    cartesian: bool = False
    rows: DataFrame | None = None  # what the statement returns, if it may be analysed

    @property
    def ok(self) -> bool:
        return not self.errors


def check(spark: SparkSession, sql: str, allowed: list[str] | None = None, functions: list[str] | None = None) -> Verdict:
    """Whether one statement only reads allowed tables, by built-in functions that compute or by declared ``functions``.

    The statement is judged as parsed, before Spark looks anything up: no name in it has opened a file or run code by then.
    Only what passes is analysed, and its functions are judged again by what they have become."""
    out, trees = Verdict(), Trees(spark)
    known = None if allowed is None else {a.lower() for a in allowed}
    try:
        found = trees.written(sql or "")
    except ParseException as e:
        out.errors.append(f"can't be parsed: {str(e).splitlines()[0][:200]}")
        return out
    out.tables, out.cartesian = sorted(found.relations), found.cartesian
    if found.refused:
        out.errors.append(f"does more than read: {', '.join(sorted(found.refused))}")
    for name in trees.unsafe_functions(found.functions, {f.lower() for f in functions or []}) + sorted(found.table_functions - TABLE_FUNCTIONS - {f.lower() for f in functions or []}):
        out.errors.append(f"blocked function: {name}")
    for x in out.tables:
        if (x.lower() not in known) if known is not None else (found.parts[x] > 1 and not (re.fullmatch(r"[\w.]+", x) and spark.catalog.tableExists(x))):
            out.errors.append(f"unknown table: {x}")
    if known is not None and (shadow := found.common & known):
        out.errors.append(f"a common table hides a table: {', '.join(sorted(shadow))}")
    if out.errors:
        return out
    try:
        out.rows = spark.sql(sql)
        for kind in trees.outside(analysed(out.rows)):
            if kind not in (functions or []):
                out.errors.append(f"blocked expression: {kind}")
    except AnalysisException as e:
        out.errors.append(f"unresolved: {str(e).splitlines()[0][:300]}")
        return out
    joins = found.nodes & {"Join", "LateralJoin"}
    for what, is_so in (("cartesian product", found.cartesian), ("selects all columns", found.star), ("compares with NULL", found.null_comparison), ("joins without a filter", joins and "Filter" not in found.nodes)):
        if is_so:
            out.warnings.append(what)
    return out


def run(spark: SparkSession, sql: str, allowed: list[str] | None = None, cap: int = ROW_CAP, functions: list[str] | None = None) -> DataFrame:
    """The rows of a checked statement, at most ``cap`` and at most CARTESIAN_CAP of a cartesian product."""
    verdict = check(spark, sql, allowed, functions)
    if not verdict.ok:
        raise PermissionError("; ".join(verdict.errors))
    return verdict.rows.limit(min(cap, CARTESIAN_CAP) if verdict.cartesian else cap)


def shape(sql: Column) -> Column:
    """A statement with its texts and numbers replaced by signs: statements of one shape differ in values only."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(sql, F.lit("")), r"'(?:[^'\\]|\\.|'')*'", "'?'"), r"(?<![\w.])\d+(\.\d+)?(?![\w.])", "0")


def verdicts(log: DataFrame, allowed: list[str], sql_col: str = "sql", most: int = 10_000) -> DataFrame:
    """Adds ``ok``, ``cartesian``, ``errors`` and ``warnings`` to a log of statements; what can't be parsed, null included, isn't ok.

    Whether a statement is allowed doesn't hang on the values in it, so each shape is checked once and its verdict joined
    back. Shapes are checked on the driver, where Spark's parser is: more than ``most`` are an error, none is skipped."""
    keyed = log.withColumn("__shape", shape(F.col(sql_col)))
    shapes = keyed.groupBy("__shape").agg(F.min(sql_col).alias("one")).limit(most + 1).collect()
    if len(shapes) > most:
        raise ValueError(f"more than {most} shapes of statements")
    found = [(r["__shape"], check(log.sparkSession, r["one"], allowed)) for r in shapes]
    rows = [(s, v.ok, v.cartesian, "; ".join(v.errors), ", ".join(v.warnings)) for s, v in found]
    known = log.sparkSession.createDataFrame(rows, "__shape string, ok boolean, cartesian boolean, errors string, warnings string")
    return keyed.join(F.broadcast(known), "__shape").drop("__shape")


def misleading_aliases(sql: str, question: str, columns: list[str]) -> list[str]:
    """Aliases that repeat words of the question but share none with the column they rename."""
    out = []
    for column, alias in re.findall(r"(?i)\b(?:\w+\.)?(\w+)\s+as\s+(\w+)", sql):
        own, other = set(column.lower().split("_")), set(alias.lower().split("_"))
        if column.lower() in {c.lower() for c in columns} and not own & other and other & set(re.findall(r"\w+", question.lower())):
            out.append(alias)
    return out


def _analysed(spark: SparkSession, sql: str):
    """The analysed tree of a statement that passes the check."""
    verdict = check(spark, sql)
    if not verdict.ok:
        raise PermissionError("; ".join(verdict.errors))
    return Trees(spark), analysed(verdict.rows)


def text_sums(spark: SparkSession, frames: dict[str, DataFrame], sql: str) -> list[str]:
    """Text columns that a statement over the views of ``frames`` sums or averages without a cast."""
    trees, plan = _analysed(spark, sql)
    own = {c for df in frames.values() for c in df.columns}
    return sorted(trees.summed_texts(plan) & own)


def column_lineage(spark: SparkSession, sql: str) -> dict[str, set[str]]:
    """For each column of a statement's result the columns (table.column) that it comes from, through aliases, common tables and subqueries."""
    trees, plan = _analysed(spark, sql)
    return {name: {f"{t}.{c}" if t else c for t, c in origin} for name, _, origin in trees.lineage(plan)}


#: Words of questions that name nothing.
STOP = {"a", "an", "and", "are", "by", "for", "from", "how", "in", "is", "many", "much", "of", "per", "the", "to", "total", "what", "which", "with"}


def dishonest_aliases(spark: SparkSession, sql: str, question: str) -> list[str]:
    """Result columns that bear words of the question but are a single column, as it is, whose name has none of them."""
    trees, plan = _analysed(spark, sql)
    asked = set(re.findall(r"\w+", question.lower())) - STOP
    words = lambda name: {w for w in name.lower().split("_") if w not in STOP}
    return [name for name, plain, origin in trees.lineage(plan) if plain and len(origin) == 1 and words(name) & asked and not words(name) & words(next(iter(origin))[1])]


def unknown_aliases(spark: SparkSession, sql: str, vocabulary: list[str]) -> list[str]:
    """Result columns that are computed, or constants, under names with a word that neither their columns nor ``vocabulary`` (metrics, glossary) have."""
    trees, plan = _analysed(spark, sql)
    known = {w for v in vocabulary for w in v.lower().split("_")}
    return [name for name, plain, origin in trees.lineage(plan) if not plain and set(name.lower().split("_")) - known - {w for _, c in origin for w in c.lower().split("_")}]


def temporal_bound(spark: SparkSession, question: str, sql: str) -> bool:
    """False where the question bounds a time and no condition of the statement compares a date."""
    asks = spark.createDataFrame([(question,)], "q string").select(temporal_intent("q").alias("t")).first()["t"]
    trees, plan = _analysed(spark, sql)
    return not asks or trees.bounds_time(plan)


def estimate(spark: SparkSession, sql: str, allowed: list[str] | None = None) -> tuple[str, int]:
    """(finding, rows): critical for a cartesian product, warning above ROW_CAP, else info, by the optimizer's estimate of the result."""
    verdict = check(spark, sql, allowed)
    if not verdict.ok:
        raise PermissionError("; ".join(verdict.errors))
    n = estimated_rows(verdict.rows)
    return ("critical" if verdict.cartesian else "warning" if n > ROW_CAP else "info"), n


def lint(statements: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Adds a boolean column for each finding to a log of statements."""
    s = F.regexp_replace(F.coalesce(sql_col, F.lit("")), r"'(?:[^'\\]|\\.|'')*'", "''")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r'"(?:[^"\\]|\\.)*"', "''"), r"--[^\n]*|(?s:/\*.*?\*/)", " "))
    raw = F.coalesce(F.col(sql_col), F.lit(""))
    has = lambda p: s.rlike(rf"(?i){p}")
    return statements.withColumns({
        "not_read_only": ~has(r"^\s*\(*\s*(select|with|values)\b") | has(r"\b(insert\s+into|update\s+\w+\s+set|delete\s+from|drop\s+(table|view)|truncate\s+table|alter\s+table|create\s+(or\s+replace\s+)?(table|view)|merge\s+into|grant|revoke)\b"),
        "many_statements": has(r";\s*\S"),
        "blocked_function": has(rf"\b({'|'.join(BLOCKED)})\s*\("),
        "select_star": has(r"\bselect\s+(distinct\s+)?(\w+\.)?\*"),
        "cartesian": has(r"\bcross\s+join\b") | has(r"\bfrom\s+\w+(\s+(as\s+)?\w+)?\s*,\s*\w+"),
        "null_comparison": has(r"(=|<>|!=)\s*null\b"),
        "unfiltered_join": has(r"\bjoin\b") & ~has(r"\bwhere\b"),
        "far_future": has(r"\bwhere\b") & raw.rlike(r"'[^']*\b(209[0-9]|21[0-9]{2})\b[^']*'"),
        "long_pattern": raw.rlike(r"(?i)\blike\s+'[^']{41,}'"),
    })


def empty_result_class(sql_col: str = "sql") -> Column:
    """'suspicious_empty' where a statement's own shape explains that it found nothing, else 'valid_empty'."""
    s = F.coalesce(F.col(sql_col), F.lit(""))
    has = lambda p: s.rlike(rf"(?i){p}")
    odd = (has(r"\bjoin\b") & ~has(r"\bwhere\b")) | (has(r"\bwhere\b") & s.rlike(r"'[^']*\b(209[0-9]|21[0-9]{2})\b[^']*'")) | (F.length(F.regexp_replace(F.regexp_extract(s, r"(?i)\bi?like\s+'([^']*)'", 1), "[%_]", "")) > 40)
    return F.when(odd, "suspicious_empty").otherwise("valid_empty")


def temporal_guard(question_col: str, sql_col: str) -> Column:
    """False where a question bounds a time and the statement's WHERE doesn't."""
    where = F.lower(F.regexp_extract(F.coalesce(sql_col, F.lit("")), r"(?is)\bwhere\b(.*?)(?:\bgroup\s+by\b|\border\s+by\b|\blimit\b|$)", 1))
    bounded = where.rlike(r"(date|time|year|created_at|updated_at|month|quarter|curdate|now\b).*(between|>=|<=|>|<|=|like)|(between|>=|<=|>|<|=|like)[^a-z]*'?(19|20)\d{2}")
    return ~temporal_intent(question_col) | bounded


def zero_row_aggregate(row: dict, sql: str) -> bool:
    """Whether a single all-NULL row comes from an aggregate over nothing."""
    return bool(row) and all(v is None for v in row.values()) and bool(re.search(r"(?i)\b(sum|avg|min|max)\s*\(", sql)) and not re.search(r"(?i)\bgroup\s+by\b", sql)
