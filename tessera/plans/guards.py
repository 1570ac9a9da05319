"""Guards around statements that a model writes: what a question needs, what a reply holds, how many rows may come."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_ROWS = 10_000
# The tables that words of a question stand for.
ENTITIES = {
    "sales_order": ["order", "orders", "sales order"],
    "party": ["customer", "supplier", "vendor", "party", "parties"],
    "purchase": ["purchase", "purchases", "po"],
    "delivery_challan": ["challan", "delivery challan", "dc"],
    "stock": ["stock", "inventory"],
    "stock_adjustment": ["stock adjustment", "adjustment"],
    "product": ["product", "products", "item", "items"],
    "warehouse": ["warehouse", "warehouses"],
    "category": ["category", "categories"],
    "machine": ["machine", "machines"],
    "production": ["production", "batch"],
    "unit": ["unit", "uom"],
    "quotation": ["quotation"],
    "proforma": ["proforma"],
    "party_opening_balance": ["balance"],
}
# How other engines spell what Spark spells otherwise.
SPELLINGS = {
    "mysql": [(r"(?i)date_format\(([^,()]*(?:\([^()]*\))?[^,()]*),\s*'%Y-%m'\)", "date_format($1, 'yyyy-MM')"), (r"(?i)\bifnull\s*\(", "coalesce("), (r"(?i)\bcurdate\(\)", "current_date()"), (r"(?i)\bstr_to_date\(([^,()]*),\s*'%Y-%m-%d'\)", "to_date($1, 'yyyy-MM-dd')"), (r"(?i)\bgroup_concat\((\w+(?:\.\w+)?)\)", "string_agg($1, ',')")],
    "sqlite": [(r"(?i)date\('now',\s*'-1 month'\)", "add_months(current_date(), -1)"), (r"(?i)date\('now',\s*'-(\d+) days?'\)", "date_sub(current_date(), $1)"), (r"(?i)strftime\('%Y-%m',\s*'now'\)", "date_format(current_date(), 'yyyy-MM')"), (r"(?i)strftime\('%Y',\s*'now'\)", "date_format(current_date(), 'yyyy')"), (r"(?i)date\('now'\)", "current_date()"), (r"(?i)strftime\('%Y-%m',\s*((?:[^()]|\([^()]*\))*)\)", "date_format($1, 'yyyy-MM')"), (r"(?i)strftime\('%Y',\s*((?:[^()]|\([^()]*\))*)\)", "date_format($1, 'yyyy')"), (r"(?i)\bifnull\s*\(", "coalesce(")],
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def required_tables(question: Column | str, entities: dict[str, list[str]] = ENTITIES) -> Column:
    """The tables that whole words of a question stand for, in the order of ``entities``; none for null."""
    q = F.lower(F.coalesce(_col(question), F.lit("")))
    hits = [F.when(q.rlike(rf"(^|[^a-z0-9_])({'|'.join(map(re.escape, words))})($|[^a-z0-9_])"), F.lit(table)) for table, words in entities.items()]
    return F.array_compact(F.array(*hits))


def schema_sufficiency(questions: DataFrame, question_col: str, schema_col: str, entities: dict[str, list[str]] = ENTITIES) -> DataFrame:
    """Adds required_tables, missing_tables (those that the retrieved schema's text lacks) and sufficient."""
    out = questions.withColumn("required_tables", required_tables(question_col, entities))
    shown = F.lower(F.coalesce(F.col(schema_col), F.lit("")))
    out = out.withColumn("missing_tables", F.filter("required_tables", lambda t: ~F.contains(shown, t)))
    return out.withColumn("sufficient", F.size("missing_tables") == 0)


def statement_of(reply: Column | str) -> Column:
    """The statement in a model's reply: a JSON field ``sql`` (cut off or not), a fenced block, or what begins with
    SELECT or WITH; without thoughts and a last semicolon. Null where the reply declines or holds none."""
    raw = F.coalesce(_col(reply), F.lit(""))
    seen = F.trim(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    seen = F.trim(F.when(F.contains(seen, F.lit("</think>")), F.substring_index(seen, "</think>", -1)).otherwise(seen), F.lit(" \t\r\n"))
    bare = F.regexp_replace(F.regexp_replace(seen, r"^```(?i:json|sql)?\s*", ""), r"\s*```$", "")
    keyword = r"(?is)^\s*(select|with|show|describe|explain)\b.*"
    field = F.regexp_extract(seen, r'(?s)"sql"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    field = F.regexp_replace(F.regexp_replace(field, r"\\n", "\n"), r'\\(["\\/])', "$1")
    fenced = F.regexp_extract(seen, r"(?is)```(?:sql)?\s*(.*?)\s*(?:```|$)", 1)
    started = F.regexp_extract(seen, r"(?is)\b(select\b.*|with\s+\w+\s+as\b.*)", 1)
    found = F.coalesce(F.get_json_object(bare, "$.sql"), F.when(field.rlike(keyword), field), F.nullif(fenced, F.lit("")), F.nullif(started, F.lit("")))
    return F.when(seen.rlike(r"(?i)^\W*no_sql\b"), None).otherwise(F.regexp_replace(found, r"^\s+|[\s;]+$", ""))


def cardinality(sql: Column | str, rows: Column | str, max_rows: int = MAX_ROWS) -> Column:
    """'critical' for cross joins and joins without a condition, 'warning' above ``max_rows`` estimated rows, else 'info'."""
    text = F.upper(F.regexp_replace(F.coalesce(_col(sql), F.lit("")), r"'(?:[^'\\]|\\.|'')*'", "''"))
    joins = F.regexp_count(text, F.lit(r"\bJOIN\b"))
    conditions = F.regexp_count(text, F.lit(r"\b(ON|USING)\b|\bNATURAL\s+(LEFT\s+|RIGHT\s+|FULL\s+)?(OUTER\s+)?JOIN\b"))
    bad = text.rlike(r"\bCROSS\s+JOIN\b") | (joins > conditions)
    return F.when(bad, "critical").when(_col(rows) > max_rows, "warning").otherwise("info")


def estimated_rows(df: DataFrame) -> int | None:
    """The optimizer's row estimate of a plan; None where the tables have no statistics."""
    found = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(str(found.get())) if found.isDefined() else None


def check_cardinality(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS) -> str:
    """The class of one statement, by the optimizer's own estimate."""
    df = spark.sql(sql)
    row = spark.range(1).select(cardinality(F.lit(sql), F.lit(estimated_rows(df)).cast("long"), max_rows).alias("c"))
    return row.first()["c"]


def fuzzy_like(column: Column | str, term: str) -> Column:
    """``column ILIKE '%term%'``, where signs of the pattern in the term stand for themselves; true for an empty term."""
    return F.contains(F.lower(_col(column)), F.lower(F.lit(term)))


#: A place outside literals: an even number of quotes follows. Quotes in literals are doubled.
_OUTSIDE = r"(?=(?:[^']*+'[^']*+')*+[^']*+\z)"


def respell(sql: Column | str, dialect: str) -> Column:
    """Statements of another engine ('mysql', 'sqlite') with its date functions and a few others as Spark spells them; what
    stands in single quotes stays as it is."""
    out = _col(sql)
    for pattern, to in SPELLINGS[dialect]:
        out = F.regexp_replace(out, _OUTSIDE + pattern, to)
    return out
