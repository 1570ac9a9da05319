"""The schema as data: columns, foreign keys, join paths, drift, enumerations and compact descriptions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import word_runs
from ..session import beside

AUDIT = ("created_id", "updated_id", "deleted_id")
# How column prefixes of this star schema name the tables they point to.
KEYS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]
TYPE_CLASSES = "CASE WHEN type RLIKE '^(tinyint|smallint|int|bigint)' THEN 'int' WHEN type RLIKE '^(decimal|double|float)' THEN 'decimal' WHEN type = 'boolean' THEN 'bool' WHEN type RLIKE '^(timestamp|date)' THEN 'datetime' WHEN type RLIKE '^(array|map|struct|variant)' THEN 'json' ELSE 'varchar' END"


def relationships(spark: SparkSession, rows=KEYS) -> DataFrame:
    """(from_table, from_column, to_table, to_column): complete rows only, each once."""
    df = spark.createDataFrame(list(rows), "from_table string, from_column string, to_table string, to_column string")
    return df.dropna().dropDuplicates()


def columns(frames: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(table, column, type, position) of a set of tables."""
    rows = [(t, c, k, i) for t, df in frames.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "`table` string, `column` string, type string, position int")


def infer_keys(cols: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Links from columns named ``<table>_id``, with aliases (prefix, table) for irregular names."""
    own = cols.filter(F.col("column").endswith("_id") & (F.col("column") != "id")).select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), F.regexp_replace("column", "_id$", "").alias("prefix"))
    if aliases is not None:
        own = own.join(F.broadcast(aliases.select("prefix", F.col("table").alias("alias"))), "prefix", "left").withColumn("prefix", F.coalesce("alias", "prefix")).drop("alias")
    names = cols.select(F.col("table").alias("to_table")).distinct()
    return own.join(names, own.prefix == names.to_table).select("from_table", "from_column", "to_table", F.lit("id").alias("to_column"))


def without_audit(rel: DataFrame) -> DataFrame:
    return rel.filter(~((F.col("to_table") == "users") & F.lower("from_column").isin(*AUDIT)))


def both_ways(rel: DataFrame) -> DataFrame:
    return rel.select(F.col("from_table").alias("a"), F.col("to_table").alias("b")).union(rel.select("to_table", "from_table")).distinct()


def neighbours(rel: DataFrame, active: DataFrame) -> DataFrame:
    """(table) next to an active one (table), in either direction."""
    return both_ways(without_audit(rel)).join(active, F.col("a") == active["table"]).select(F.col("b").alias("table")).distinct()


def rank_neighbours(rel: DataFrame, active: DataFrame, k: int = 4) -> DataFrame:
    """The k tables outside the active set with most links into it."""
    ends = without_audit(rel).select(F.col("from_table").alias("a"), F.col("to_table").alias("b"))
    links = ends.union(ends.select("b", "a"))
    near = links.join(active, F.col("a") == active["table"]).select("b").join(active, F.col("b") == active["table"], "left_anti")
    return near.groupBy(F.col("b").alias("table")).agg(F.count("*").alias("links")).orderBy(F.desc("links"), "table").limit(k)


def scoped_relationships(rel: DataFrame, active: DataFrame, with_audit: bool = False) -> DataFrame:
    """(from_table, edges): links between active tables, as text."""
    rel = rel if with_audit else without_audit(rel)
    one, two = active.select(F.col("table").alias("from_table")), active.select(F.col("table").alias("to_table"))
    inside = rel.join(one, "from_table", "left_semi").join(two, "to_table", "left_semi")
    edge = F.concat(F.col("from_column"), F.lit("->"), F.col("to_table"), F.lit("."), F.col("to_column"))
    return inside.groupBy("from_table").agg(F.array_join(F.array_sort(F.collect_list(edge)), ", ").alias("edges"))


def join_path(rel: DataFrame, a: str, b: str) -> DataFrame:
    """The direct links of two tables, in either direction."""
    return rel.filter(((F.col("from_table") == a) & (F.col("to_table") == b)) | ((F.col("from_table") == b) & (F.col("to_table") == a)))


def invalid_joins(rel: DataFrame, paths: DataFrame) -> DataFrame:
    """(path_id, a, b): neighbours in a join path (path_id, tables array) that no link connects."""
    pairs = paths.select("path_id", F.explode(F.expr("if(size(tables) > 1, transform(sequence(1, size(tables) - 1), i -> struct(tables[i - 1] as a, tables[i] as b)), array())")).alias("p")).select("path_id", "p.a", "p.b")
    return pairs.join(both_ways(rel), ["a", "b"], "left_anti")


def reachable(spark: SparkSession, rel: DataFrame, start: str) -> DataFrame:
    """(table, hops) of all tables connected with ``start``. The links are read once: they are as many as pairs of tables."""
    near: dict[str, set[str]] = {}
    for a, b in both_ways(rel).collect():
        near.setdefault(a, set()).add(b)
    hops, edge = {start: 0}, [start]
    while edge:
        edge = sorted({b for a in edge for b in near.get(a, ())} - set(hops))
        hops |= dict.fromkeys(edge, max(hops.values()) + 1)
    return spark.createDataFrame(list(hops.items()), "`table` string, hops int")


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(drift_type, table, column, expected, actual, severity, healed) between two column lists.

    Additions heal by themselves; losses and changed types don't."""
    e = expected.select("table", "column", F.col("type").alias("expected"))
    a = actual.select("table", "column", F.col("type").alias("actual"))
    tables = e.select("table").distinct().withColumn("was", F.lit(True)).join(a.select("table").distinct().withColumn("is", F.lit(True)), "table", "full")
    gone = tables.filter("was is null or is is null").select(F.when(F.col("was").isNull(), "new_table").otherwise("deleted_table").alias("drift_type"), "table", F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    stay = tables.filter("was and is").select("table")
    cols = e.join(a, ["table", "column"], "full").join(stay, "table", "left_semi").filter("not (expected <=> actual)")
    kind = F.when(F.col("expected").isNull(), "new_column").when(F.col("actual").isNull(), "missing_column").otherwise("type_mismatch")
    both = gone.unionByName(cols.select(kind.alias("drift_type"), "table", "column", "expected", "actual"))
    severity = F.when(F.col("drift_type").isin("deleted_table", "missing_column"), "critical").when(F.col("drift_type") == "new_column", "info").otherwise("warning")
    return both.withColumns({"severity": severity, "healed": F.col("drift_type").isin("new_table", "new_column")})


def glossary_drift(glossary: DataFrame, cols: DataFrame) -> DataFrame:
    """Glossary rows (term, maps_to 'table.column') that point to nothing."""
    known = cols.select(F.concat_ws(".", "table", "column").alias("maps_to"))
    return glossary.join(known, "maps_to", "left_anti")


def relationship_drift(rel: DataFrame, cols: DataFrame) -> DataFrame:
    """Relationships of which an end doesn't exist."""
    known = cols.select("table", "column")
    one = rel.join(known, (F.col("from_table") == known["table"]) & (F.col("from_column") == known["column"]), "left_anti")
    two = rel.join(known, (F.col("to_table") == known["table"]) & (F.col("to_column") == known["column"]), "left_anti")
    return one.union(two).distinct()


def enumerations(df: DataFrame, names: list[str], most: int = 20) -> DataFrame:
    """(column, value, n) of the columns with at most ``most`` distinct values.

    All columns are counted in one pass; high-cardinality ones are set aside by their number of groups."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*").filter("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column").agg(F.count("*").alias("distinct_values")).filter(F.col("distinct_values") <= most)
    return counts.join(few, "column").select("column", "value", "n")


def compact(cols: DataFrame, audit: list[str] = ["created_at", "updated_at", "created_id", "updated_id", "deleted_id", "remember_token", "password"]) -> DataFrame:
    """(table, description): 'table: column(type), ...' without audit columns."""
    kept = cols.filter(~F.col("column").isin(audit)).withColumn("class", F.expr(TYPE_CLASSES))
    item = F.struct("position", F.concat("column", F.lit("("), "class", F.lit(")")).alias("text"))
    return kept.groupBy("table").agg(F.array_sort(F.collect_list(item)).alias("items")).select("table", F.concat("table", F.lit(": "), F.array_join(F.transform("items", lambda x: x["text"]), ", ")).alias("description"))


def match_glossary(questions: DataFrame, glossary: DataFrame, most: int = 15) -> DataFrame:
    """(question_id, concept) of the concepts whose synonym, of one to three words, occurs in a question; plurals count.

    Word runs of questions meet synonyms by an equi-join; the glossary goes to the questions."""
    stem = lambda w: F.regexp_replace(F.regexp_replace(w, "ies$", "y"), "(?<=[^s])s$", "")
    q = F.transform(F.regexp_extract_all(F.lower("question"), F.lit("([a-z0-9]+)"), 1), stem)
    own = questions.select("question_id", F.explode(F.array_distinct(word_runs(q, (1, 2, 3)))).alias("phrase"))
    words = glossary.select("concept", F.explode(F.array_append("synonyms", F.col("concept"))).alias("s")).select("concept", F.array_join(F.transform(F.regexp_extract_all(F.lower("s"), F.lit("([a-z0-9]+)"), 1), stem), " ").alias("phrase")).distinct()
    hits = own.join(beside(words), "phrase").select("question_id", "concept", F.length("phrase").alias("n")).groupBy("question_id", "concept").agg(F.max("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n"), "concept"))
    return hits.withColumn("place", place).filter(F.col("place") <= most).drop("n")
