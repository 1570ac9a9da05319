"""Keys and the links between tables, found in the rows themselves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

WHOLE = {"tinyint", "smallint", "int", "bigint"}


def stem(column: str) -> str:
    """A column's name without the letter of its table: ``o_custkey`` and ``c_custkey`` share ``custkey``."""
    return re.sub(r"^[a-z]_", "", column.lower())


def candidates(frames: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, stem) of the whole-number columns whose stem more than one table has."""
    found = [(t, c, stem(c)) for t, df in frames.items() for c, kind in df.dtypes if kind in WHOLE]
    tables = Counter(s for s, _ in {(s, t) for t, _, s in found})
    return [x for x in found if tables[x[2]] > 1]


def discover(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(from_table, from_column, to_table, to_column, distinct_values): links that names suggest and all rows bear out.

    The column linked to has no value twice, and all values of the other column, nulls aside, occur in it. Each table is
    read once; a value of a stem meets its columns in one row, so a hot value is summed up before it is shuffled and what
    is compared afterwards are counts of pairs of columns, however many rows there are. A column without values links to
    nothing; with no candidates, or only empty tables, there are no links."""
    per: dict[str, list[tuple[str, str]]] = {}
    for t, c, s in candidates(frames):
        per.setdefault(t, []).append((c, s))
    if not per:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], "from_table string, from_column string, to_table string, to_column string, distinct_values long")
    longs = None
    for t, cols in per.items():
        cells = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"), F.lit(s).alias("stem"), F.col(c).cast("long").alias("value")) for c, s in cols])
        one = frames[t].select(F.explode(cells).alias("x")).select("x.*").filter("value is not null")
        longs = one if longs is None else longs.unionByName(one)
    values = longs.groupBy("stem", "value", "table", "column").agg(F.count("*").alias("n"))
    met = values.groupBy("stem", "value").agg(F.collect_list(F.struct("table", "column", (F.col("n") > 1).alias("twice"))).alias("at"))
    pairs = met.select("stem", F.explode("at").alias("f"), "at").select("stem", "f", F.explode("at").alias("t"))
    sums = pairs.groupBy("stem", F.col("f.table").alias("from_table"), F.col("f.column").alias("from_column"), F.col("t.table").alias("to_table"), F.col("t.column").alias("to_column")).agg(
        F.count("*").alias("both"), F.max("t.twice").alias("to_twice"))
    own = (F.col("from_table") == F.col("to_table")) & (F.col("from_column") == F.col("to_column"))
    whole = sums.filter(own).select(F.col("from_table").alias("table"), F.col("from_column").alias("column"), F.col("both").alias("values"), F.col("to_twice").alias("repeats"))
    ends = whole.select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), F.col("values").alias("distinct_values"))
    keys = whole.filter("not repeats").select(F.col("table").alias("to_table"), F.col("column").alias("to_column"))
    linked = sums.filter("from_table <> to_table").join(ends, ["from_table", "from_column"]).join(keys, ["to_table", "to_column"]).filter("both = distinct_values")
    return linked.select("from_table", "from_column", "to_table", "to_column", "distinct_values")
