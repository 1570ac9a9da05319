"""Writers: idempotent upserts, appends, payloads and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_SHOWN = 10


def _file_system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, vector_col: str | None = None, dim: int | None = None) -> None:
    """Rows of ``new`` replace those of the same key in a Parquet table.

    The new table is written beside the old one and takes its place by renaming, so a failed write leaves the
    old one whole and a repeated one changes nothing. Vectors of another length than ``dim`` raise."""
    if vector_col and dim:
        size = F.when(F.size(vector_col) == dim, F.col(vector_col)).otherwise(F.raise_error(F.lit(f"a vector's length isn't {dim}")))
        new = new.withColumn(vector_col, size)
    new = new.dropDuplicates([key])
    jvm = spark._jvm.org.apache.hadoop.fs
    old, fresh, gone = jvm.Path(path), jvm.Path(f"{path}.{uuid.uuid4().hex}"), jvm.Path(f"{path}.old-{uuid.uuid4().hex}")
    fs = _file_system(spark, old)
    if fs.exists(old):
        before = spark.read.parquet(path)
        new = before.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    new.write.parquet(fresh.toString())
    replaced = fs.exists(old)
    if replaced and not fs.rename(old, gone):
        fs.delete(fresh, True)
        raise OSError(f"{path} can't be moved away; it stays as it was")
    if not fs.rename(fresh, old):
        if replaced and not fs.rename(gone, old):
            raise OSError(f"the table is at {gone.toString()}, the new one at {fresh.toString()}: neither can be moved to {path}")
        fs.delete(fresh, True)
        raise OSError(f"the new table can't be moved to {path}; the old one stays")
    if replaced:
        fs.delete(gone, True)


def delete_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def set_active(chunks: DataFrame, ids: DataFrame, active: bool) -> DataFrame:
    """The ``active`` flag of all chunks of the documents in ``ids``."""
    hit = ids.select("document_id", F.lit(True).alias("hit")).distinct()
    return chunks.join(hit, "document_id", "left").withColumn("active", F.when(F.col("hit"), F.lit(active)).otherwise(F.col("active"))).drop("hit")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """(row) JSON objects: whole decimals as integers, other decimals as floats, bytes as text."""
    def clean(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("double").cast("string")).alias(name)
        return F.make_valid_utf8(c.cast("string")).alias(name) if kind == "binary" else c.alias(name)

    return df.select(F.to_json(F.struct(*[clean(c, k) for c, k in df.dtypes])).alias("row"))


def markdown(df: DataFrame, sql: str, shown: int = MAX_SHOWN, empty_aggregate: bool = False) -> str:
    """A result as a markdown table of at most ``shown`` rows, with a note on the rest."""
    head = f"SQL Query Executed: `{' '.join(sql.split())}`\n\n"
    rows = df.limit(shown + 1).collect()
    if not rows:
        return head + "_No matching records found in the database._"
    line = lambda cells: "| " + " | ".join(cells) + " |"
    out = head + "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(["NULL" if v is None else str(v) for v in r]) for r in rows[:shown])])
    if empty_aggregate:
        return out + "\n\n_Note: The query matched 0 records for aggregation, returning NULL._"
    return out + (f"\n\n_Showing {shown} of {df.count()} rows._" if len(rows) > shown else "")


def report(table: DataFrame, title: str) -> str:
    """A small aggregate (metrics, comparisons) as a markdown report of all its rows, streamed from one partition at a time."""
    rows = table.toLocalIterator()
    return "\n".join([f"# {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
