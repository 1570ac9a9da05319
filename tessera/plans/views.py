"""Governed views: soft deletes and tenancy are filters of views, so that no statement can leave them out.

An outer join to a filtered view keeps its left rows, where a predicate added to WHERE would drop them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def active(df: DataFrame, intent: str, column: str = "deleted_at") -> DataFrame:
    """Rows by soft-delete intent; tables without the column have only active rows."""
    if column not in df.columns:
        return df
    if intent == "DELETED_ONLY":
        return df.filter(F.col(column).isNotNull())
    return df if intent == "INCLUDE_ARCHIVED" else df.filter(F.col(column).isNull())


def visible(df: DataFrame, tenant: str | None, column: str = "user_id") -> DataFrame:
    """A tenant's own and shared rows; all rows for '*' and 'all'."""
    if column not in df.columns or tenant in ("*", "all"):
        return df
    shared = F.col(column).isNull() | F.col(column).isin("system", "shared")
    return df.filter(shared if tenant is None else shared | (F.col(column) == tenant))


def register(frames: Mapping[str, DataFrame], intent: str = "ACTIVE_ONLY", tenant: str | None = "*", derived: Mapping[str, Column] | None = None) -> list[str]:
    """Temporary views of the frames; ``derived`` gives the deletion time of tables that don't store one."""
    for name, df in frames.items():
        if derived and name in derived:
            df = df.withColumn("deleted_at", derived[name])
        visible(active(df, intent), tenant).createOrReplaceTempView(name)
    return list(frames)
