"""How queries are registered: a name, a function of (spark, sf_dir), and the same in DuckDB's SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, *tables: str):
        """Decorates a function of the named tables; without names it gets (spark, sf_dir)."""

        def put(f):
            if tables:
                self.queries[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
            else:
                self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put
