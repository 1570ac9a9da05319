"""One small local session for all tests, and DuckDB over the same tables."""

import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.local.dir", scratch).config("spark.checkpoint.dir", f"{scratch}/shared").config("spark.sql.warehouse.dir", f"{scratch}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(data)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


def plain(value):
    """Values of both engines in one form."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 5)
    return list(map(plain, value)) if hasattr(value, "__iter__") and not isinstance(value, str) else value


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, data):
    """Asserts that a query's rows are those of its SQL."""

    def check(query, sql):
        got = query(spark, data)
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        order = sorted(names)
        rows = lambda table, cols: sorted((tuple(str(plain(r[cols.index(c)])) for c in order) for r in table))
        assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)

    return check
