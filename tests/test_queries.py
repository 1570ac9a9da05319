"""Every registered query against its SQL, or at least to its end."""

import pytest

from tessera.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, same_as_sql, data, name):
    if name in ORACLE:
        same_as_sql(QUERIES[name], ORACLE[name])
    else:
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["c_custkey", "c_name", "sales_value", "orders"]


def test_only_the_removable_may_be_missing(monkeypatch):
    import importlib

    import __spark_entry__ as e

    def gone(name):
        raise ModuleNotFoundError("gone", name=name)

    def broken(name):
        raise ModuleNotFoundError("numpy is missing", name="numpy")

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE)
    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()
