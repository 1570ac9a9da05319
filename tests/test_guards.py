"""Guards of model replies, evaluation reports, dumps as tables, functions by name and replaced documents."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import registered
from tessera.operators import evaluation as E
from tessera.plans import guards as G
from tessera.sources import files, replacement


def test_statement_of(spark):
    cases = {
        "```\nSELECT 1;\n```": "SELECT 1",
        "```sql\nSELECT 2": "SELECT 2",
        "<think>SELECT no</think>with x as (select 1) select * from x;": "with x as (select 1) select * from x",
        "thoughts</think> SELECT 3": "SELECT 3",
        '{"sql": "SELECT \\"a\\"\\nFROM t"}': 'SELECT "a"\nFROM t',
        '{"sql": "SELECT \\"a\\" FRO': 'SELECT "a" FRO',
        "no_sql": None,
        "Sorry.": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply string").select("reply", G.statement_of("reply").alias("s"))
    assert {r["reply"]: r["s"] for r in df.collect()} == cases


def test_cardinality(spark):
    spark.range(50).createOrReplaceTempView("fifty")
    assert G.check_cardinality(spark, "SELECT * FROM fifty CROSS JOIN fifty b") == "critical"
    assert G.check_cardinality(spark, "SELECT * FROM fifty", 10) == "warning"
    assert G.check_cardinality(spark, "SELECT * FROM fifty") == "info"
    assert spark.range(1).select(G.cardinality(F.lit(None).cast("string"), F.lit(None).cast("long")).alias("c")).first()["c"] == "info"


def test_sufficiency_default_words(spark):
    df = spark.createDataFrame([("Orders of a vendor", "sales_order(id, vendor)"), (None, None), ("reorder", "")], "q string, s string")
    got = [(r["required_tables"], r["sufficient"]) for r in G.schema_sufficiency(df, "q", "s").collect()]
    assert got == [(["sales_order", "party"], False), ([], True), ([], True)]


def test_fuzzy(spark):
    df = spark.createDataFrame([("100% Wool",), ("1000 wool",), (None,)], "n string")
    assert [r["n"] for r in df.filter(G.fuzzy_like("n", "0% w")).collect()] == ["100% Wool"]


def test_respell_runs(spark):
    for dialect, sql in [("mysql", "SELECT DATE_FORMAT(CURDATE(), '%Y-%m') AS m, IFNULL(NULL, 2) AS n, CURDATE() - INTERVAL 1 MONTH AS d"), ("sqlite", "SELECT strftime('%Y-%m', 'now') AS m, ifnull(NULL, 2) AS n, date('now', '-7 days') AS d, date('now','-1 month') AS e, strftime('%Y', date('now')) AS y")]:
        new = spark.createDataFrame([(sql,)], "s string").select(G.respell("s", dialect).alias("s")).first()["s"]
        row = spark.sql(new).first()
        assert len(row["m"]) == 7 and row["n"] == 2 and row["d"] is not None


def test_respell_keeps_literals(spark):
    sql = "SELECT 'ifnull(x), curdate()' AS a, IFNULL('it''s ifnull(y)', 'ifnull(' ) AS b, 'n' AS c" + ", 'q'" * 3000
    got = spark.createDataFrame([(sql,)], "s string").select(G.respell("s", "mysql").alias("s")).first()["s"]
    assert got == sql.replace("IFNULL(", "coalesce(")


def test_pass_rates(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("a", False), (None, True)], "c string, p boolean")
    got = {r["category"]: (r["total"], r["passed"], r["failed"], r["pass_rate"]) for r in E.pass_rates(df, "c", F.col("p")).collect()}
    assert got == {"a": (3, 1, 2, 33.3), "unknown": (1, 1, 0, 100.0), None: (4, 2, 2, 50.0)}
    assert [tuple(r) for r in E.pass_rates(df.filter("false"), "c", F.col("p")).collect()] == [(None, 0, 0, 0, 0.0)]


def test_bank_coverage_empty(spark):
    bank = spark.createDataFrame([], "id string, tables array<string>, route string")
    schema = spark.createDataFrame([("t",)], "table_name string")
    assert sorted(map(tuple, E.bank_coverage(bank, schema, ["route"]).collect()), key=str) == [("questions", None, 0), ("referenced", None, 0), ("tables", None, 1), ("unreferenced", "t", 0)]


def test_load_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("SET x = 1;\nINSERT INTO t VALUES (1,'a, ''b'';\nc',2.5),(2,NULL,NULL),(3,'','x'),(4,'y');\nINSERT INTO t VALUES (5,'it\\'s\\n',1);\n")
    rows, errors = files.load_dump(files.read_dump(spark, str(tmp_path / "d.sql")), "T", {"id": "int", "name": "string", "rate": "double"})
    assert sorted(map(tuple, rows.collect())) == [(1, "a, 'b';\nc", 2.5), (2, None, None), (5, "it's\n", 1.0)]
    assert sorted(map(tuple, errors.collect())) == [("number of values", 1), ("type of rate", 1)]


def test_functions_by_name(spark):
    registered.register(spark)
    registered.register(spark)
    row = spark.sql("SELECT vector_cosine(array(1D, 0D), array(1D, 0D)) AS one, vector_cosine(array(0D), array(1D)) AS zero, vector_cosine(NULL, array(1D)) AS none, text_jaccard(array('a', 'b'), array('b', 'c')) AS j, text_tokens('') AS t, text_tokens(NULL) AS n").first()
    assert (row["one"], row["zero"], row["none"], round(row["j"], 4), row["t"], row["n"]) == (1.0, 0.0, None, 0.3333, 1, None)


@pytest.fixture
def store(spark, tmp_path):
    chunks, registry = str(tmp_path / "chunks"), str(tmp_path / "registry")
    spark.createDataFrame([("c1", "old", True), ("c2", "other", True)], "chunk_id string, document_id string, active boolean").write.parquet(chunks)
    spark.createDataFrame([(d, f"hash-{d}", "u", "m", 1, None, None, True, d) for d in ("old", "other")], "document_id string, content_hash string, user_id string, embedding_model string, created_at long, supersedes string, superseded_by string, active boolean, lineage_root string").write.parquet(registry)
    return chunks, registry


def test_replace(spark, store):
    new = spark.createDataFrame([("c9", "new", True)], "chunk_id string, document_id string, active boolean")
    version = spark.createDataFrame([("new", "hash-new", "u", "m", 2)], "document_id string, content_hash string, user_id string, embedding_model string, created_at long")
    assert replacement.replace(spark, *store, "old", new.filter("false"), version) == "empty"
    assert replacement.replace(spark, *store, "old", new, version.withColumn("content_hash", F.lit("hash-other"))) == "unchanged"
    for want in ("replaced", "unchanged"):
        assert replacement.replace(spark, *store, "old", new, version) == want
        assert {r["chunk_id"]: r["active"] for r in spark.read.parquet(store[0]).collect()} == {"c1": False, "c2": True, "c9": True}
        found = {r["document_id"]: (r["active"], r["supersedes"], r["superseded_by"], r["lineage_root"]) for r in spark.read.parquet(store[1]).collect()}
        assert found == {"old": (False, None, "new", "old"), "other": (True, None, None, "other"), "new": (True, "old", None, "old")}
    with pytest.raises(ValueError):
        replacement.replace(spark, *store, "gone", new, version)


@pytest.mark.parametrize("written", [1, 2, 3])
def test_replace_goes_on_after_a_failure(spark, store, monkeypatch, written):
    """Whatever write is the last one, some version is active, and running it again completes the replacement."""
    new = spark.createDataFrame([("c9", "new", True)], "chunk_id string, document_id string, active boolean")
    version = spark.createDataFrame([("new", "hash-new", "u", "m", 2)], "document_id string, content_hash string, user_id string, embedding_model string, created_at long")
    calls, real = [], replacement.upsert

    def failing(*args):
        if len(calls) == written:
            raise OSError("lost")
        calls.append(1)
        real(*args)

    with monkeypatch.context() as m:
        m.setattr(replacement, "upsert", failing)
        with pytest.raises(OSError):
            replacement.replace(spark, *store, "old", new, version)
    assert spark.read.parquet(store[1]).filter("active and document_id in ('old', 'new')").count() >= 1
    assert spark.read.parquet(store[0]).filter("active and document_id in ('old', 'new')").count() >= 1
    assert replacement.replace(spark, *store, "old", new, version) == "replaced"
    assert spark.read.parquet(store[1]).filter("active and document_id in ('old', 'new')").count() == 1


def test_verdicts_of_a_log(spark):
    from tessera.plans import governance as G

    spark.range(3).createOrReplaceTempView("numbers")
    statements = ["SELECT id FROM numbers WHERE id = 1", "SELECT id FROM numbers WHERE id = 22", "SELECT id FROM numbers WHERE 'a''b' = 'it'", "SELECT `reflect`('java.lang.System', 'x') FROM numbers", "SELECT * FROM IDENTIFIER('numbers')", "DROP TABLE numbers", None, ""]
    log = spark.createDataFrame(list(enumerate(statements)), "k int, sql string")
    got = {r["k"]: (r["ok"], r["warnings"]) for r in G.verdicts(log, ["numbers"]).collect()}
    assert got == {0: (True, ""), 1: (True, ""), 2: (True, ""), 3: (False, ""), 4: (False, ""), 5: (False, ""), 6: (False, ""), 7: (False, "")}
    shapes = [r[0] for r in log.limit(3).select(G.shape(F.col("sql"))).collect()]
    assert shapes == ["SELECT id FROM numbers WHERE id = 0", "SELECT id FROM numbers WHERE id = 0", "SELECT id FROM numbers WHERE '?' = '?'"]
    with pytest.raises(ValueError):
        G.verdicts(log, ["numbers"], most=2)
    assert G.verdicts(log.limit(0), ["numbers"]).count() == 0


# Errors, their failure categories and telemetry types.
ERROR_CASES = [
    ("Unknown column 'x' in field list", "invalid_column", "sql_validation_error"), ("no such table: foo", "invalid_table", "db_execution_error"), ("429 rate limit", "rate_limit_error", "rate_limit_error"), ("request timed out", "timeout", "timeout_error"),
    ("syntax error near SELECT", "sql_syntax_error", "sql_generation_error"), ("read-only violation: DROP TABLE x", "unsafe_sql_operation", "unknown_error"), ("no rows", "empty_result", "unknown_error"), ("access denied for user", "permission_error", "permission_error"), (None, "unknown", "unknown_error"),
]


def test_error_classes(spark):
    from tessera.functions import classify as C

    got = spark.createDataFrame([(e,) for e, _, _ in ERROR_CASES], "e string").select("e", C.failure_category("e"), C.telemetry_failure("e")).collect()
    assert list(map(tuple, got)) == ERROR_CASES
