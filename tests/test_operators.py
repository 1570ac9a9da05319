"""Ranking, versions, catalog, analytics, governance and citations on small cases."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics as A, catalog as C, citations, ranking as K, registry as V
from tessera.plans import governance as G, semantic, views
from tessera.session import table


def test_budget(spark):
    got = spark.range(1).select(K.fill_budget(F.expr("array(50, 30, 90, 20)"), 100).alias("t"), K.fill_budget(F.expr("array(500, 1)"), 100).alias("u")).first()
    assert got["t"] == [True, True, False, True] and got["u"] == [True, False]


def test_context(spark):
    df = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([30, 300, 3])], "q int, o int, text string")
    assert [r["o"] for r in K.pack_context(df, 20, "q", "o", "text").collect()] == [0]
    assert [r["o"] for r in K.pack_context(df, 5, "q", "o", "text").collect()] == [0]
    assert K.limit_context(df, None, "q", "o").count() == 3 and K.limit_context(df, 1, "q", "o").count() == 2


def test_diversity_single_document(spark):
    df = spark.createDataFrame([(1, "d", float(k), k) for k in range(9)], "q int, doc string, score double, id int")
    assert sorted(r["id"] for r in K.diversify(df, 4, "q", "doc", "score", "id").collect()) == [5, 6, 7, 8]


def test_cache_scope(spark):
    vec = [1.0, 0.0]
    lookups = spark.createDataFrame([(1, "a", "LIST", 100, vec), (2, None, "LIST", 100, vec), (3, "b", "LIST", 100, vec)], "lookup_id int, scope string, kind string, at long, embedding array<double>")
    cache = spark.createDataFrame([(10, "a", "LIST", 50, 60, vec, True), (11, None, "LIST", 50, 60, vec, True), (12, "b", "LIST", 10, 60, vec, True), (13, "a", "LIST", 60, 60, vec, False)], "cached_id int, scope string, kind string, stored_at long, ttl long, embedding array<double>, safe boolean")
    assert {r["lookup_id"]: r["cached_id"] for r in K.semantic_cache(lookups, cache).collect()} == {1: 10, 2: None, 3: None}


def test_too_many_queries(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_QUERIES", 1)
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "query_id int, embedding array<double>")
    with pytest.raises(ValueError):
        K.dense_top_k_each(df.withColumnRenamed("query_id", "id"), df, 1, "id")


def test_version_states(spark):
    files = spark.createDataFrame([("a", "f", "h1", "u", "m", 1), ("b", "f", "h2", "u", "m", 2), ("c", "f", "h3", "u", "m", 3), ("x", "f", "h1", "v", "m", 1)], "document_id string, name string, content_hash string, user_id string, embedding_model string, created_at long")
    reg = V.build_versions(files).select(V.COLUMNS)
    state = lambda df: {r["document_id"]: (r["active"], r["supersedes"], r["superseded_by"]) for r in df.collect()}
    assert state(reg) == {"a": (False, None, "b"), "b": (False, "a", "c"), "c": (True, "b", None), "x": (True, None, None)}
    back = V.unregister(reg, reg.filter("document_id = 'c'"))
    assert state(back) == {"a": (False, None, "b"), "b": (True, "a", None), "x": (True, None, None)}
    fresh = reg.unionByName(spark.createDataFrame([("d", "h4", "u", "m", 4, None, None, True, "d")], reg.schema))
    new = V.supersede(fresh, spark.createDataFrame([("c", "d")], "old_id string, new_id string"))
    assert state(new)["c"] == (False, "b", "d") and state(new)["d"] == (True, "c", None)
    assert {r["lineage_root"] for r in new.filter("user_id = 'u'").collect()} == {"a"}
    incoming = spark.createDataFrame([("h3", "u"), ("h1", "u"), ("h1", "v")], "content_hash string, user_id string")
    assert {(r["content_hash"], r["user_id"]): r["status"] for r in V.status(incoming, reg, "m").collect()} == {("h3", "u"): "ALREADY_INGESTED", ("h1", "u"): "NEW", ("h1", "v"): "ALREADY_INGESTED"}
    assert {r["status"] for r in V.status(incoming.filter("user_id = 'v'"), reg, "other").collect()} == {"STALE_EMBEDDING"}
    legacy = spark.createDataFrame([("h", "d", 1), ("h", "d", 1)], "content_hash string, document_id string, created_at long")
    once = V.migrate(legacy)
    assert once.count() == 1 and V.migrate(once).collect() == once.collect()
    assert V.upsert(once, once, "document_id").count() == 1


def test_catalog(spark):
    rel = C.relationships(spark, [("a", "b_id", "b", "id"), ("a", "b_id", "b", "id"), ("a", None, "b", "id"), ("a", "created_id", "users", "id"), ("b", "c_id", "c", "id")])
    assert rel.count() == 3
    active = spark.createDataFrame([("a",)], "`table` string")
    assert {r["table"] for r in C.neighbours(rel, active).collect()} == {"b"}
    assert {(r["table"], r["hops"]) for r in C.reachable(spark, rel, "a").collect()} == {("a", 0), ("b", 1), ("users", 1), ("c", 2)}
    assert C.join_path(rel, "c", "b").count() == 1
    cols = spark.createDataFrame([("a", "b_id"), ("b", "id"), ("b", "c_id")], "`table` string, `column` string")
    assert {r["to_table"] for r in C.relationship_drift(rel, cols).collect()} == {"users", "c"}


def test_analytics_of_nothing(spark):
    events = spark.createDataFrame([], "query_id string, seq long, stage string, input_tokens long, output_tokens long, latency_ms double, success boolean, failure_type string, rows_returned int")
    assert A.baseline(A.per_query(events)).first()["total_queries"] == 0
    traces = spark.createDataFrame([], "status string, total_latency_ms double, retry_count int, retry_improved boolean")
    assert A.overview(traces).first()["success_rate"] == 100.0


def test_rollup_values(spark):
    rows = [("q1", 1, "sql_generation", 100, 50, 10.0, True, None, None), ("q1", 2, "final_response", 0, 0, 99.0, True, None, None), ("q2", 1, "sql_execution", 0, 0, 5.0, False, "rate_limit_error", None), ("q2", 2, "final_response", 0, 0, 7.0, True, None, None), ("q3", 1, "sql_execution", 0, 0, 5.0, True, None, 0), ("q3", 2, "synthesis", 10, None, None, True, None, None)]
    events = spark.createDataFrame(rows, "query_id string, seq long, stage string, input_tokens long, output_tokens long, latency_ms double, success boolean, failure_type string, rows_returned int")
    got = {r["query_id"]: r for r in A.per_query(events).collect()}
    assert (got["q1"]["tokens"], got["q1"]["failed"], got["q1"]["latency_ms"]) == (150, False, 99.0)
    assert (got["q2"]["failed"], got["q2"]["failure_type"]) == (True, "rate_limit_error")
    assert (got["q3"]["empty_result"], got["q3"]["latency_ms"], got["q3"]["tokens"]) == (True, 5.0, 10)
    base = A.baseline(A.per_query(events)).first()
    assert (base["successful"], base["success_rate"], base["empty_results"]) == (2, 66.67, 1)


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 31)] + [("b", 5.0)], "g string, v double")
    near = {r["g"]: r["percentile"] for r in A.percentile_nearest(df, "v", 0.95, ["g"]).collect()}
    assert near == {"a": 29.0, "b": 5.0}
    import statistics

    excl = {r["g"]: r["percentile"] for r in A.percentile_exclusive(df, "v", 0.95, ["g"]).collect()}
    assert abs(excl["a"] - statistics.quantiles(range(1, 31), n=20)[18]) < 1e-9 and excl["b"] == 5.0


def test_ab_normal_tail(spark):
    from math import erfc, sqrt

    rows = [("control", k < 40) for k in range(100)] + [("b", k < 55) for k in range(100)]
    got = {r["variant"]: r for r in A.ab_test(spark.createDataFrame(rows, "variant string, won boolean"), "variant", F.col("won"), "control").collect()}
    z = got["b"]["z"]
    assert abs(got["b"]["p_normal"] - erfc(z / sqrt(2))) < 2e-4 and got["b"]["significant"] and got["control"]["z"] is None


@pytest.fixture(scope="module")
def tables_(spark, data):
    frames = {t: table(spark, data, t) for t in ("nation", "region", "orders", "customer", "lineitem", "supplier", "part")}
    views.register(frames)
    return frames


@pytest.mark.parametrize(("sql", "ok", "warning"), [
    ("SELECT n_name FROM nation", True, None), ("SELECT n_name FROM nation;", True, None), ("select * from nation", True, "selects all columns"), ("SELECT count(*) FROM nation, region", True, "cartesian product"),
    ("DROP TABLE nation", False, None), ("SELECT 1; SELECT 2", False, None), ("SELECT sleep(1)", False, None), ("SELECT java_method('java.lang.Math', 'random')", False, None), ("SELECT * FROM parquet.`/etc`", False, None),
    ("WITH nation AS (SELECT 1 AS x) SELECT x FROM nation", False, None), ("WITH n AS (SELECT n_name FROM nation) SELECT n_name FROM n", True, None), ("SELECT missing FROM nation", False, None), ("SELECT n_name FROM secret", False, None),
    ("SELECT * FROM xml.`/etc/hosts`", False, None), ("SELECT * FROM image.`/etc`", False, None), ("SELECT n_name FROM nation, libsvm.`/etc/hosts`", False, None), ("SELECT n_name FROM nation WHERE n_name IN (SELECT value FROM text.x)", False, None),
    ("/* c */ SELECT n_name FROM nation -- d", True, None), ('SELECT "sleep(1)" AS x FROM nation', True, None), ("SELECT n.`n_name` FROM nation n", True, None),
    ("INSERT INTO nation SELECT * FROM nation", False, None), ("SELECT n_name FROM nation WHERE n_name = NULL", True, "compares with NULL"), ("SELECT n_name FROM nation WHERE n_name = 'drop table sleep('", True, None), ("", False, None), ("SELECT n_name FROM nation UNION SELECT r_name FROM region", True, None),
])
def test_checks(spark, tables_, sql, ok, warning):
    v = G.check(spark, sql, list(tables_))
    assert v.ok is ok, v
    assert warning is None or warning in v.warnings


@pytest.mark.parametrize("kind", ["xml", "image", "libsvm", "text", "anything"])
def test_files_are_no_tables(spark, tables_, kind):
    assert not G.check(spark, f"SELECT * FROM {kind}.`/etc/hosts`").ok
    assert G.check(spark, "SELECT n_name FROM nation").ok


def test_text_in_sums(spark, tables_):
    assert G.text_sums(spark, tables_, "SELECT sum(n_name * 2) FROM nation -- sum(r_name)") == ["n_name"]


def test_first_rows_of_outliers(spark):
    df = spark.createDataFrame([(k, 1.0 if k < 100 else 10_000.0) for k in range(200)], "k int, v double").repartition(7)
    assert not A.outliers(df, ["v"], ["k"]).first()["has_outlier"] and A.outliers(df, ["v"], ["k"], rows=101).first()["has_outlier"]


def test_run(spark, tables_):
    assert G.run(spark, "SELECT n_name FROM nation, region", list(tables_)).count() == 100
    assert G.run(spark, "SELECT o_orderkey FROM orders", list(tables_)).count() == 500
    with pytest.raises(PermissionError):
        G.run(spark, "DROP TABLE nation", list(tables_))
    assert G.misleading_aliases("SELECT o_totalprice AS profit FROM orders", "what is the profit", ["o_totalprice"]) == ["profit"]
    assert G.text_sums(spark, tables_, "SELECT sum(n_name) FROM nation") == ["n_name"]
    assert G.zero_row_aggregate({"a": None}, "SELECT sum(x) AS a FROM t") and not G.zero_row_aggregate({"a": None}, "SELECT max(x) FROM t GROUP BY y")


def test_view_keeps_left_rows(spark, tables_):
    """A filtered view keeps customers whose orders are all deleted; a predicate in WHERE would lose them."""
    orders = tables_["orders"].withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    join = lambda o: tables_["customer"].join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    assert join(views.active(orders, "ACTIVE_ONLY")).select("c_custkey").distinct().count() == tables_["customer"].count()
    assert join(orders).filter("deleted_at is null").select("c_custkey").distinct().count() <= tables_["customer"].count()
    assert views.active(orders, "DELETED_ONLY").filter("o_orderstatus <> 'F'").isEmpty()
    shared = spark.createDataFrame([("a",), ("b",), (None,), ("system",)], "user_id string")
    assert views.visible(shared, "a").count() == 3 and views.visible(shared, "*").count() == 4


def test_temporal_guard(spark):
    df = spark.createDataFrame([("orders last month", "SELECT 1 FROM o WHERE o_orderdate >= '2024-01-01'"), ("orders last month", "SELECT 1 FROM o"), ("orders", "SELECT 1 FROM o")], "q string, s string")
    assert [r["g"] for r in df.select(G.temporal_guard("q", "s").alias("g")).collect()] == [True, False, True]


def test_semantic(spark, tables_):
    i = spark.range(1).select(semantic.intent(F.lit("top 3 suppliers by quantity of open orders last year")).alias("i")).first()["i"]
    assert (i["metric"], i["dimensions"][0], i["filters"], i["period"], i["rows"], i["descending"]) == ("quantity", "supplier", ["open"], "last year", 3, True)
    assert semantic.answer(tables_, "top 3 suppliers by quantity", F.lit("1998-01-01").cast("date")).count() == 3
    assert semantic.answer(tables_, "total revenue", F.lit("1998-01-01").cast("date")).columns == ["value"]
    got = spark.range(1).select(semantic.template(F.lit("COUNT"), F.lit(1234), F.lit("orders")).alias("t")).first()["t"]
    assert got == "There are 1,234 orders."


def test_citation_guard(spark):
    answers = spark.createDataFrame([(1, "alpha beta gamma [ab_chunk_1]"), (2, "made up [ab_chunk_9]"), (3, "one two three four five six seven eight nine ten eleven"), (4, "")], "answer_id int, answer string")
    retrieved = spark.createDataFrame([(k, "ab_chunk_1", "alpha beta gamma delta") for k in (1, 2, 3)], "answer_id int, chunk_id string, content string")
    got = {r["answer_id"]: (r["passed"], r["reason"]) for r in citations.guard(answers, retrieved).collect()}
    assert got == {1: (True, None), 2: (False, "citation_mismatch"), 3: (False, "unsupported_answer_claim"), 4: (True, None)}


def test_citations_without_file_or_page(spark):
    answers = spark.createDataFrame([(1, "one [ab_chunk_1] two [cd_chunk_1, ef_chunk_1] three [ff_chunk_9]"), (2, None)], "answer_id int, answer string")
    retrieved = spark.createDataFrame([(1, "ab_chunk_1", None, 3), (1, "cd_chunk_1", "/x/y.pdf", None), (1, "ef_chunk_1", None, None)], "answer_id int, chunk_id string, source_file string, page_number int")
    got = {r["answer_id"]: r["clean"] for r in citations.render(answers, retrieved).collect()}
    assert got == {1: "one [1] two [2][3] three \n\n**References**\n\n1. Unknown (Page 3)\n2. y.pdf\n3. Unknown", 2: None}


def test_pinned_rows_without_a_flag(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, False), (1, 3, True)], "q int, o int, f boolean")
    assert {r["o"]: r["place"] for r in K.pin_first(df, F.col("f"), "q", "o").collect()} == {3: 1, 1: 2, 2: 3}


def test_budget_of_whole_lists(spark, data):
    """Every document is in one list, and the fold is that of a plain loop."""
    from tessera.functions import text as T
    from tessera.queries import QUERIES

    got = {r["doc_id"]: r["taken"] for r in QUERIES["budget_fill"](spark, data).collect()}
    docs = table(spark, data, "documents").select("doc_id", "n_chars", T.token_estimate("text").alias("n")).collect()
    expected, state = {}, {}
    for d in sorted(docs, key=lambda d: (d["doc_id"] // 100, -d["n_chars"], d["doc_id"])):
        total = state.get(d["doc_id"] // 100)
        expected[d["doc_id"]] = total is None or total + d["n"] <= 1500
        state[d["doc_id"] // 100] = (total or 0) + (d["n"] if expected[d["doc_id"]] else 0)
    assert got == expected
