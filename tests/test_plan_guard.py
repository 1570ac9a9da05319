"""The read-only guard on Spark's trees."""

import pytest

from tessera.functions import registered
from tessera.plans import governance as G, views
from tessera.plans.tree import Trees
from tessera.session import table

ALLOWED = ["nation", "region", "orders"]


@pytest.fixture(scope="module", autouse=True)
def tables_(spark, data):
    views.register({t: table(spark, data, t) for t in ALLOWED})
    spark.range(3).selectExpr("id AS token").createOrReplaceTempView("secret")
    registered.register(spark)
    spark.udf.register("python_len", lambda x: len(x or ""), "int")


@pytest.mark.parametrize("sql", [
    "SELECT `reflect`('java.lang.System','getProperty','user.home')", "SELECT `java_method`('java.lang.System','getProperty','user.home')", "SELECT try_reflect('java.lang.System','getProperty','user.home')", "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','user.home')",
    "SELECT n_name FROM nation WHERE n_name = (SELECT max(`reflect`('java.lang.System','getProperty','user.home')) FROM region)", "SELECT system.builtin.reflect('java.lang.System','getProperty','user.home')",
    "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM IDENTIFIER('sec' || 'ret')", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT token FROM IDENTIFIER('secret'))", "SELECT count(*) FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/customer.parquet`')",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/customer.parquet`", "SELECT * FROM `parquet`.`/root/testdata/sf0.001/customer.parquet`", "SELECT * FROM secret", "TABLE secret", "SELECT n_name FROM nation UNION ALL SELECT token FROM secret",
    "WITH x AS (SELECT * FROM secret) SELECT * FROM x", "SELECT * FROM (WITH secret AS (SELECT 1) SELECT * FROM secret) a, secret b", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "SELECT n_name FROM nation ORDER BY (SELECT max(token) FROM secret)",
    "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM secret WHERE token = n_nationkey)", "SELECT * FROM nation, LATERAL (SELECT token FROM secret)", "SELECT n_name, rank() OVER (ORDER BY (SELECT max(token) FROM secret)) FROM nation",
    "SELECT python_len(n_name) FROM nation", "SELECT input_file_name() FROM nation", "SELECT current_user()", "SELECT from_protobuf(unhex('00'), 'x', '/etc/passwd')", "SELECT transform(array('a'), x -> `reflect`('java.lang.System','getProperty',x))",
    "DELETE FROM nation WHERE n_nationkey = 1", "UPDATE nation SET n_name = 'x'", "INSERT INTO nation VALUES (1)", "DROP TABLE nation", "TRUNCATE TABLE nation", "ALTER TABLE nation ADD COLUMN age INT", "CREATE TABLE backdoor (id INT)", "CREATE TEMP VIEW v AS SELECT 1", "GRANT ALL ON nation TO hacker",
    "SELECT n_name FROM nation; DROP TABLE nation;", "SELECT LOAD_FILE('/etc/passwd') AS secret", "SELECT SLEEP(10)", "SET spark.sql.ansi.enabled=false", "ADD JAR '/tmp/x.jar'", "SHOW TABLES", "EXPLAIN SELECT 1", "CACHE TABLE nation", "EXECUTE IMMEDIATE 'SELECT 1'", "REFRESH TABLE nation", "DESCRIBE nation",
    "SELECT * FROM nation INTO OUTFILE '/tmp/dump.txt'", "SELECT TRANSFORM (n_name) USING 'cat' AS (x) FROM nation", "FROM nation INSERT INTO region SELECT *", "WITH region AS (SELECT 1 AS r) SELECT * FROM region", "SELECT * FROM python_table_function(1)", "", None, "-- nothing", "SELECT :name",
])
def test_refused(spark, sql):
    verdict = G.check(spark, sql, ALLOWED)
    assert not verdict.ok
    with pytest.raises(PermissionError):
        G.run(spark, sql, ALLOWED)


@pytest.mark.parametrize("sql", [
    "SELECT `n_name` FROM nation -- reflect('x')", "SELECT 'reflect(1)' AS x FROM `nation`", "WITH a AS (SELECT 1 AS x), b(y) AS (SELECT x FROM a) SELECT y FROM b", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name LIKE 'A%'",
    "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1 ORDER BY 2 DESC LIMIT 3", "SELECT o_custkey, rank() OVER w FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)", "SELECT n_name FROM nation EXCEPT SELECT r_name FROM region",
    "VALUES (1, 2), (3, 4)", "SELECT x FROM nation LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT id FROM range(5)", "SELECT transform(array(1, 2), x -> x + 1)", "SELECT * FROM nation PIVOT (count(n_name) FOR n_regionkey IN (0, 1))", "TABLE nation", "FROM nation |> WHERE n_regionkey = 1 |> SELECT n_name",
    "SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) FROM orders WHERE o_orderdate >= DATE'1995-01-01' - INTERVAL 1 YEAR GROUP BY 1", "SELECT typeof(n_name), CAST(n_nationkey AS string), n_name IS NULL, CASE WHEN n_regionkey = 1 THEN 'a' END FROM nation",
    "WITH RECURSIVE t(n) AS (VALUES (1) UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT n FROM t",
])
def test_allowed(spark, sql):
    verdict = G.check(spark, sql, ALLOWED)
    assert verdict.ok, verdict.errors
    G.run(spark, sql, ALLOWED).collect()


def test_refused_statements_run_nothing(spark):
    jvm = spark._jvm.java.lang.System
    for call in ("`reflect`", "`java_method`", "IDENTIFIER('reflect')", "IDENTIFIER('java_' || 'method')"):
        with pytest.raises(PermissionError):
            G.run(spark, f"SELECT {call}('java.lang.System', 'setProperty', 'tessera.ran', 'yes')", ALLOWED).collect()
    assert jvm.getProperty("tessera.ran") is None


def test_declared_functions(spark):
    sql = "SELECT text_tokens(n_name) AS t FROM nation"
    assert not G.check(spark, sql, ALLOWED).ok
    assert G.run(spark, sql, ALLOWED, functions=["text_tokens"]).count() == 25


def test_warnings(spark):
    w = lambda sql: set(G.check(spark, sql, ALLOWED).warnings)
    assert w("SELECT n_name FROM nation, region") == {"cartesian product", "joins without a filter"}
    assert w("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM nation a CROSS JOIN region b)") == {"cartesian product"}
    assert w("SELECT r.* FROM region r") == {"selects all columns"}
    assert w("SELECT count(*) AS n FROM region") == set()
    assert w("SELECT 'x = null' AS x FROM nation WHERE n_name = null") == {"compares with NULL"}


def test_scopes(spark):
    found = Trees(spark).written("WITH a AS (SELECT * FROM nation), b AS (SELECT * FROM a) SELECT * FROM b JOIN (WITH c AS (SELECT * FROM region) SELECT * FROM c) d JOIN c ON 1 = 1")
    assert found.relations == {"nation", "region", "c"} and found.common == {"a", "b", "c"}


def test_lineage(spark):
    sql = """WITH spent AS (SELECT o_custkey AS who, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)
    SELECT who AS customer, revenue, revenue / 2 AS half, n_name || r_name AS place, 1 AS one, (SELECT max(r_name) FROM region) AS top FROM spent, nation JOIN region ON n_regionkey = r_regionkey"""
    got = G.column_lineage(spark, sql)
    assert got == {"customer": {"orders.o_custkey"}, "revenue": {"orders.o_totalprice"}, "half": {"orders.o_totalprice"}, "place": {"nation.n_name", "region.r_name"}, "one": set(), "top": {"region.r_name"}}
    assert G.column_lineage(spark, "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region") == {"x": {"nation.n_name", "region.r_name"}}


def test_aliases(spark):
    profit = "what is the total profit"
    assert G.dishonest_aliases(spark, "SELECT o_totalprice AS profit FROM orders", profit) == ["profit"]
    assert G.dishonest_aliases(spark, "SELECT p AS profit FROM (SELECT o_totalprice AS p FROM orders)", profit) == ["profit"]
    assert G.dishonest_aliases(spark, "WITH t AS (SELECT CAST(o_totalprice AS double) AS x FROM orders) SELECT x AS profit FROM t", profit) == ["profit"]
    assert G.dishonest_aliases(spark, "SELECT sum(o_totalprice) AS profit FROM orders", profit) == []
    assert G.dishonest_aliases(spark, "SELECT o_totalprice AS total FROM orders", profit) == []
    assert G.unknown_aliases(spark, "SELECT 1 AS shadow_token, sum(o_totalprice) AS revenue, count(o_orderkey) AS orderkey_count FROM orders", ["revenue", "count", "o"]) == ["shadow_token"]


def test_text_sums_and_time(spark):
    frames = {t: spark.table(t) for t in ALLOWED}
    assert G.text_sums(spark, frames, "SELECT avg(n_name + 1), sum(CAST(n_name AS double)) FROM nation") == ["n_name"]
    assert G.text_sums(spark, frames, "SELECT sum(CAST(n_name AS double)) FROM nation") == []
    assert G.temporal_bound(spark, "orders last month", "SELECT count(*) AS n FROM orders WHERE o_orderdate > current_date() - INTERVAL 1 MONTH")
    assert not G.temporal_bound(spark, "orders last month", "SELECT count(*) AS n, max(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'date > 1995'")
    assert G.temporal_bound(spark, "all orders", "SELECT count(*) AS n FROM orders")


def test_estimates(spark):
    assert G.estimate(spark, "SELECT n_name FROM nation CROSS JOIN region", ALLOWED)[0] == "critical"
    assert G.estimate(spark, "SELECT id FROM range(100000)", ALLOWED) == ("warning", 100000)
    assert G.estimate(spark, "SELECT id FROM range(5)", ALLOWED) == ("info", 5)
