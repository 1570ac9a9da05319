"""Relational idioms: joins, aggregates, periods, set operations and data-quality rules on the star schema."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import dates
from ..operators.analytics import last_rows
from ..plans import semantic
from ..session import table
from .registry import Registry

R = Registry()
TODAY = "1998-09-02"
MONEY = "decimal(18,2)"


def net():
    """Price after discount, exactly."""
    return F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast(MONEY))


def money(c: str):
    return F.col(c).cast(MONEY)


NET = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"


@R.add(f"""SELECT c_custkey, c_name, CAST(sum({NET}) AS DOUBLE) AS sales_value, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'F' GROUP BY ALL ORDER BY sales_value DESC, c_custkey LIMIT 10""", "lineitem", "orders", "customer")
def top_customers_by_value(lineitem, orders, customer):
    """Ten customers by value of their active orders; a finished order stands for a deleted one.

    Lines are summed per order before they meet customers."""
    live = orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    lines = lineitem.groupBy("l_orderkey").agg(F.sum(net()).alias("v"))
    per = lines.join(live, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("v").cast("double").alias("sales_value"), F.count("*").alias("orders"))
    return per.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "sales_value", "orders").orderBy(F.desc("sales_value"), "c_custkey").limit(10)


@R.add(f"""SELECT n_name, strftime(o_orderdate, '%Y') AS year, CAST(sum({NET}) AS DOUBLE) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""", "lineitem", "orders", "customer", "nation", "region")
def star_revenue(lineitem, orders, customer, nation, region):
    """Five-way star join."""
    out = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("n_name", F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.sum(net()).cast("double").alias("revenue"), F.count("*").alias("lines"))


@R.add("SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1997-01-01' WHERE o_orderkey IS NULL", "customer", "orders")
def inactive_customers_anti(customer, orders):
    """Customers without an order since a day: a left join with its filter in ON, then IS NULL."""
    recent = orders.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    return customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@R.add("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IS NOT NULL)", "part", "lineitem")
def parts_never_returned(part, lineitem):
    """Parts of which nothing came back; NOT IN without nulls is an anti-join."""
    return part.join(lineitem.filter("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@R.add("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 45)", "supplier", "lineitem")
def semi_supplier_role(supplier, lineitem):
    """Suppliers by their presence in purchases."""
    return supplier.join(lineitem.filter("l_quantity >= 45"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@R.add("""SELECT c_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS open_value, count(o_orderkey) AS open_orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey""", "customer", "orders")
def fulfilment_pending_left(customer, orders):
    """Every customer with the value of open orders, zero where there is none; orders are summed before the join."""
    per = orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("v"), F.count("*").alias("n"))
    return customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("v", F.lit(0)).cast("double").alias("open_value"), F.coalesce("n", F.lit(0)).alias("open_orders"))


@R.add(f"""WITH l AS (SELECT l_orderkey, CAST(sum({NET}) AS DECIMAL(38,4)) AS lines, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS header, CAST(lines AS DOUBLE) AS lines, n FROM orders JOIN l ON o_orderkey = l_orderkey WHERE abs(CAST(o_totalprice AS DECIMAL(18,2)) - lines) > 300000""", "orders", "lineitem")
def reconcile_header_lines(orders, lineitem):
    """Headers that are far from the sum of their lines; both sides have one row an order before they meet."""
    lines = lineitem.groupBy("l_orderkey").agg(F.sum(net()).alias("lines"), F.count("*").alias("n"))
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.filter(F.abs(money("o_totalprice") - F.col("lines")) > 300000).select("o_orderkey", money("o_totalprice").cast("double").alias("header"), F.col("lines").cast("double").alias("lines"), "n")


@R.add("""SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE date_diff('day', o_orderdate, l_shipdate) > 110 AND l_quantity < 5""", "lineitem", "orders")
def theta_late_small_lines(lineitem, orders):
    """Conditions over joined rows: small lines that were shipped late."""
    gap = F.datediff("l_shipdate", "o_orderdate")
    return lineitem.filter("l_quantity < 5").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", gap.cast("long").alias("gap")).filter("gap > 110")


@R.add("""SELECT c_nationkey, CAST(sum(CASE WHEN year(o_orderdate) = 1996 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS y1996,
CAST(sum(CASE WHEN year(o_orderdate) = 1997 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS y1997 FROM orders JOIN customer ON o_custkey = c_custkey
WHERE year(o_orderdate) IN (1996, 1997) GROUP BY c_nationkey""", "orders", "customer")
def yoy_compare(orders, customer):
    """Two years side by side by conditional sums, in one pass."""
    y = F.year("o_orderdate")
    year = lambda n: F.sum(F.when(y == n, money("o_totalprice")).otherwise(0)).cast("double").alias(f"y{n}")
    return orders.filter(y.isin(1996, 1997)).join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(year(1996), year(1997))


@R.add("SELECT a.p_brand AS brand, a.p_type AS type, count(*) AS pairs FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey GROUP BY ALL", "part")
def same_table_twice(part):
    """Pairs of parts of one brand, type and size; counted from group sizes, so that no group is paired off."""
    groups = part.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"))
    return groups.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).filter("pairs > 0")


@R.add("SELECT r_name, n_name FROM region CROSS JOIN nation ORDER BY r_name, n_name LIMIT 100", "region", "nation")
def clamped_cross_join(region, nation):
    """A product that was asked for is cut to its first hundred rows; both tables are of fixed size."""
    return region.select("r_name").crossJoin(F.broadcast(nation.select("n_name"))).orderBy("r_name", "n_name").limit(100)


@R.add("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross,
round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_quantity, CAST(min(l_extendedprice) AS DOUBLE) AS low, CAST(max(l_extendedprice) AS DOUBLE) AS high FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""", "lineitem")
def pricing_summary(lineitem):
    kept = lineitem.filter(F.col("l_shipdate") <= F.lit(TODAY).cast("timestamp"))
    q = F.sum(money("l_quantity")).cast("double")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), q.alias("quantity"), F.sum(money("l_extendedprice")).cast("double").alias("gross"), F.round(q / F.count("*"), 4).alias("avg_quantity"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@R.add("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS orders FROM orders GROUP BY 1", "orders")
def monthly_revenue(orders):
    return orders.groupBy(dates.month_key(F.col("o_orderdate")).alias("month")).agg(F.sum(money("o_totalprice")).cast("double").alias("revenue"), F.count("*").alias("orders"))


@R.add("""SELECT CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END || '-' || lpad(CAST((CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END) % 100 AS VARCHAR), 2, '0') AS fy,
year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, count(*) AS orders FROM orders GROUP BY ALL""", "orders")
def financial_years(orders):
    d = F.col("o_orderdate")
    return orders.groupBy(dates.financial_year(d).alias("fy"), dates.quarter_key(d).alias("quarter")).agg(F.count("*").alias("orders"))


@R.add("""SELECT o_orderpriority, count(*) AS n, round(100.0 * sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) / count(*), 4) AS open_share, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS partial_customers
FROM orders GROUP BY 1""", "orders")
def status_breakdown_case(orders):
    """Ratios and funnel counts from conditional aggregates."""
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("o_orderstatus") == "O") * 100.0 / F.count("*"), 4).alias("open_share"), F.count_distinct(F.when(F.col("o_orderstatus") == "P", F.col("o_custkey"))).alias("partial_customers"))


@R.add("SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(*) > 1", "part")
def dup_names_having(part):
    return part.groupBy("p_name").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands")).filter("n > 1")


@R.add("SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 3", "orders")
def busy_months_having(orders):
    """Customers with three orders and more in a calendar month."""
    return orders.groupBy("o_custkey", dates.month_key(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n")).filter("n >= 3")


@R.add("""SELECT o_custkey, round(avg(gap), 4) AS avg_gap, count(*) AS gaps FROM (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders)
WHERE gap IS NOT NULL GROUP BY 1""", "orders")
def date_gap_avg(orders):
    """Days between a customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gaps = orders.select("o_custkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap")).filter("gap is not null")
    return gaps.groupBy("o_custkey").agg(F.round(F.avg("gap"), 4).alias("avg_gap"), F.count("*").alias("gaps"))


@R.add("""WITH t AS (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty FROM lineitem)
SELECT l_suppkey, CAST(sum(TRY_CAST(qty AS DECIMAL(10,2))) AS DOUBLE) AS quantity, CAST(sum(CASE WHEN TRY_CAST(qty AS DECIMAL(10,2)) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unreadable FROM t GROUP BY 1""", "lineitem")
def cast_guarded_sum(lineitem):
    """Quantities kept as text, some of which are no numbers."""
    t = lineitem.select("l_suppkey", F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qty"))
    n = dates.number(F.col("qty"))
    return t.groupBy("l_suppkey").agg(F.sum(n).cast("double").alias("quantity"), F.count_if(n.isNull()).alias("unreadable"))


@R.add("SELECT s_nationkey AS nation, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS stock FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1", "lineitem", "supplier")
def signed_stock(lineitem, supplier):
    """Incoming minus returned quantities."""
    per = lineitem.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -money("l_quantity")).otherwise(money("l_quantity"))).alias("q"))
    return per.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum("q").cast("double").alias("stock"))


@R.add("""SELECT l_suppkey, round(CAST(sum(CASE WHEN l_shipdate <= o_orderdate + INTERVAL 60 DAY THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(DISTINCT l_orderkey), 0), 4) AS per_order, round(CAST(count(DISTINCT l_partkey) AS DOUBLE) / nullif(count(DISTINCT CASE WHEN l_tax > 5 THEN l_partkey END), 0), 4) AS guarded
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""", "lineitem", "orders")
def guarded_ratios(lineitem, orders):
    """Ratios whose denominator may be zero."""
    j = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    early = F.count_if(F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return j.groupBy("l_suppkey").agg(F.round(F.try_divide(early.cast("double"), F.count_distinct("l_orderkey").cast("double")), 4).alias("per_order"), F.round(F.try_divide(F.count_distinct("l_partkey").cast("double"), F.count_distinct(F.when(F.col("l_tax") > 5, F.col("l_partkey"))).cast("double")), 4).alias("guarded"))


@R.add("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END), ''), 'segment ' || c_mktsegment) AS label FROM customer
WHERE c_acctbal IS NULL OR c_acctbal <= 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0""", "customer")
def data_quality_fallback(customer):
    """Missing, blank and zero values, with a fallback label."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, "  ").when(k % 7 == 0, None).otherwise(F.col("c_name"))
    bad = F.col("c_acctbal").isNull() | (F.col("c_acctbal") <= 0) | (k % 5 == 0) | (k % 7 == 0)
    return customer.filter(bad).select("c_custkey", F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.concat(F.lit("segment "), F.col("c_mktsegment"))).alias("label"))


@R.add("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAY GROUP BY 1""", "events")
def daily_activity(events):
    """Activity of the thirty days before a given day."""
    recent = events.filter(F.col("ts") >= F.lit("2024-01-30").cast("timestamp") - F.expr("INTERVAL 30 DAY"))
    return recent.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@R.add("""SELECT user_id, day, n FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, strftime(ts, '%Y-%m-%d')) AS r FROM events GROUP BY 1, 2) WHERE r = 1""", "events")
def busiest_day_per_user(events):
    """The best group of each group, by an aggregate instead of a sort."""
    days = events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    best = days.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "day")).alias("b"))
    return best.select("user_id", "b.day", (-F.col("b.m")).alias("n"))


@R.add("""SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""", "orders")
def latest_per_customer(orders):
    """The latest order of each customer: a maximum of structs combines before the shuffle, a window doesn't."""
    last = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return last.select("o_custkey", "m.o_orderkey", F.date_format("m.o_orderdate", "yyyy-MM-dd").alias("day"))


@R.add("""SELECT o_custkey, o_orderkey, r, CAST(running AS DOUBLE) AS running FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC) AS r,
sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM orders) WHERE r <= 3""", "orders")
def ranked_orders(orders):
    """Analytic windows: rank and running total."""
    w = Window.partitionBy("o_custkey")
    out = orders.select("o_custkey", "o_orderkey", F.rank().over(w.orderBy(F.desc(money("o_totalprice")))).alias("r"), F.sum(money("o_totalprice")).over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"))
    return out.filter("r <= 3")


@R.add("SELECT 'customer' AS kind, c_name AS name, c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 UNION SELECT 'supplier', s_name, s_nationkey FROM supplier WHERE s_acctbal > 5000", "customer", "supplier")
def union_contacts(customer, supplier):
    one = customer.filter("c_acctbal > 5000").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    two = supplier.filter("s_acctbal > 5000").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return one.unionByName(two).distinct()


@R.add("SELECT c_nationkey AS nation, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT n_nationkey, 'no supplier' FROM nation EXCEPT SELECT s_nationkey, 'no supplier' FROM supplier)", "customer", "supplier", "nation")
def set_operations(customer, supplier, nation):
    both = customer.select(F.col("c_nationkey").alias("nation")).intersect(supplier.select("s_nationkey")).withColumn("side", F.lit("both"))
    rest = nation.select(F.col("n_nationkey").alias("nation")).subtract(supplier.select("s_nationkey")).withColumn("side", F.lit("no supplier"))
    return both.unionByName(rest)


@R.add("SELECT DISTINCT event_type FROM events", "events")
def distinct_entities(events):
    return events.select("event_type").distinct()


@R.add("""SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, CAST(GROUPING(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""", "orders")
def cube_orders(orders):
    cube = orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return cube.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "level", "n")


@R.add("""WITH p AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS q, max(CAST(l_quantity AS DECIMAL(18,2))) AS top, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(top AS DOUBLE) AS top, CAST(q AS DOUBLE) AS total FROM p WHERE n > 1 AND top * 2 > q""", "lineitem")
def dominant_share(lineitem):
    """Orders of several lines of which one holds more than half."""
    per = lineitem.groupBy("l_orderkey").agg(F.sum(money("l_quantity")).alias("q"), F.max(money("l_quantity")).alias("top"), F.count("*").alias("n"))
    return per.filter((F.col("n") > 1) & (F.col("top") * 2 > F.col("q"))).select("l_orderkey", F.col("top").cast("double").alias("top"), F.col("q").cast("double").alias("total"))


@R.add(f"""SELECT o_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate > o_orderdate + INTERVAL 100 DAY AND l_shipdate >= DATE '{TODAY}' - INTERVAL 90 DAY AND l_shipdate <= DATE '{TODAY}'""", "orders", "lineitem")
def overdue_in_period(orders, lineitem):
    """A date range between joined dates, and a period before a given day."""
    today = F.lit(TODAY).cast("timestamp")
    recent = lineitem.filter((F.col("l_shipdate") >= today - F.expr("INTERVAL 90 DAY")) & (F.col("l_shipdate") <= today))
    return orders.join(recent, F.col("o_orderkey") == F.col("l_orderkey")).filter(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 100 DAY")).select("o_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))


@R.add("""WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL)
SELECT strftime(d, '%Y-%m-%d') AS today, strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y-%m-%d') AS month_from, strftime(date_trunc('quarter', d) - INTERVAL 3 MONTH, '%Y-%m-%d') AS quarter_from,
strftime(date_trunc('year', d) - INTERVAL 1 YEAR, '%Y-%m-%d') AS year_from, strftime(d - INTERVAL 6 MONTH, '%Y-%m-%d') AS half_from, strftime(make_date(CAST(year(d) AS BIGINT), 1, 1) + INTERVAL 59 DAY, '%Y-%m-%d') AS day60, date_diff('day', DATE '1997-01-01', d) AS days FROM t""", "orders")
def date_arithmetic(orders):
    """Named periods and day numbers, always against a given day: each on which something was ordered."""
    t = orders.select(F.col("o_orderdate").cast("date").alias("d")).dropna().distinct()
    d, text = F.col("d"), lambda c: F.date_format(c, "yyyy-MM-dd")
    start = lambda p: text(dates.window(p, d)[0])
    return t.select(text(d).alias("today"), start("last month").alias("month_from"), start("last quarter").alias("quarter_from"), start("last year").alias("year_from"), start("last 6 months").alias("half_from"), text(dates.day_of_year(F.year(d), F.lit(60))).alias("day60"), F.datediff(d, F.lit("1997-01-01").cast("date")).cast("long").alias("days"))


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90", "events")
def json_property(events):
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k >= 90")


@R.add("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE r <= 6", "conversations")
def history_last_turns(conversations):
    """The last six turns of each conversation."""
    return last_rows(conversations, 6, ["conv_id"], [F.desc("turn"), F.desc("role"), F.desc("text")]).select("conv_id", "turn", "role")


@R.add(f"""SELECT c_name AS dimension, CAST(sum({NET}) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def semantic_top_customers(spark, sf_dir):
    """A question in words, through the semantic layer to a plan."""
    frames = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "part", "nation")}
    return semantic.answer(frames, "top 5 customers by revenue last year", F.lit("1998-08-01").cast("date"))


@R.add("""SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1""")
def semantic_open_quantity(spark, sf_dir):
    frames = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders")}
    out = semantic.answer(frames, "quantity of open orders per month", F.lit(TODAY).cast("date"))
    return out.select(F.concat("dimension", F.lit("-01")).alias("month"), "value")
