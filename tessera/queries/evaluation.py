"""Evaluation reports, guards of model replies and functions that SQL can call, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registered
from ..operators import evaluation as E, fastpath as P
from ..plans import guards as G
from ..session import table
from .registry import Registry

R = Registry()


@R.add("""WITH c AS (SELECT o_orderpriority AS category, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM orders GROUP BY 1),
a AS (SELECT * FROM c UNION ALL SELECT NULL, CAST(sum(total) AS BIGINT), CAST(sum(passed) AS BIGINT) FROM c) SELECT category, total, passed, total - passed AS failed, floor(CAST(passed AS DOUBLE) * 1000 / total + 0.5) / 10 AS pass_rate FROM a""", "orders")
def pass_rates(orders):
    """Orders as cases: a finished one has passed."""
    return E.pass_rates(orders, "o_orderpriority", F.col("o_orderstatus") == "F")


@R.add("""WITH q AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders), u AS (SELECT DISTINCT o_orderkey, CAST(l_partkey AS VARCHAR) AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey), r AS (SELECT name, count(*) AS n FROM u GROUP BY 1),
s AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_size <= 40), b AS (SELECT coalesce(s.name, r.name) AS name, s.name IS NOT NULL AS known, coalesce(n, 0) AS n FROM s FULL JOIN r ON s.name = r.name)
SELECT 'questions' AS measure, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM q UNION ALL SELECT 'tables', NULL, count(*) FILTER (known) FROM b UNION ALL SELECT 'referenced', NULL, count(*) FILTER (known AND n > 0) FROM b
UNION ALL SELECT CASE WHEN known THEN 'unreferenced' ELSE 'unknown' END, name, n FROM b WHERE NOT known OR n = 0 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM q GROUP BY 2""", "orders", "lineitem", "part")
def bank_coverage(orders, lineitem, part):
    """Orders as questions, their parts as the tables that they name, parts up to a size as the schema."""
    named = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("tables"))
    schema = part.filter("p_size <= 40").select(F.col("p_partkey").cast("string").alias("table_name"))
    return E.bank_coverage(orders.join(named, "o_orderkey", "left"), schema, ["o_orderstatus", "o_orderpriority"])


ENTITIES = {"paint": ["red", "blue", "green"], "tool": ["anvil", "hammer", "red anvil"], "valve": ["valve", "pump", "widget"]}
_NEEDS = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(p_name, '')), '(^|[^a-z0-9_])({'|'.join(words)})($|[^a-z0-9_])') THEN '{name}' END" for name, words in ENTITIES.items())


@R.add(f"""WITH d AS (SELECT p_partkey, list_filter([{_NEEDS}], lambda x: x IS NOT NULL) AS need, CASE p_partkey % 3 WHEN 0 THEN 'Paint(shade), TOOL(id)' WHEN 1 THEN 'tool(id), valve(id)' END AS shown FROM part)
SELECT p_partkey, array_to_string(need, ',') AS required, array_to_string(list_filter(need, lambda x: NOT contains(lower(coalesce(shown, '')), x)), ',') AS missing, len(list_filter(need, lambda x: NOT contains(lower(coalesce(shown, '')), x))) = 0 AS sufficient FROM d""", "part")
def schema_sufficiency(part):
    """Part names as questions, held against the schema that was retrieved for them."""
    shown = F.when(F.col("p_partkey") % 3 == 0, "Paint(shade), TOOL(id)").when(F.col("p_partkey") % 3 == 1, "tool(id), valve(id)")
    out = G.schema_sufficiency(part.withColumn("shown", shown), "p_name", "shown", ENTITIES)
    return out.select("p_partkey", F.array_join("required_tables", ",").alias("required"), F.array_join("missing_tables", ",").alias("missing"), "sufficient")


@R.add("SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN 'SELECT name FROM t WHERE id = ' || CAST(doc_id AS VARCHAR) END AS statement FROM documents", "documents")
def model_statements(documents):
    """Replies that think aloud with a document's whole text, then give a statement in five forms, or decline."""
    sql = F.concat(F.lit("SELECT name FROM t WHERE id = "), F.col("doc_id").cast("string"))
    thought = F.concat(F.lit("<think>"), F.regexp_replace(F.coalesce("text", F.lit("")), "</?think>", ""), F.lit("</think>\n"))
    k = F.col("doc_id") % 6
    shown = F.when(k == 0, F.concat(F.lit("```sql\n"), sql, F.lit(";\n```\nThat is all."))).when(k == 1, F.concat(F.lit("Here it is: "), sql, F.lit(" ;"))).when(k == 2, F.concat(F.lit('{"why": "a name", "sql": "'), sql, F.lit('"}')))
    shown = shown.when(k == 3, F.concat(F.lit('```json\n{"why": "cut off", "sql": "'), sql)).when(k == 4, sql).otherwise("NO_SQL: not a question about data")
    return documents.select("doc_id", G.statement_of(F.concat(thought, shown)).alias("statement"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'critical' WHEN o_totalprice > 150000 THEN 'warning' ELSE 'info' END AS class FROM orders", "orders")
def statement_cardinality(orders):
    """A log of statements with estimated rows."""
    k = F.col("o_orderkey") % 4
    sql = F.when(k == 0, "select 1 from a cross  join b").when(k == 1, "SELECT 'on' FROM a JOIN b ON a.x = b.x JOIN c").when(k == 2, "SELECT 1 FROM a JOIN b USING (x)").otherwise("SELECT 1 FROM a WHERE s = 'cross join'")
    return orders.select("o_orderkey", G.cardinality(sql, "o_totalprice", 150_000).alias("class"))


@R.add("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'", "part")
def fuzzy_names(part):
    """Names that hold a term, in any case."""
    return part.filter(G.fuzzy_like("p_name", "RED")).select("p_partkey", "p_name")


@R.add("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN greatest(1, length(text) // 4) END AS tokens, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS INTEGER) AS n_words FROM documents""")
def registered_measures(spark, sf_dir):
    """Measures called by name in a statement."""
    registered.register(spark)
    return spark.sql("SELECT doc_id, text_tokens(text) AS tokens, CASE WHEN text IS NOT NULL THEN size(text_words(text)) END AS n_words FROM {d}", d=table(spark, sf_dir, "documents"))


@R.add("""SELECT doc_id, CAST(k AS INTEGER) AS place, substring(text, CAST(k * 400 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 500) / 400.0)) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0)""")
def registered_chunks(spark, sf_dir):
    """A table function in a statement: overlapping pieces of each whole text."""
    registered.register(spark)
    return spark.sql("SELECT doc_id, c.place, c.chunk FROM {d} d, LATERAL text_chunks(d.text, 500, 400) c", d=table(spark, sf_dir, "documents"))


RUN_SQL = "(SELECT event_id, floor(value)::BIGINT % 101 AS score, user_id % 3 AS expected, event_id % 3 AS observed, user_id % 2 = 0 AS twist, event_type FROM events)"


@R.add(f"""WITH r AS (SELECT CAST(event_id AS VARCHAR) AS c, CAST(coalesce(score, 0) AS DOUBLE) AS s, CAST(coalesce(expected = observed, FALSE) AS INTEGER) AS routed, CAST(coalesce(twist, FALSE) AS INTEGER) AS twisted, coalesce(event_type, 'unknown') AS kind FROM {RUN_SQL})
SELECT 'score' AS measure, CAST(NULL AS VARCHAR) AS name, sum(s) / count(*) AS value, count(*) AS n FROM r UNION ALL SELECT 'routing', NULL, sum(routed) / count(*), count(*) FROM r UNION ALL SELECT 'twists', NULL, sum(twisted) / count(*), count(*) FROM r
UNION ALL SELECT 'difficulty', kind, sum(s) / count(*), count(*) FROM r GROUP BY kind UNION ALL SELECT 'worst', c, s, 1 FROM (SELECT c, s FROM r ORDER BY s, c LIMIT 5)""", "events")
def run_summary(events):
    """Events as the cases of a run: their type is the difficulty, routes and twists go by the user."""
    run = events.select("event_id", F.expr("cast(floor(value) as bigint) % 101").alias("score"), F.expr("user_id % 3").alias("expected"), F.expr("event_id % 3").alias("observed"), F.expr("user_id % 2 = 0").alias("twist"), "event_type")
    return E.summary(run, "event_id", "score", "expected", "observed", "twist", "event_type")


# Questions of the kinds COUNT, SUM and LIST, in turn, by type of event.
ASKS = {"view": ["How many page views were there?", "What is the total view time for users?", "List all views"], "click": ["How many clicks came due to mails?", "Sum of clicks", "List all clicks"], "purchase": ["How many purchases in May?", "What is the total purchase value?", "List all purchases"], "error": ["number of errors", "Why is the total error count so high?", "List all errors"], "": ["How many?", "total", "List"]}
_ASKED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN " + "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in ASKS.items() if k) + f" ELSE {ASKS['']} END"
_KINDS = ["COUNT", "SUM", "LIST"]
_SAID, _TOTAL = (f"coalesce(nullif(trim(regexp_extract(question, '{P.asked_for(*words)}', 1)), ''), '{default}')" for words, default in ((P.COUNTS, "records"), (P.SUMS, "amount")))


@R.add(f"""WITH a AS (SELECT event_id, ts, event_type, (({_ASKED})::VARCHAR[])[1 + CAST(event_id % 3 AS INTEGER)] AS question, ({_KINDS})[1 + CAST(event_id % 3 AS INTEGER)] AS kind, CASE WHEN event_id % 3 = 1 AND user_id % 40 = 0 THEN NULL ELSE event_id * 13 END AS value FROM events),
f AS (SELECT *, NOT regexp_matches(lower(question), '{"|".join(P.DISQUALIFIERS)}') AND kind <> 'LIST' AS tried, replace(format('{{:,}}', value), '.', ',') AS number FROM a),
s AS (SELECT *, CASE kind WHEN 'COUNT' THEN 'There are ' || number || ' ' || {_SAID} || '.' WHEN 'SUM' THEN 'The total ' || {_TOTAL} || ' is ' || number || '.' END AS said FROM f),
w AS (SELECT event_id, kind, ts, count(*) OVER o AS n, count(*) FILTER (said IS NULL) OVER o AS bad FROM s WHERE tried WINDOW o AS (PARTITION BY kind ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
off AS (SELECT kind, min((ts, event_id)) AS x FROM w WHERE n >= 50 AND bad >= n * 0.01 GROUP BY 1)
SELECT s.event_id, s.kind, CASE WHEN tried AND ((s.ts, s.event_id) <= off.x OR off.x IS NULL) THEN said END AS answer FROM s LEFT JOIN off ON s.kind = off.kind""", "events")
def fast_path_answers(events):
    """Questions of events answered by template until a template fails too often; lists are switched off by hand."""
    asks = F.coalesce(*[F.when(F.col("event_type") == k, F.array(*map(F.lit, v))) for k, v in ASKS.items() if k], F.array(*map(F.lit, ASKS[""])))
    k = F.pmod("event_id", F.lit(3)).cast("int")
    asked = events.select("event_id", "ts", F.get(asks, k).alias("question"), F.get(F.array(*map(F.lit, _KINDS)), k).alias("kind"), F.when((k == 1) & (F.col("user_id") % 40 == 0), None).otherwise(F.col("event_id") * 13).alias("value"))
    return P.answers(asked, "kind", "ts", "event_id", "question", "value", disabled=["LIST"]).select("event_id", "kind", "answer")
