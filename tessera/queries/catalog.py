"""Registry, schema and governance queries, and streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window, functions as F

from ..functions import privacy as P
from ..operators import catalog as C, keys, registry as V
from ..plans import governance as G, views
from ..session import TABLES, shared_folder, table
from ..sources import jsonl
from ..streaming import telemetry as S
from .registry import Registry
from .text import ASKED, questions, runs_sql

R = Registry()


def _uploads(documents):
    """Documents of a source and language are uploads of one file; equal texts are equal contents."""
    return documents.select(F.col("doc_id").cast("string").alias("document_id"), F.concat_ws("/", "lang", (F.col("doc_id") % 50).cast("string")).alias("name"), F.sha2("text", 256).alias("content_hash"), F.coalesce("source", F.lit("system")).alias("user_id"), F.when(F.col("doc_id") % 3 == 0, "old-model").otherwise("model").alias("embedding_model"), F.col("doc_id").alias("created_at"))


UPLOADS_SQL = "u AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, concat_ws('/', lang, CAST(doc_id % 50 AS VARCHAR)) AS name, sha256(text) AS content_hash, coalesce(source, 'system') AS user_id, CASE WHEN doc_id % 3 = 0 THEN 'old-model' ELSE 'model' END AS embedding_model, doc_id AS created_at FROM documents)"
VERSIONS_SQL = f"""{UPLOADS_SQL}, v AS (SELECT *, lag(document_id) OVER w AS supersedes, lead(document_id) OVER w AS superseded_by, first_value(document_id) OVER w AS lineage_root FROM u WINDOW w AS (PARTITION BY user_id, name ORDER BY created_at, document_id))"""


@R.add(f"WITH {VERSIONS_SQL} SELECT document_id, supersedes, superseded_by, lineage_root, superseded_by IS NULL AS active, row_number() OVER (PARTITION BY lineage_root ORDER BY created_at, document_id) AS version, count(*) OVER (PARTITION BY lineage_root) AS versions FROM v", "documents")
def active_versions(documents):
    """Versions and lineages of uploads."""
    out = V.versions(V.build_versions(_uploads(documents)))
    return out.select("document_id", "supersedes", "superseded_by", "lineage_root", "active", F.col("version").cast("long").alias("version"), "versions")


@R.add(f"""WITH {VERSIONS_SQL}, k AS (SELECT content_hash, user_id, max_by(embedding_model, created_at) AS known_model, max_by(document_id, created_at) AS known_id FROM v WHERE superseded_by IS NULL GROUP BY 1, 2)
SELECT i.document_id, k.known_id, CASE WHEN k.known_id IS NULL THEN 'NEW' WHEN k.known_model = 'model' THEN 'ALREADY_INGESTED' ELSE 'STALE_EMBEDDING' END AS status FROM u i LEFT JOIN k ON i.content_hash = k.content_hash AND i.user_id = k.user_id""", "documents")
def registry_status(documents):
    """What would happen to each upload if it came again."""
    uploads = _uploads(documents)
    return V.status(uploads.drop("embedding_model"), V.build_versions(uploads), "model").select("document_id", "known_id", "status")


@R.add(f"WITH {VERSIONS_SQL}, g AS (SELECT * FROM v WHERE created_at % 4 = 0) SELECT a.document_id, coalesce((SELECT TRUE FROM g WHERE g.superseded_by IS NULL AND g.supersedes = a.document_id), a.superseded_by IS NULL) AS active, CASE WHEN a.superseded_by IN (SELECT document_id FROM g) THEN NULL ELSE a.superseded_by END AS superseded_by FROM v a WHERE a.created_at % 4 <> 0", "documents")
def unregister_versions(documents):
    """Every fourth version removed; predecessors of removed active ones come back."""
    registry = V.build_versions(_uploads(documents)).select(V.COLUMNS)
    out = V.unregister(registry, registry.filter("created_at % 4 = 0").select("document_id"))
    return out.select("document_id", "active", "superseded_by")


@R.add(f"WITH {VERSIONS_SQL} SELECT document_id, superseded_by IS NULL AS active FROM v", "documents")
def reconcile_active(documents):
    """Chunks' flags set by the registry."""
    chunks = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(True).alias("active"))
    return V.reconcile(chunks, V.build_versions(_uploads(documents))).select("document_id", "active")


@R.add("SELECT doc_id, substr(sha256('/data/' || doc_id || '.txt'), 1, 16) AS document_id, doc_id || '.txt' AS name FROM documents", "documents")
def document_ids(documents):
    path = F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select("doc_id", V.document_id(path).alias("document_id"), P.safe_basename(path).alias("name"))


def _columns(spark, sf_dir):
    return C.columns({t: table(spark, sf_dir, t) for t in TABLES}, spark)


@R.add("SELECT table_name AS \"table\", column_name AS \"column\", CAST(ordinal_position - 1 AS INTEGER) AS position FROM information_schema.columns WHERE table_name IN ({})".format(", ".join(f"'{t}'" for t in TABLES)))
def schema_columns(spark, sf_dir):
    """Introspection of all tables."""
    return _columns(spark, sf_dir).select("table", "column", "position")


@R.add("SELECT * FROM (VALUES ('deleted_table', 'archive', NULL, 'critical', FALSE), ('missing_column', 'nation', 'n_code', 'critical', FALSE), ('type_mismatch', 'nation', 'n_name', 'warning', FALSE), ('new_column', 'nation', 'n_regionkey', 'info', TRUE)) t(drift_type, \"table\", \"column\", severity, healed)")
def schema_drift(spark, sf_dir):
    """Drift between a remembered schema and the tables."""
    live = _columns(spark, sf_dir).filter("`table` in ('region', 'nation')").select("table", "column", "type")
    was = live.filter("`column` <> 'n_regionkey'").withColumn("type", F.when(F.col("column") == "n_name", "int").otherwise(F.col("type")))
    extra = spark.createDataFrame([("nation", "n_code", "string"), ("archive", "id", "int")], "`table` string, `column` string, type string")
    return C.drift(was.unionByName(extra), live).select("drift_type", "table", "column", "severity", "healed")


@R.add("""SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""", "orders")
def enum_harvest(orders):
    """Columns of few values, with counts."""
    return C.enumerations(orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


def _links(spark, sf_dir):
    """The links that the rows of all tables bear out."""
    return keys.discover({t: table(spark, sf_dir, t) for t in TABLES})


# The whole-number columns that share a stem, by table.
STEMS = {"region": ["r_regionkey"], "nation": ["n_regionkey", "n_nationkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "documents": ["doc_id"], "labels": ["doc_id"]}
CELLS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, '{keys.stem(c)}' AS stem, CAST({c} AS BIGINT) AS v FROM {t}" for t, cs in STEMS.items() for c in cs)
LINKS_SQL = f"""cells AS ({CELLS_SQL}), vals AS (SELECT tab, col, stem, v, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL), cols AS (SELECT tab, col, stem, count(*) AS distinct_values, max(n) = 1 AS is_key FROM vals GROUP BY ALL),
links AS (SELECT f.tab AS from_table, f.col AS from_column, t.tab AS to_table, t.col AS to_column, f.distinct_values FROM cols f JOIN cols t ON f.stem = t.stem AND f.tab <> t.tab AND t.is_key
WHERE (SELECT count(*) FROM vals a JOIN vals b ON a.v = b.v WHERE a.tab = f.tab AND a.col = f.col AND b.tab = t.tab AND b.col = t.col) = f.distinct_values), ways AS (SELECT from_table AS a, to_table AS b FROM links UNION SELECT to_table, from_table FROM links)"""


@R.add(f"WITH {LINKS_SQL} SELECT * FROM links")
def inferred_keys(spark, sf_dir):
    """Links that column names suggest, kept where every value is found in the other table."""
    return _links(spark, sf_dir)


@R.add(f"WITH {LINKS_SQL} SELECT x AS \"table\", CAST(count(*) AS INTEGER) AS links FROM (SELECT from_table AS x, to_table AS y FROM links UNION ALL SELECT to_table, from_table FROM links) WHERE y IN ('orders', 'part') AND x NOT IN ('orders', 'part') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def neighbour_rank(spark, sf_dir):
    """Tables with most links to orders and part."""
    active = spark.createDataFrame([("orders",), ("part",)], "`table` string")
    return C.rank_neighbours(_links(spark, sf_dir), active).withColumn("links", F.col("links").cast("int"))


@R.add(f"WITH {LINKS_SQL} SELECT b AS \"table\" FROM ways WHERE a = 'orders'")
def schema_neighbours(spark, sf_dir):
    return C.neighbours(_links(spark, sf_dir), spark.createDataFrame([("orders",)], "`table` string"))


@R.add(f"WITH {LINKS_SQL}, active AS (SELECT unnest(['orders', 'customer', 'lineitem']) AS t) SELECT from_table, string_agg(from_column || '->' || to_table || '.' || to_column, ', ' ORDER BY from_column || '->' || to_table || '.' || to_column) AS edges FROM links WHERE from_table IN (FROM active) AND to_table IN (FROM active) GROUP BY 1")
def scoped_relationships(spark, sf_dir):
    return C.scoped_relationships(_links(spark, sf_dir), spark.createDataFrame([("orders",), ("customer",), ("lineitem",)], "`table` string"))


#: A join path of three tables for each event, out of these.
JOINED = ["customer", "orders", "lineitem", "part", "supplier", "nation", "region"]
PATHS_SQL = f"(SELECT event_id AS path_id, list_transform([0, event_id // 7, event_id // 49], lambda x: ({JOINED})[1 + CAST((event_id + x) % 7 AS INTEGER)]) AS t FROM events)"


@R.add(f"WITH {LINKS_SQL} SELECT path_id, a, b FROM (SELECT path_id, t[1] AS a, t[2] AS b FROM {PATHS_SQL} UNION ALL SELECT path_id, t[2], t[3] FROM {PATHS_SQL}) WHERE (a, b) NOT IN (SELECT (ways.a, ways.b) FROM ways)")
def join_path_check(spark, sf_dir):
    """Steps of join paths that no link connects; a path for each event."""
    at = lambda x: F.get(F.array(*map(F.lit, JOINED)), ((F.col("event_id") + x) % 7).cast("int"))
    paths = table(spark, sf_dir, "events").select(F.col("event_id").alias("path_id"), F.array(at(F.lit(0)), at(F.expr("event_id div 7")), at(F.expr("event_id div 49"))).alias("tables"))
    return C.invalid_joins(_links(spark, sf_dir), paths).select("path_id", "a", "b")


@R.add(f"WITH RECURSIVE {LINKS_SQL}, reach AS (SELECT 'customer' AS t, 0 AS hops UNION SELECT b, hops + 1 FROM reach JOIN ways ON a = t WHERE hops < 9) SELECT t AS \"table\", CAST(min(hops) AS INTEGER) AS hops FROM reach GROUP BY 1")
def schema_reach(spark, sf_dir):
    """All tables that joins connect with customers, by the number of joins."""
    return C.reachable(spark, _links(spark, sf_dir), "customer")


@R.add("SELECT * FROM (VALUES ('region', 'region: r_regionkey(int), r_name(varchar)'), ('nation', 'nation: n_nationkey(int), n_name(varchar), n_regionkey(int)')) t(\"table\", description)")
def schema_compact(spark, sf_dir):
    return C.compact(_columns(spark, sf_dir).filter("`table` in ('region', 'nation')"))


GLOSSARY = [("revenue", ["sales value", "turnover"]), ("customer", ["client", "buyer"]), ("order", ["sales order"])]
GLOSSARY_ROWS = ", ".join(f"('{concept}', '{x}')" for concept, synonyms in GLOSSARY for x in [*synonyms, concept])


@R.add(f"""WITH asked AS (SELECT question_id, list_transform(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: regexp_replace(regexp_replace(x, 'ies$', 'y'), '([^s])s$', '\\1')) AS w FROM {ASKED}), own AS (SELECT question_id, unnest(list_distinct({runs_sql("w", (1, 2, 3))})) AS phrase FROM asked)
SELECT question_id, concept, row_number() OVER (PARTITION BY question_id ORDER BY max(length(phrase)) DESC, concept) AS place FROM own JOIN (VALUES {GLOSSARY_ROWS}) g(concept, phrase) USING (phrase) GROUP BY question_id, concept""", "conversations")
def glossary_match(conversations):
    """Concepts of the glossary in every question."""
    glossary = conversations.sparkSession.createDataFrame(GLOSSARY, "concept string, synonyms array<string>")
    return C.match_glossary(questions(conversations), glossary).withColumn("place", F.col("place").cast("long"))


@R.add("SELECT * FROM (VALUES ('orders.o_missing', 'ghost')) t(maps_to, term)")
def glossary_drift(spark, sf_dir):
    glossary = spark.createDataFrame([("status", "orders.o_orderstatus"), ("ghost", "orders.o_missing")], "term string, maps_to string")
    return C.glossary_drift(glossary, _columns(spark, sf_dir)).select("maps_to", "term")


# Shapes of statements; N is a number, V a text of the event that a statement is logged for.
STATEMENTS = [
    "SELECT n_name FROM nation WHERE n_nationkey = N", "SELECT * FROM nation WHERE n_nationkey = N", "SELECT count(*) FROM nation, region WHERE r_regionkey > N", "DROP TABLE nation", "SELECT sleep(N)", "SELECT n_name FROM nation WHERE n_name = NULL",
    "SELECT N; SELECT 2", "WITH nation AS (SELECT N AS x) SELECT x FROM nation", "SELECT * FROM parquet.`/etc`", "SELECT missing FROM nation WHERE n_name = 'V'", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "SELECT n_name FROM nation WHERE n_name LIKE 'a very long pattern that nobody would ever have typed by hand V'", "SELECT o_orderkey FROM orders WHERE o_orderdate > '2099-01-01' AND o_custkey = N", "INSERT INTO nation SELECT * FROM nation", "SELECT java_method('java.lang.System', 'V')", None,
]
LOG_SQL = f"(SELECT event_id, CAST(event_id % {len(STATEMENTS)} AS INTEGER) AS shape FROM events)"


def _statements(events):
    """A log of statements: one of the shapes for each event, with its values."""
    shape = F.get(F.array(*map(F.lit, STATEMENTS)), F.pmod("event_id", F.lit(len(STATEMENTS))).cast("int"))
    return events.select("event_id", F.regexp_replace(F.regexp_replace(shape, r"\bN\b", F.col("user_id").cast("string")), r"\bV\b", F.col("event_type")).alias("sql"))


# What each shape of STATEMENTS has to give, in their order: allowed, cartesian, warnings.
VERDICTS = [
    (True, False, ""), (True, False, "selects all columns"), (True, True, "cartesian product"), (False, False, ""), (False, False, ""), (True, False, "compares with NULL"), (False, False, ""), (False, False, ""),
    (False, False, ""), (False, False, ""), (True, False, "joins without a filter"), (True, False, ""), (True, False, ""), (False, False, ""), (False, False, ""), (False, False, ""),
]


@R.add(f"SELECT event_id, ok, cartesian, warnings FROM {LOG_SQL} JOIN (VALUES {', '.join(f'({k}, {ok}, {product}, {chr(39)}{w}{chr(39)})' for k, (ok, product, w) in enumerate(VERDICTS))}) t(shape, ok, cartesian, warnings) USING (shape)", "events", "nation", "region", "orders")
def statement_verdicts(events, nation, region, orders):
    """A log of statements checked by Spark's own parser and analyser, each shape once; nothing is run."""
    views.register({"nation": nation, "region": region, "orders": orders})
    return G.verdicts(_statements(events), ["nation", "region", "orders"]).select("event_id", "ok", "cartesian", "warnings")


# What lint has to find in each shape of STATEMENTS, in their order.
FINDINGS = ["", "select_star", "cartesian", "not_read_only", "blocked_function", "null_comparison", "many_statements", "", "select_star", "", "unfiltered_join", "long_pattern", "far_future", "not_read_only,select_star", "blocked_function", "not_read_only"]
VALID = "valid_empty"
EMPTY = {10: "suspicious_empty", 11: "suspicious_empty", 12: "suspicious_empty"}


@R.add(f"SELECT event_id, findings, empty_class FROM {LOG_SQL} JOIN (VALUES {', '.join(f'({k}, {chr(39)}{x}{chr(39)}, {chr(39)}{EMPTY.get(k, VALID)}{chr(39)})' for k, x in enumerate(FINDINGS))}) t(shape, findings, empty_class) USING (shape)", "events")
def statement_lint(events):
    """Findings over a log of statements, as expressions."""
    log = _statements(events)
    out = G.lint(log).withColumn("empty_class", G.empty_result_class())
    names = [c for c in out.columns if c not in (*log.columns, "empty_class")]
    return out.select("event_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(c), c) for c in names])), ",").alias("findings"), "empty_class")


@R.add("SELECT n_name, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def governed_select(spark, sf_dir):
    """A checked statement over governed views, with a row cap."""
    views.register({t: table(spark, sf_dir, t) for t in ("nation", "customer")})
    return G.run(spark, "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name", ["nation", "customer"])


@R.add("""SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ON c_custkey = o_custkey GROUP BY 1""")
def soft_deleted_view(spark, sf_dir):
    """Deleted orders are filtered in the view, so customers without active orders stay."""
    orders = table(spark, sf_dir, "orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    live = views.active(orders, "ACTIVE_ONLY")
    return table(spark, sf_dir, "customer").join(live, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@R.add("""SELECT event_id, event_type AS stage, value AS latency_ms, CAST(event_id % 2 = 0 AS BOOLEAN) AS success FROM events WHERE event_id % 5 <> 0""", "events")
def telemetry_lines(events):
    """JSON lines, some behind a log prefix and some broken, as events."""
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("query_id"), F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"), (F.col("event_id") % 2 == 0).alias("success")))
    k = F.col("event_id") % 5
    lines = events.select(F.when(k == 0, F.concat(F.lit("{broken "), body)).when(k == 1, F.concat(F.lit("INFO telemetry: "), body)).otherwise(body).alias("value"))
    out = jsonl.parse_events(lines)
    return out.select(F.col("query_id").cast("long").alias("event_id"), "stage", "latency_ms", "success")


@R.add("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Tumbling windows over a stream of the table's files, run to its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    name = f"tessera_windows_{next(tempfile._get_candidate_names())}"
    stream = S.windowed(S.read_events(spark, f"{sf_dir}/events.parquet*", schema), "event_type", "ts", "6 hours", late="40 days")
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


@R.add("SELECT w AS worst, lang, n FROM (SELECT lang, n_chars AS w, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r <= 5", "documents")
def worst_five(documents):
    """The five lowest of each group, with its size."""
    w = Window.partitionBy("lang")
    out = documents.select("lang", F.col("n_chars").alias("worst"), F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("n_chars", "doc_id")).alias("r"))
    return out.filter("r <= 5").drop("r")
