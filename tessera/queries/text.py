"""Text measures, chunking, classification and scrubbing on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import classify as C, privacy as P, text as T
from ..operators import chunking as K, dedup as D
from ..plans import semantic as S
from ..sources.files import html_to_text
from .registry import Registry

R = Registry()

LINES = r"\n+"


@R.add("SELECT doc_id, greatest(1, length(text) // 4) AS tokens, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(greatest(1, floor(length(trim(text)) / 4.0 + 0.5)), floor(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) * 1.3)) END::BIGINT AS dense_tokens, length(text) // 3 AS context_tokens FROM documents", "documents")
def token_estimate(documents):
    return documents.select("doc_id", T.token_estimate("text").alias("tokens"), T.token_estimate_dense("text").alias("dense_tokens"), T.context_estimate("text").alias("context_tokens"))


@R.add(r"""SELECT doc_id, CAST(len(regexp_extract_all('# ' || replace(text, '. ', chr(10) || '## '), '(?m)^(#{1,4})[ \t]+(\S.*)$')) AS BIGINT) AS headings FROM documents""", "documents")
def heading_counts(documents):
    """Sentences as second-level headings, since the texts have few of their own."""
    return documents.select("doc_id", T.heading_count(F.concat(F.lit("# "), F.expr(r"replace(text, '. ', '\n## ')"))).alias("headings"))


@R.add(None, "documents")
def chunk_documents(documents):
    """Chunks of whole texts; a paragraph ends at a line break. A fold in order has no plain SQL form."""
    return K.chunk_prose(documents, "doc_id", "text", separator=LINES)


@R.add("""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS BIGINT) AS paragraphs, CAST(coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''), lambda x: greatest(1, length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) // 4))), 0) AS BIGINT) AS tokens FROM documents""", "documents")
def paragraph_stats(documents):
    p = K.paragraphs(F.col("text"), LINES)
    return documents.select("doc_id", F.size(p).cast("long").alias("paragraphs"), F.aggregate(F.transform(p, T.token_estimate), F.lit(0).cast("long"), lambda s, x: s + x).alias("tokens"))


@R.add(None, "documents")
def chunk_parents(documents):
    """Section leaders of chunked documents."""
    return K.with_parents(K.chunk_prose(documents, "doc_id", "text", separator=LINES), "doc_id").select("chunk_id", "parent_chunk_id")


@R.add(None, "pages")
def html_text(pages):
    """Visible text of pages, a line for each piece."""
    return html_to_text(pages, "html").select("page_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


@R.add("SELECT doc_id, CASE WHEN length(trim(text)) < 100 THEN 'scanned' WHEN doc_id % 4 = 0 AND length(trim(text)) < 300 THEN 'mixed' ELSE 'native_text' END AS structure FROM documents", "documents")
def page_structure_class(documents):
    return documents.select("doc_id", T.page_structure("text", F.col("doc_id") % 4 == 0).alias("structure"))


@R.add("SELECT doc_id, CASE WHEN contains(s, 'abstract') AND contains(s, 'introduction') AND contains(s, 'references') THEN 'scientific_paper' WHEN contains(s, 'invoice') AND (contains(s, 'total') OR contains(s, 'due') OR contains(s, 'tax')) THEN 'invoice' WHEN contains(s, 'financial') AND (contains(s, 'revenue') OR contains(s, 'earnings') OR contains(s, 'quarterly')) THEN 'financial_report' ELSE 'general' END AS kind FROM (SELECT doc_id, lower(substr(text, 1, 2000)) AS s FROM documents)", "documents")
def document_type(documents):
    """By words on the first page, which is where a kind shows."""
    return documents.select("doc_id", T.document_type("text").alias("kind"))


@R.add(None, "documents")
def text_quality(documents):
    """Quality of recognised text; word classes of the two engines differ outside ASCII, so tests hold it to a model."""
    return documents.select("doc_id", T.recognition_quality("text").alias("q")).select("doc_id", "q.*")


#: Texts as tables: a row for each line, a cell for each piece between commas.
CELLS_SQL = "(SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: string_split(x, ', ')) AS r FROM documents)"


def _cells(documents):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return documents.select("doc_id", F.transform(lines, lambda x: F.split(x, ", ")).alias("r"))


@R.add(f"""WITH t AS (SELECT doc_id, r, list_transform(r, lambda x: len(x)) AS widths, flatten(r) AS cells FROM {CELLS_SQL}),
f AS (SELECT doc_id, CAST(len(r) < 2 AS INTEGER) + CAST(list_max(widths) < 2 AS INTEGER) + CAST(len(list_distinct(widths)) > 1 AS INTEGER) + CAST(len(list_filter(cells, lambda x: trim(x) = '')) * 2 > len(cells) AS INTEGER) AS faults FROM t) SELECT doc_id, CAST(greatest(0, 1 - 0.25 * faults) AS DOUBLE) AS score, faults = 0 AS acceptable FROM f""", "documents")
def table_quality(documents):
    """A quarter off for each structural fault of a text that is read as a table."""
    return _cells(documents).select("doc_id", T.table_quality("r").alias("q")).select("doc_id", F.col("q.score").cast("double").alias("score"), "q.acceptable")


@R.add(f"SELECT doc_id, array_to_string(list_concat(list_concat(['| ' || array_to_string(r[1], ' | ') || ' |'], ['| ' || array_to_string(list_resize(['---'], len(r[1]), '---'), ' | ') || ' |']), list_transform(r[2:], lambda x: '| ' || array_to_string(list_resize(x, len(r[1]), ''), ' | ') || ' |')), chr(10)) AS table_text FROM {CELLS_SQL}", "documents")
def table_markdown(documents):
    """Ragged rows of texts as markdown tables."""
    return _cells(documents).select("doc_id", T.rows_to_markdown("r").alias("table_text"))


@R.add("SELECT a.conv_id, a.turn, round(CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END, 4) AS overlap FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM conversations) a JOIN (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS y FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1", "conversations")
def turn_overlap(conversations):
    """Jaccard overlap of a turn with the one before."""
    now = conversations.select("conv_id", "turn", T.dedup_tokens("text").alias("x"))
    before = now.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("x").alias("y"))
    return now.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("x"), F.col("y")), 4).alias("overlap"))


@R.add("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(bearer\\s+[a-zA-Z0-9_\\-\\.]{20,}|(sk|pk|api|key)[-_][a-zA-Z0-9]{16,})', '[API_KEY]', 'gi'), '((password|passwd|pwd|secret|key)\\s*=\\s*)[^\\s;&,''\"]+', '\\1[PASSWORD]', 'gi'), '\\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+\\b', '[EMAIL]', 'g'), '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b', '[SSN]', 'g'), '\\b([0-9]{4}[-\\s]?){3}[0-9]{4}\\b', '[CC]', 'g'), '\\b(\\+?[0-9]{1,3}[-.\\s]?)?\\(?[0-9]{3}\\)?[-.\\s]?[0-9]{3}[-.\\s]?[0-9]{4}\\b', '[PHONE]', 'g') AS clean FROM documents", "documents")
def pii_scrub(documents):
    """Texts with personal data and credentials masked."""
    return documents.select("doc_id", P.scrub("text").alias("clean"))


@R.add("SELECT doc_id, sha1(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS fingerprint, row_number() OVER (PARTITION BY sha1(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) ORDER BY doc_id) AS copy_rank FROM documents", "documents")
def exact_copies(documents):
    return D.exact_copies(documents, "text", [F.asc("doc_id")]).select("doc_id", "fingerprint", F.col("copy_rank").cast("long").alias("copy_rank"))


def _results(documents):
    """Result lists: every document is in one list of forty neighbouring ids, in their order."""
    return documents.select(F.expr("doc_id div 40").alias("query_id"), "doc_id", "text", F.col("doc_id").alias("place"))


@R.add(None, "documents")
def near_duplicate_suppression(documents):
    """What stays of each result list; the greedy rule depends on order and is held to a model in tests."""
    return D.suppress(_results(documents), "query_id", "doc_id", "text", "place")


QUESTIONS = [
    "How many orders were placed last month?", "Total revenue by customer this year", "List all products", "What is the refund policy?", "Why did sales drop in March 2024?", "Show me the top 10 suppliers", "compare it with the previous one",
    "deleted orders of active customers", "orders of the past 6 months", "archived invoices", "What files do you have?", "How many files did customer Acme upload", "Draw a chart of stock by warehouse", "Summarize the handbook",
    "stock of PX100 / what does the SOP say about returns", "open orders and the travel policy document", "new question: what is the headcount", "", "enumerate all locations", "average order value in 2023-04-01 to 2023-04-30", "what about them?",
]


def _listed(parts) -> str:
    """A list of strings in SQL."""
    return "[" + ", ".join("NULL" if p is None else "'" + p.replace("'", "''") + "'" for p in parts) + "]"


#: Every turn of the conversations as a question: one of the phrases, then the turn's own text.
ASKED = f"(SELECT concat_ws(':', conv_id, turn) AS question_id, ({_listed(QUESTIONS)})[1 + CAST((coalesce(conv_id, 0) * 5 + coalesce(turn, 0)) % {len(QUESTIONS)} AS INTEGER)] || ' ' || coalesce(text, '') AS question FROM conversations)"


def questions(conversations):
    """(question_id, question) of every turn; see ASKED."""
    which = F.pmod(F.coalesce("conv_id", F.lit(0)) * 5 + F.coalesce("turn", F.lit(0)), F.lit(len(QUESTIONS))).cast("int")
    phrase = F.get(F.array(*map(F.lit, QUESTIONS)), which)
    return conversations.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("question"))


def _any_sql(parts):
    return "(" + " OR ".join("contains(q, '{}')".format(p.replace("'", "''")) for p in parts) + ")"


@R.add(f"""SELECT question_id, CASE WHEN q = '' THEN 'OTHER' {' '.join(f"WHEN {_any_sql(ps)} THEN '{n}'" for n, ps in C.QUERY_TYPES)} ELSE 'OTHER' END AS kind FROM (SELECT question_id, lower(trim(question)) AS q FROM {ASKED})""", "conversations")
def query_type(conversations):
    return questions(conversations).select("question_id", C.query_type("question").alias("kind"))


@R.add(f"""SELECT question_id, CASE WHEN q = '' THEN 'explanation' WHEN regexp_matches(q, '(^|[^\\pL\\pN_])({C.EXPLAIN_WORDS})($|[^\\pL\\pN_])') THEN 'explanation' WHEN regexp_matches(q, '^(list|show me|show|fetch|get|display|find|give me|top)\\b') AND NOT regexp_matches(q, '(^|[^\\pL\\pN_])(total|sum|average|avg|how many|how much)($|[^\\pL\\pN_])') THEN 'list'
WHEN regexp_matches(q, '(^|[^\\pL\\pN_])({C.AGGREGATE_WORDS})($|[^\\pL\\pN_])') THEN 'aggregate' WHEN regexp_matches(q, '(^|[^\\pL\\pN_])({C.LIST_WORDS})($|[^\\pL\\pN_])') THEN 'list' ELSE 'explanation' END AS intent, {_any_sql(C.EXHAUSTIVE)} AS exhaustive, {_any_sql(C.VISUAL)} AS visual,
{_any_sql(C.LISTING)} AND NOT regexp_matches(q, '\\b{C.LISTING_ENTITIES}\\b') AS listing FROM (SELECT question_id, lower(trim(question)) AS q FROM {ASKED})""", "conversations")
def query_intent(conversations):
    return questions(conversations).select("question_id", C.query_intent("question").alias("intent"), C.is_exhaustive("question").alias("exhaustive"), C.is_visual("question").alias("visual"), C.is_listing("question").alias("listing"))


def _signal_sql(words, phrases, codes):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"(len(list_intersect(regexp_extract_all(q, '\\b[a-z0-9_-]+\\b'), [{listed}])) > 0 OR {_any_sql(phrases)}{codes})"


@R.add(f"""SELECT question_id, CASE WHEN d AND NOT t THEN 'sql' WHEN t AND NOT d THEN 'rag' ELSE 'hybrid' END AS route FROM (SELECT question_id, {_signal_sql(C.DATA_WORDS, C.DATA_PHRASES, " OR regexp_matches(q, '\\b[a-z]+[0-9]+[a-z0-9_-]*\\b')")} AS d, {_signal_sql(C.DOCUMENT_WORDS, C.DOCUMENT_PHRASES, "")} AS t FROM (SELECT question_id, lower(question) AS q FROM {ASKED}))""", "conversations")
def route_classify(conversations):
    return questions(conversations).select("question_id", C.route("question").alias("route"))


def _data_sql(q):
    return _signal_sql(C.DATA_WORDS, C.DATA_PHRASES, " OR regexp_matches(q, '\\b[a-z]+[0-9]+[a-z0-9_-]*\\b')").replace("(q, ", f"({q}, ")


def _document_sql(q):
    return _signal_sql(C.DOCUMENT_WORDS, C.DOCUMENT_PHRASES, "").replace("(q, ", f"({q}, ")


@R.add(f"""WITH asked AS (SELECT row_number() OVER () AS rid, question_id, question FROM {ASKED}),
parts AS (SELECT rid, k, strict, trim(regexp_extract(question, p, 1)) AS one, trim(regexp_extract(question, p, 2)) AS two FROM asked, (VALUES (1, '(?s)^(.*?)\\s+/\\s+(.*)$', FALSE), (2, '(?s)^(.*?)\\s+\\|\\s+(.*)$', FALSE),
(3, '(?s)^(.*?)\\s+;\\s+(.*)$', FALSE), (4, '(?s)^(.*?)\\s+--\\s+(.*)$', FALSE), (5, '(?is)^(.*?)\\s+(?:and|&)\\s+(.*)$', TRUE)) m(k, p, strict) WHERE regexp_matches(question, p) AND (NOT strict OR len(regexp_extract_all(question, '(?i)\\s+(?:and|&)\\s+')) = 1)),
told AS (SELECT rid, k, strict, one, two, {_data_sql("lower(one)")} AS s1, {_document_sql("lower(one)")} AS d1, {_data_sql("lower(two)")} AS s2, {_document_sql("lower(two)")} AS d2 FROM parts),
chosen AS (SELECT rid, k, one, two, CASE WHEN s1 AND d2 AND NOT d1 THEN TRUE WHEN s2 AND d1 AND NOT d2 THEN FALSE WHEN NOT strict AND s1 AND d2 THEN TRUE WHEN NOT strict AND s2 AND d1 THEN FALSE END AS forth FROM told),
firsts AS (SELECT rid, CASE WHEN forth THEN one ELSE two END AS sql, CASE WHEN forth THEN two ELSE one END AS doc FROM chosen WHERE forth IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY k) = 1)
SELECT question_id, coalesce(sql, question) AS sql, coalesce(doc, question) AS doc FROM asked LEFT JOIN firsts USING (rid)""", "conversations")
def hybrid_split(conversations):
    """Compound questions cut into the part for the database and the part for documents."""
    return questions(conversations).select("question_id", C.split_hybrid("question").alias("p")).select("question_id", "p.*")


@R.add(f"""SELECT question_id, CASE WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(deleted|removed|dropped|gone)($|[^\\pL\\pN_])') AND regexp_matches(q, '(^|[^\\pL\\pN_])(active|current|present|live|existing)($|[^\\pL\\pN_])') THEN 'INCLUDE_ARCHIVED' WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(deleted|removed|dropped|gone)($|[^\\pL\\pN_])') THEN 'DELETED_ONLY'
WHEN regexp_matches(regexp_replace(q, '\\bpast\\s+(few\\s+)?([0-9]+\\s+)?(days?|weeks?|months?|quarters?|years?)\\b', '', 'g'), '(^|[^\\pL\\pN_])(archived|history|audit|historical|past)($|[^\\pL\\pN_])') THEN 'INCLUDE_ARCHIVED' ELSE 'ACTIVE_ONLY' END AS records FROM (SELECT question_id, lower(question) AS q FROM {ASKED})""", "conversations")
def soft_delete_intent(conversations):
    return questions(conversations).select("question_id", C.soft_delete_intent("question").alias("records"))


def _first_sql(table):
    return "CASE " + " ".join(f"WHEN {_any_sql(words)} THEN '{name}'" for name, words in table) + " END"


def _named_sql(table):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_any_sql(words)} THEN '{name}' END" for name, words in table) + ")"


PERIOD_WORDS = [(p, [p, p.replace("last", "past"), p.replace("last", "previous"), p.replace("this", "current")]) for p in S.PERIODS]


@R.add(f"""WITH i AS (SELECT question_id, q, {_first_sql(S.METRIC_WORDS)} AS metric, {_named_sql(S.DIMENSION_WORDS)} AS dimensions, {_named_sql(S.FILTER_WORDS)} AS filters, {_first_sql(PERIOD_WORDS)} AS period,
CASE WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(how many|count|number of)($|[^\\pL\\pN_])') THEN 'COUNT' WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(how much|total|sum|overall)($|[^\\pL\\pN_])') THEN 'SUM' WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(average|mean|avg)($|[^\\pL\\pN_])') THEN 'AVG' END AS aggregation,
nullif(regexp_extract(q, '\\btop\\s+(\\d+)\\b', 1), '') AS top, regexp_matches(q, '(^|[^\\pL\\pN_])(best|highest|top|most|maximum|greatest)($|[^\\pL\\pN_])') AS best, regexp_matches(q, '(^|[^\\pL\\pN_])(lowest|worst|least|minimum|cheapest)($|[^\\pL\\pN_])') AS worst FROM (SELECT question_id, lower(question) AS q FROM {ASKED}))
SELECT question_id, metric, dimensions, filters, period, aggregation, CASE WHEN top IS NOT NULL THEN CAST(top AS INTEGER) WHEN best OR worst THEN 1 END AS rows, CASE WHEN top IS NOT NULL OR best THEN TRUE WHEN worst THEN FALSE END AS descending,
CASE WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(current|this year|this financial year|this fiscal year|ongoing|present year)($|[^\\pL\\pN_])') THEN 'CURRENT_YEAR' WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(total|all|all-time|all time|history|historical|overall|cumulative|ever|lifetime|entire)($|[^\\pL\\pN_])') OR aggregation IS NOT NULL OR period IS NULL THEN 'ALL_TIME' ELSE 'SPECIFIC_PERIOD' END AS scope,
CASE WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(deleted|removed|dropped|gone)($|[^\\pL\\pN_])') AND regexp_matches(q, '(^|[^\\pL\\pN_])(active|current|present|live|existing)($|[^\\pL\\pN_])') THEN 'INCLUDE_ARCHIVED' WHEN regexp_matches(q, '(^|[^\\pL\\pN_])(deleted|removed|dropped|gone)($|[^\\pL\\pN_])') THEN 'DELETED_ONLY'
WHEN regexp_matches(regexp_replace(q, '\\bpast\\s+(few\\s+)?([0-9]+\\s+)?(days?|weeks?|months?|quarters?|years?)\\b', '', 'g'), '(^|[^\\pL\\pN_])(archived|history|audit|historical|past)($|[^\\pL\\pN_])') THEN 'INCLUDE_ARCHIVED' ELSE 'ACTIVE_ONLY' END AS records FROM i""", "conversations")
def analytical_intent(conversations):
    """Metrics, dimensions, filters and periods of questions; lists as text."""
    i = questions(conversations).select("question_id", S.intent("question").alias("i")).select("question_id", "i.*")
    return i.withColumns({c: F.array_join(c, ",") for c in ("dimensions", "filters")})


@R.add(f"""WITH c AS (SELECT conv_id, turn, turn > min(turn) OVER (PARTITION BY conv_id) AS history, lower(coalesce(text, '')) AS q, trim(lower(coalesce(text, ''))) AS t, len(regexp_split_to_array(trim(lower(coalesce(text, ''))), '\\s+')) AS n FROM conversations)
SELECT conv_id, turn, t <> '' AND (n <= 4 OR regexp_matches(t, '(^|[^\\pL\\pN_])({C.FOLLOW_UP.replace("'", "''")})($|[^\\pL\\pN_])')) AS follow_up, CASE WHEN {_any_sql(C.RESET)} THEN 'RESET' WHEN {_any_sql(C.REFINE)} OR regexp_matches(q, '(^|[^\\pL\\pN_])({C.VAGUE})($|[^\\pL\\pN_])') THEN CASE WHEN history THEN 'REFINE' ELSE 'ASK' END WHEN history AND n < 10 THEN 'REFINE' ELSE 'RESET' END AS action,
CASE {" ".join(f"WHEN {_any_sql(words)} THEN '{name}'" for name, words in C.TASKS)} ELSE 'general_qa' END AS task, regexp_matches(q, '{C.TEMPORAL}') AS temporal FROM c""", "conversations")
def conversation_context(conversations):
    """Follow-ups and what each turn does to the context of its conversation."""
    first = F.col("turn") > F.min("turn").over(Window.partitionBy("conv_id"))
    return conversations.select("conv_id", "turn", C.is_follow_up("text").alias("follow_up"), C.context_action("text", first).alias("action"), C.query_task("text").alias("task"), C.temporal_intent("text").alias("temporal"))


def _expanded_sql(terms):
    out = "'hq of ' || text || ' YOY'"
    for term, full in terms.items():
        out = f"regexp_replace({out}, '\\b{term}\\b', '{full}', 'gi')"
    return out


@R.add(f"SELECT doc_id, {_expanded_sql(T.ACRONYMS)} AS expanded FROM documents", "documents")
def acronym_expansion(documents):
    """All terms, in whole texts."""
    return documents.select("doc_id", T.expand_acronyms(F.concat(F.lit("hq of "), "text", F.lit(" YOY"))).alias("expanded"))


ERRORS = ["Unknown column 'x' in field list", "no such table: foo", "429 rate limit", "request timed out", "syntax error near SELECT", "deleted_at filter missing", "read-only violation: DROP TABLE x", "schema not found in schema embedding", "no rows", "access denied for user", "ambiguous entity Acme", "boom", None, "Traceback (most recent call last):\n  File \"/a/b.py\", line 1\nValueError: password=abc in /srv/app/x.py\nsecond line"]


def _signs_sql(table, default):
    return f"CASE WHEN error IS NULL THEN '{default}' " + " ".join("WHEN " + " AND ".join(_any_sql(g).replace("contains(q, ", "contains(lower(error), ") for g in groups) + f" THEN '{name}'" for name, groups in table) + f" ELSE '{default}' END"


@R.add(f"""WITH e AS (SELECT event_id, ({_listed(ERRORS)})[1 + CAST(event_id % {len(ERRORS)} AS INTEGER)] || ' in call ' || event_id || ' of ' || event_type || ' password=' || user_id AS error FROM events),
c AS (SELECT event_id, trim(regexp_replace(trim(error), '(?s)Traceback \\(most recent call last\\):.*?([a-zA-Z0-9_]+Error:|\\z)', '\\1', 'g')) AS t FROM e),
l AS (SELECT event_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '((password|passwd|pwd|secret|key)=)[^\\s;&,]+', '\\1***', 'gi'), '(?:/[a-zA-Z0-9_.\\-]+)+', '[path]', 'g'), '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM c)
SELECT event_id, {_signs_sql(C.FAILURES, "unknown")} AS category, {_signs_sql(C.TELEMETRY_FAILURES, "unknown_error")} AS telemetry_type, CASE WHEN lines IS NULL OR len(lines) = 0 THEN 'unknown_error' WHEN length(array_to_string(lines, ' | ')) > 500 THEN substr(array_to_string(lines, ' | '), 1, 497) || '...' ELSE array_to_string(lines, ' | ') END AS clean FROM e JOIN l USING (event_id)""", "events")
def error_classes(events):
    """Failure categories, telemetry types and clean texts of the errors of all events, null where an event has none."""
    message = F.get(F.array(*map(F.lit, ERRORS)), F.pmod("event_id", F.lit(len(ERRORS))).cast("int"))
    e = events.select("event_id", F.concat(message, F.lit(" in call "), F.col("event_id").cast("string"), F.lit(" of "), "event_type", F.lit(" password="), F.col("user_id").cast("string")).alias("error"))
    return e.select("event_id", C.failure_category("error").alias("category"), C.telemetry_failure("error").alias("telemetry_type"), P.normalise_error("error").alias("clean"))


@R.add(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 1 THEN text || chr(10) || 'SQL Query Executed: `SELECT 1`' || chr(10) || '| a |' || chr(10) || '| 1 |' ELSE coalesce(text, '') END, '^\s+|\s+\z', '', 'g') AS t FROM conversations),
p AS (SELECT *, position('SQL Query Executed:' IN t) AS place, trim(regexp_extract(t, '(?s)SQL Query Executed:\s*`(.*?)`', 1)) AS s FROM c),
n AS (SELECT *, CASE WHEN s = '' THEN '[A live database result was shown to the user.]' ELSE '[Database result omitted. SQL executed: ' || s || ']' END AS note, CASE WHEN conv_id % 2 = 0 THEN regexp_replace(substr(t, 1, greatest(place - 1, 0)), '^\s+|\s+\z', '', 'g') ELSE '' END AS head FROM p)
SELECT conv_id, turn, CASE WHEN place = 0 THEN t WHEN head = '' THEN note ELSE head || chr(10) || chr(10) || note END AS clean FROM n""", "conversations")
def history_sanitise(conversations):
    """Assistant turns without database rows."""
    turn = F.when(F.col("turn") % 2 == 1, F.concat(F.col("text"), F.lit("\nSQL Query Executed: `SELECT 1`\n| a |\n| 1 |"))).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", P.sanitise_turn(turn, F.when(F.col("conv_id") % 2 == 0, "some-model").otherwise("sql/direct")).alias("clean"))


def runs_sql(w: str, lengths) -> str:
    """All runs of so many neighbours in a list of words, in SQL; the shortest first."""
    return "list_concat(" + ", ".join(f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string(list_slice({w}, i, i + {n} - 1), ' '))" for n in lengths) + ")"


#: Questions (question_id, w), w being their lower-case words.
ASKED_WORDS = f"(SELECT question_id, list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '') AS w FROM {ASKED})"


@R.add(f"""SELECT question_id, array_to_string(list_slice(list_filter({runs_sql("w", (2, 3, 4))}, lambda p: NOT ({" OR ".join(f"contains(p, '{x}')" for x in ("the", "a", "an", "is", "are", "was", "were"))})), 1, 10), ' | ') AS phrases FROM {ASKED_WORDS}""", "conversations")
def trigger_phrases(conversations):
    """The first ten phrases of questions that could set off a learned pattern, as text."""
    return questions(conversations).select("question_id", F.array_join(T.trigger_phrases("question"), " | ").alias("phrases"))
