"""Rule-based classification of questions, errors and statements, as ordered CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def _low(x: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))


def has_any(text: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def has_word(text: Column, words: str) -> Column:
    return text.rlike(rf"\b({words})\b")


# Phrases by query type, in order of precedence.
QUERY_TYPES = [
    ("POLICY", ["policy", "procedure", "guideline", "rule", "regulation", "standard operating procedure", "sop"]),
    ("COUNT", ["how many", "count of", "number of", "total count", "count all"]),
    ("SUM", ["total", "sum of", "sum total", "aggregate", "gross amount", "net amount", "total value"]),
    ("OTHER", ["live database", "raw sql", "database result"]),
    ("LIST", ["list all", "show all", "give me a table", "show me all", "display all", "fetch all", "get all", "list of", "list distinct", "show me the", "list the", "list top", "show the last", "show the top", "list ", "show me "]),
]
# Seconds for which an answer of a type may be reused.
CACHE_SECONDS = {"COUNT": 60, "SUM": 60, "LIST": 3600, "POLICY": 86400, "OTHER": 3600}
# Words by intent.
EXPLAIN_WORDS = "why|reason|cause|explain|explanation|diagnose|compare|comparison|how come|insight|analyze|analysis"
AGGREGATE_WORDS = "total|sum|count|average|avg|revenue by|group by|how many|how much|trend|breakdown|distribution|highest|lowest|max|min|percentage|share of"
LIST_WORDS = "show me|list|give me|fetch|top|last|recent|all records|get|find|display|show"
# Phrases that ask for everything, and for a picture.
EXHAUSTIVE = ["list every", "list all", "all companies", "every company", "all products", "every product", "all entities", "every entity", "all mentions", "all models", "every model", "all documents", "enumerate", "comprehensive list", "complete list", "full list", "all names", "every name", "all people", "every person", "all locations", "every location", "across all", "across documents"]
VISUAL = ["chart", "graph", "plot", "diagram", "visualize", "visualise", "visualization", "visualisation", "scatter", "histogram", "timeline", "trend", "breakdown", "distribution", "draw", "sketch"]
# Words that point to live data, or to documents.
DATA_WORDS = (
    "order orders sales purchase purchases supplier suppliers vendor vendors stock inventory warehouse warehouses carton cartons "
    "production manufacture manufacturing batch batches machine machines yield output plant apq ppq color colors colour colours "
    "unit units uom measurement packaging packagings packing challan challans delivery dispatch shipment transporter vehicle driver dc "
    "invoice invoices proforma balance ledger credit debit party parties customer customers client clients lead leads inquiry inquiries "
    "adjustment adjustments stock-out stockout stock-in stockin product products category categories po po_no so_no dc_no pi pi_no batch_no "
    "qty quantity adjusted"
).split()
DATA_PHRASES = ["due date", "po number", "po numbers", "stock-out", "stock-in", "on hand", "net sales"]
DOCUMENT_WORDS = (
    "rag ocr parser parsers pipeline architecture embedding embeddings rerank reranking chunk chunks chunking chunker vector policy policies "
    "procedure procedures sop sops guideline guidelines manual handbook contract contracts agreement apple iphone sec 10-k 10k filing filings "
    "shareholder shareholders pdf docx doc document documents ticker hq headquarters fte headcount employee employees layers layer distribution indirect"
).split()
DOCUMENT_PHRASES = ["effective tax", "10-k", "10k", "tax rate", "net sales", "ticker symbol", "headquarters", "fte employees", "chunker purpose", "rag layers", "fiscal year end", "embedding model", "indirect distribution"]
# Questions about the corpus itself.
LISTING = ["what files", "which files", "what documents", "which documents", "list files", "list documents", "list all documents", "list all files", "list all docs", "show files", "show documents", "what have you", "what do you have", "documents uploaded", "files uploaded", "ingested files", "available documents", "available files", "what is in your", "what's in your", "knowledge base", "what docs", "which docs", "list docs", "show docs", "docs do you", "docs you have", "available docs", "docs uploaded", "ingested docs", "how many documents", "how many docs", "how many files"]
LISTING_ENTITIES = "(customer|client|vendor|supplier|employee|order|invoice|product|account|shipment|payment|transaction)s?"
# Cues of a follow-up question.
FOLLOW_UP = r"it|its|it'?s|that|those|these|them|they|the (?:first|second|third|last|other|same|above|previous|former|latter)|compare|comparison|vs\.?|versus|make a table|make table|tabulate|chart it|graph it|plot it|how about|what about|expand|elaborate|continue|instead|difference|again|rephrase|the rest"
RESET = ["new question", "different", "change topic", "let's talk about", "switch to", "start over", "ignore previous", "forget about"]
# Words by task, in order of precedence.
TASKS = [
    ("summarization", ["summarize", "summary", "overview", "brief"]),
    ("reasoning", ["why", "how", "explain", "reason", "analyze", "compare"]),
    ("extraction", ["extract", "list", "find all", "what are the"]),
]
# Words that refine a conversation, and pronouns that point back.
REFINE = ["what about", "how about", "and for", "also", "same for", "instead", "drill down", "break down by"]
VAGUE = "it|they|them|their|its|this|that|these|those"
# Shapes of dates, periods and words that bound a time.
TEMPORAL = r"(?i)\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b(19|20)\d{2}\b|\b(last|past|previous|this)\s+(month|year|quarter|week|days?|\d+\s+days|\d+\s+months)\b|\b(between|after|before|since|until|from|overdue|as of|ytd|quarterly|monthly)\b|\b(january|february|march|april|may|june|july|august|september|october|november|december)\b|\b(due date|order date|dispatch date|created at|adjustment date|batch date)\b"


def query_type(question: Column | str) -> Column:
    q = F.trim(_low(question))
    out = F.when(q == "", "OTHER")
    for name, phrases in QUERY_TYPES:
        out = out.when(has_any(q, phrases), name)
    return out.otherwise("OTHER")


def cache_seconds(kind: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, n in CACHE_SECONDS.items():
        out = F.when(kind == name, F.lit(n).cast("long")).otherwise(out)
    return out


def query_intent(question: Column | str) -> Column:
    q = F.trim(_low(question))
    lists_first = q.rlike(r"^(list|show me|show|fetch|get|display|find|give me|top)\b") & ~has_word(q, "total|sum|average|avg|how many|how much")
    return F.when(q == "", "explanation").when(has_word(q, EXPLAIN_WORDS), "explanation").when(lists_first, "list").when(has_word(q, AGGREGATE_WORDS), "aggregate").when(has_word(q, LIST_WORDS), "list").otherwise("explanation")


def query_task(question: Column | str) -> Column:
    q, out = _low(question), F.when(F.lit(False), "")
    for name, words in TASKS:
        out = out.when(has_any(q, words), name)
    return out.otherwise("general_qa")


def is_exhaustive(question: Column | str) -> Column:
    return has_any(_low(question), EXHAUSTIVE)


def is_visual(question: Column | str) -> Column:
    return has_any(_low(question), VISUAL)


def is_listing(question: Column | str) -> Column:
    """Asks what the corpus holds, and not about a business entity."""
    q = _low(question)
    return has_any(q, LISTING) & ~has_word(q, LISTING_ENTITIES)


def _named(q: Column, names: list[str]) -> Column:
    """Whether one of the names stands alone, hyphens and underscores being parts of words."""
    return q.rlike(rf"(?<![\w-])({'|'.join(names)})(?![\w-])")


def data_signal(question: Column | str) -> Column:
    q = _low(question)
    return _named(q, DATA_WORDS) | has_any(q, DATA_PHRASES) | q.rlike(r"\b[a-z]+[0-9]+[a-z0-9_-]*\b")


def document_signal(question: Column | str) -> Column:
    q = _low(question)
    return _named(q, DOCUMENT_WORDS) | has_any(q, DOCUMENT_PHRASES)


def route(question: Column | str) -> Column:
    """'sql', 'rag' or 'hybrid'."""
    d, t = data_signal(question), document_signal(question)
    return F.when(d & ~t, "sql").when(t & ~d, "rag").otherwise("hybrid")


def split_hybrid(question: Column | str) -> Column:
    """struct(sql, doc): a compound question's parts by what each is about; the whole question twice if it can't be told."""
    q = F.col(question) if isinstance(question, str) else question
    marks = [(r"\s+/\s+", 2, False), (r"\s+\|\s+", 2, False), (r"\s+;\s+", 2, False), (r"\s+--\s+", 2, False), (r"(?i)\s+(?:and|&)\s+", -1, True)]
    tries = F.array(*[F.struct(F.split(q, p, n).alias("parts"), F.lit(strict).alias("strict")) for p, n, strict in marks])
    both = F.transform(F.filter(tries, lambda t: F.size(t["parts"]) == 2), lambda t: F.struct(F.trim(t["parts"][0]).alias("one"), F.trim(t["parts"][1]).alias("two"), t["strict"].alias("strict")))
    told = F.transform(both, lambda t: F.struct(t["one"].alias("one"), t["two"].alias("two"), t["strict"].alias("strict"), data_signal(t["one"]).alias("s1"), document_signal(t["one"]).alias("d1"), data_signal(t["two"]).alias("s2"), document_signal(t["two"]).alias("d2")))

    def choose(t: Column) -> Column:
        forth, back = F.struct(t["one"].alias("sql"), t["two"].alias("doc")), F.struct(t["two"].alias("sql"), t["one"].alias("doc"))
        sure = F.when(t["s1"] & t["d2"] & ~t["d1"], forth).when(t["s2"] & t["d1"] & ~t["d2"], back)
        return sure.when(~t["strict"] & t["s1"] & t["d2"], forth).when(~t["strict"] & t["s2"] & t["d1"], back)

    return F.coalesce(F.get(F.array_compact(F.transform(told, choose)), F.lit(0)), F.struct(q.alias("sql"), q.alias("doc")))


def soft_delete_intent(question: Column | str) -> Column:
    """Which records a question is about: 'ACTIVE_ONLY', 'DELETED_ONLY' or 'INCLUDE_ARCHIVED'."""
    q = _low(question)
    deleted, active = has_word(q, "deleted|removed|dropped|gone"), has_word(q, "active|current|present|live|existing")
    rest = F.regexp_replace(q, r"\bpast\s+(?:few\s+)?(?:\d+\s+)?(?:days?|weeks?|months?|quarters?|years?)\b", "")
    old = has_word(rest, "archived|history|audit|historical|past")
    return F.when(deleted & active, "INCLUDE_ARCHIVED").when(deleted, "DELETED_ONLY").when(old, "INCLUDE_ARCHIVED").otherwise("ACTIVE_ONLY")


def is_follow_up(question: Column | str) -> Column:
    q = F.trim(_low(question))
    return (q != "") & ((F.size(F.split(q, r"\s+")) <= 4) | has_word(q, FOLLOW_UP))


def context_action(question: Column | str, has_history: Column, follow_markers: Iterable[str] = tuple(REFINE)) -> Column:
    """'RESET', 'REFINE' or 'ASK' for a question within a conversation."""
    q = _low(question)
    vague = has_word(q, VAGUE)
    short = F.size(F.split(F.trim(q), r"\s+")) < 10
    return F.when(has_any(q, RESET), "RESET").when(has_any(q, follow_markers) | vague, F.when(has_history, "REFINE").otherwise("ASK")).when(has_history & short, "REFINE").otherwise("RESET")


def temporal_intent(question: Column | str) -> Column:
    return F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")).rlike(TEMPORAL)


# Signs of failure categories, in order of precedence; all of a tuple's groups must be present.
FAILURES = [
    ("missing_soft_delete_filter", [["soft delete", "soft_delete", "deleted_at"]]),
    ("missing_temporal_filter", [["temporal", "missing date", "date filter"]]),
    ("citation_mismatch", [["citation", "cite", "chunk reference"]]),
    ("unsupported_answer_claim", [["unsupported claim", "unsupported_answer_claim", "ungrounded", "hallucinated claim"]]),
    ("acronym_not_expanded", [["acronym"]]),
    ("entity_ambiguity", [["ambiguity", "ambiguous", "entity_ambiguity", "multiple matching entities"]]),
    ("decomposition_incomplete", [["decomposition", "missing subquery", "dropped constraint"]]),
    ("unsafe_sql_operation", [["unsafe sql", "read-only", "read only", "drop table", "truncate", "delete from", "insert into"]]),
    ("invalid_column", [["unknown column", "no such column", "column validation", "column '", 'column "']]),
    ("invalid_table", [["table doesn't exist", "no such table", "table '", 'table "', "unknown table", "invalid_table"]]),
    ("schema_retrieval_miss", [["schema"], ["retriev", "rag", "embed", "not found in schema"]]),
    ("sql_syntax_error", [["syntax", "parse error", "unparseable"]]),
    ("circuit_breaker_open", [["circuit_breaker", "circuitbreaker", "circuit breaker"]]),
    ("budget_exceeded", [["budget_exceeded", "budgetexceeded", "query budget", "budget exceeded"]]),
    ("rate_limit_error", [["rate limit", "429", "tpm", "rpm", "quota", "exhausted", "throttl"]]),
    ("timeout", [["timeout", "timed out"]]),
    ("permission_error", [["permission", "access denied", "unauthorized", "401", "403", "forbidden"]]),
    ("empty_result", [["empty result", "no rows", "zero rows"]]),
    ("db_execution_error", [["database error", "operationalerror", "programmingerror", "integrityerror", "mysql", "sqlite"]]),
    ("llm_error", [["llm", "provider", "model", "connection error", "api connection", "bad request"]]),
    ("out_of_scope", [["out of scope", "out_of_scope", "unanswerable", "abstain", "speculative"]]),
]
# The shorter list of telemetry failure types.
TELEMETRY_FAILURES = [
    ("circuit_breaker_open", [["circuit_breaker", "circuitbreaker", "circuit breaker"]]),
    ("budget_exceeded", [["budget_exceeded", "budgetexceeded", "query budget", "budget exceeded"]]),
    ("rate_limit_error", [["rate limit", "429", "tpm", "rpm", "quota", "exhausted", "throttl"]]),
    ("timeout_error", [["timeout", "timed out"]]),
    ("permission_error", [["permission", "access denied", "unauthorized", "401", "403", "forbidden"]]),
    ("sql_validation_error", [["column validation", "alias validation", "hallucinat", "does not exist", "unknown column", "no such column", "semantic validation"]]),
    ("sql_generation_error", [["syntax", "parse error", "unparseable", "invalid identifier"]]),
    ("db_execution_error", [["database error", "operationalerror", "programmingerror", "integrityerror", "mysql", "sqlite", "table doesn't exist", "no such table"]]),
    ("schema_retrieval_error", [["schema"], ["retriev", "rag", "embed"]]),
    ("llm_error", [["llm", "provider", "model", "connection error", "api connection", "bad request"]]),
]


def _by_signs(error: Column | str, table, default: Column) -> Column:
    e = F.lower(F.col(error) if isinstance(error, str) else error)
    out = F.when(e.isNull(), default)
    for name, groups in table:
        hit = F.lit(True)
        for g in groups:
            hit = hit & has_any(e, g)
        out = out.when(hit, name)
    return out.otherwise(default)


def failure_category(error: Column | str, stage: Column | None = None) -> Column:
    default = F.lit("unknown")
    if stage is not None:
        default = F.when(stage == "schema_retrieval", "schema_retrieval_miss").when(stage.isin("sql_generation", "sql_validation"), "sql_syntax_error").otherwise("unknown")
    return F.when((F.col(error) if isinstance(error, str) else error).isNull(), "unknown").otherwise(_by_signs(error, FAILURES, default))


def telemetry_failure(error: Column | str) -> Column:
    return _by_signs(error, TELEMETRY_FAILURES, F.lit("unknown_error"))
