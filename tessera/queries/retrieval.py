"""Retrieval on embeddings and documents: top-k, fusion, ranking, diversity, packing, caches and citations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import text as T, vectors as V
from ..operators import citations as Cite, ivf, ranking as K
from ..session import shared_folder, table
from .registry import Registry
from .text import ASKED_WORDS, questions, runs_sql

R = Registry()
DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _query_vector(embeddings):
    return [float(x) for x in embeddings.filter("vec_id = 0").first()["embedding"]]


@R.add(f"SELECT a.vec_id, round({COSINE}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {COSINE} DESC, a.vec_id LIMIT 30", "embeddings")
def cosine_topk(embeddings):
    """The thirty vectors most similar to one."""
    out = K.dense_top_k(embeddings, V.literal(_query_vector(embeddings)), 30, "vec_id")
    return out.withColumn("score", F.round("score", 6))


@R.add(f"SELECT query_id, vec_id, round(score, 6) AS score, r AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id, {COSINE} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COSINE} DESC, a.vec_id) AS r FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) WHERE r <= 10", "embeddings")
def cosine_topk_batch(embeddings):
    """The ten best for each of a stated set of query vectors (every hundredth), against all rows."""
    queries = embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return K.dense_top_k_each(embeddings, queries, 10, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@R.add(f"SELECT query_id, vec_id, round(score, 6) AS score, r AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id, {COSINE} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COSINE} DESC, a.vec_id) AS r FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) WHERE r <= 10")
def ivf_topk(spark, sf_dir):
    """The ten best for every hundredth vector, through an inverted file of all rows that is searched until no other bucket can hold a better one."""
    embeddings = table(spark, sf_dir, "embeddings")
    index = ivf.build(embeddings, f"{shared_folder(spark)}/tessera-ivf-{uuid.uuid4().hex}", "vec_id")
    queries = embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = ivf.search(spark, index, queries, 10, exact=True)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


TERMS_SQL = "terms AS (SELECT doc_id, term, count(*) AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL)"


def _postings(documents):
    return documents.select("doc_id", F.explode(T.dedup_tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("weight"))


@R.add(f"""WITH {TERMS_SQL}, q AS (SELECT term, weight AS query_weight FROM terms WHERE doc_id = 0)
SELECT doc_id, CAST(sum(weight * query_weight) AS BIGINT) AS score FROM terms JOIN q USING (term) GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 20""", "documents")
def sparse_topk(documents):
    """Sparse dot products through postings; the query is one document's terms."""
    query = _postings(documents.filter("doc_id = 0")).select("term", F.col("weight").alias("query_weight"))
    out = K.sparse_top_k(_postings(documents), query, 20, "doc_id")
    return out.withColumn("score", F.col("score").cast("long"))


@R.add(f"""WITH d AS (SELECT a.vec_id, {COSINE} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 40), s AS (SELECT a.vec_id, {DOT} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 1 ORDER BY 2 DESC, 1 LIMIT 40),
r1 AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r1 FROM d), r2 AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r2 FROM s)
SELECT coalesce(r1.vec_id, r2.vec_id) AS vec_id, round(coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0), 8) AS fused FROM r1 FULL JOIN r2 ON r1.vec_id = r2.vec_id ORDER BY coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0) DESC, 1 LIMIT 20""", "embeddings")
def rrf_fuse(embeddings):
    """Two ranked lists of forty, fused by reciprocal ranks."""
    one = K.dense_top_k(embeddings, V.literal(_query_vector(embeddings)), 40, "vec_id")
    second = [float(x) for x in embeddings.filter("vec_id = 1").first()["embedding"]]
    two = embeddings.select("vec_id", V.dot(F.col("embedding"), V.literal(second)).alias("score")).orderBy(F.desc("score"), "vec_id").limit(40)
    out = K.reciprocal_rank_fusion(one, two, "vec_id", 20)
    return out.select("vec_id", F.round("fused", 8).alias("fused"))


QUERY = "the weather and harvest report of the northern market"


@R.add(f"""WITH q AS (SELECT list_filter(list_distinct(regexp_extract_all(lower('{QUERY}'), '[a-z0-9]+')), lambda x: length(x) >= 3 AND x NOT IN ({', '.join(f"'{w}'" for w in T.STOPWORDS)})) AS q),
d AS (SELECT doc_id, n_chars, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) >= 3) AS w FROM documents)
SELECT doc_id, round(CAST(len(list_intersect(w, q)) AS DOUBLE) / len(q), 6) AS overlap FROM d, q ORDER BY CAST(len(list_intersect(w, q)) AS DOUBLE) / len(q) DESC, n_chars DESC, doc_id LIMIT 25""", "documents")
def lexical_rerank(documents):
    out = K.lexical_rerank(documents, QUERY, "text", "n_chars", "doc_id", 25)
    return out.select("doc_id", F.round("overlap", 6).alias("overlap"))


RESULTS = 100  # results of a query: the retrieval limit


def _ranked(documents):
    """Result lists: every document is in one list of a hundred neighbouring ids, ranked by length."""
    lists = documents.withColumn("query_id", F.expr(f"doc_id div {RESULTS}"))
    return lists.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")))


RANKED_SQL = f"ranked AS (SELECT doc_id, doc_id // {RESULTS} AS query_id, source, text, n_chars, row_number() OVER (PARTITION BY doc_id // {RESULTS} ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents)"


@R.add(f"""WITH {RANKED_SQL}, a AS (SELECT *, min(place) OVER (PARTITION BY query_id, source) AS first_pos, row_number() OVER (PARTITION BY query_id, source ORDER BY place) AS in_doc FROM ranked),
n AS (SELECT query_id, count(DISTINCT source) AS docs FROM ranked GROUP BY 1), b AS (SELECT a.*, CASE WHEN in_doc > CASE WHEN docs <= 1 THEN 10 ELSE greatest(2, ceil(10.0 / docs)) END THEN 1 ELSE 0 END AS over_quota FROM a JOIN n USING (query_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over_quota, CASE WHEN over_quota = 0 THEN first_pos ELSE place END, place) AS turn FROM b) SELECT query_id, doc_id, source FROM c WHERE turn <= 10""", "documents")
def doc_diversity(documents):
    """Ten results a query with a quota for each source."""
    return K.diversify(_ranked(documents), 10, "query_id", "source", "n_chars", "doc_id").select("query_id", "doc_id", "source")


@R.add(f"""WITH {RANKED_SQL}, u AS (SELECT *, sum(length(text) // 3) OVER (PARTITION BY query_id ORDER BY place) AS upto FROM ranked) SELECT query_id, doc_id, CAST(upto AS BIGINT) AS upto FROM u WHERE upto <= 20000 OR place = 1""", "documents")
def context_pack(documents):
    """The leading results that fit into a context."""
    return K.pack_context(_ranked(documents), 20000, "query_id", "place", "text").select("query_id", "doc_id", "upto")


@R.add(f"WITH {RANKED_SQL} SELECT query_id, doc_id FROM ranked WHERE place <= 2", "documents")
def context_limit(documents):
    """A limit of one result is raised to two."""
    return K.limit_context(_ranked(documents), 1, "query_id", "place").select("query_id", "doc_id")


@R.add(f"WITH {RANKED_SQL} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, place) AS place FROM ranked", "documents")
def pinned_first(documents):
    """One source's results come before the others."""
    ranked = _ranked(documents)
    return K.pin_first(ranked, F.col("source") == "src0", "query_id", "place").select("query_id", "doc_id", F.col("place").cast("long").alias("place"))


@R.add("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 200 AND (source IN ('src1', 'system', 'shared') OR source IS NULL) AND NOT coalesce(CASE WHEN doc_id % 5 = 0 THEN FALSE WHEN doc_id % 5 = 1 THEN NULL ELSE TRUE END = FALSE, FALSE)", "documents")
def visible_chunks(documents):
    """Search conditions: equal values, a bound, a tenant's view, and rows that aren't hidden; a null flag counts as active."""
    k = F.col("doc_id") % 5
    chunks = documents.withColumnsRenamed({"source": "user_id", "n_chars": "page_number"}).withColumn("active", F.when(k == 0, False).when(k == 1, None).otherwise(True))
    return K.metadata_filter(chunks, tenant="src1", min_page=200, lang="en").select("doc_id")


@R.add("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE (vec_id % 40) / 1000.0 END AS score FROM embeddings WHERE vec_id % 3 = 0 OR (vec_id % 40) / 1000.0 >= 0.01", "embeddings")
def relevance_floor(embeddings):
    scored = embeddings.select("vec_id", F.when(F.col("vec_id") % 3 == 0, None).otherwise((F.col("vec_id") % 40) / F.lit(1000.0)).alias("score"))
    return K.relevance_floor(scored)


@R.add(None, "documents")
def budget_fill(documents):
    """Which documents of each result list fit a token budget, in order, skipping those that don't; a fold in order."""
    lists = _ranked(documents).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", T.token_estimate("text").alias("n")))).alias("items"))
    taken = lists.select("query_id", F.arrays_zip(F.col("items").alias("i"), K.fill_budget(F.transform("items", lambda x: x["n"]), 1500).alias("t")).alias("z"))
    return taken.select("query_id", F.explode("z").alias("z")).select("query_id", F.col("z.i.doc_id").alias("doc_id"), F.col("z.t").alias("taken"))


CACHE_SQL = f"""SELECT l.lookup_id, x.cached_id, round(x.similarity, 6) AS similarity FROM (SELECT vec_id AS lookup_id FROM embeddings WHERE vec_id % 100 = 0) l
LEFT JOIN (SELECT b.vec_id AS lookup_id, max_by(a.vec_id, [{COSINE}, CAST(a.vec_id AS DOUBLE)]) AS cached_id, max({COSINE}) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE b.vec_id % 100 = 0 AND a.vec_id % 30 <> 0
AND 1000 < a.vec_id % 100 + (CASE WHEN a.vec_id % 20 = 0 THEN 60 ELSE 3600 END) AND {COSINE} >= 0.3 GROUP BY 1) x USING (lookup_id)"""


@R.add(CACHE_SQL, "embeddings")
def semantic_cache_hit(embeddings):
    """The most similar live entry of each lookup's scope: a stated set of lookups (every hundredth) in all rows."""
    e = embeddings.withColumns({"scope": F.col("label").cast("string"), "kind": F.lit("LIST")})
    lookups = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("lookup_id"), "scope", "kind", F.lit(1000).cast("long").alias("at"), "embedding")
    ttl = F.when(F.col("vec_id") % 20 == 0, 60).otherwise(3600)
    cache = e.select(F.col("vec_id").alias("cached_id"), "scope", "kind", (F.col("vec_id") % 100).alias("stored_at"), ttl.alias("ttl"), "embedding", (F.col("vec_id") % 30 != 0).alias("safe"))
    return K.semantic_cache(lookups, cache, 0.3).select("lookup_id", "cached_id", F.round("similarity", 6).alias("similarity"))


@R.add("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 100", "events")
def cache_survivors(events):
    """The least recently used entries of a scope go first."""
    cache = events.select(F.col("event_id").alias("cached_id"), "user_id", F.col("event_type").alias("scope"), F.col("ts").alias("used_at"))
    return K.cache_survivors(cache, 100).select(F.col("cached_id").alias("event_id"), "user_id")


def _chunk(n):
    return F.concat(F.lit("ab"), F.col("doc_id").cast("string"), F.lit(f"_chunk_000{n}"))


@R.add("""SELECT doc_id AS answer_id, translate(text, '【】', '[]') || CASE WHEN doc_id % 2 = 0 THEN ' [1]' ELSE ' [1][2]' END || ' and [1] but .' || chr(10) || chr(10) || '**References**' || chr(10) || chr(10) || '1. ' || coalesce(source || '.pdf', 'Unknown') || ' (Page 1)'
|| CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || '2. ' || coalesce(source || '.pdf', 'Unknown') || ' (Page 2)' END AS clean FROM documents""", "documents")
def citation_footnotes(documents):
    """Citation brackets as footnotes: each whole text, then three brackets, of which one names what was never retrieved."""
    answer = F.concat("text", F.lit(" ["), _chunk(1), F.lit(", "), _chunk(2), F.lit("] and 【"), _chunk(1), F.lit("】 but [ffff_chunk_0009]."))
    pages = F.array(F.struct(_chunk(1).alias("chunk_id"), F.lit(1).alias("page_number")), F.struct(_chunk(2).alias("chunk_id"), (F.col("doc_id") % 2 + 1).cast("int").alias("page_number")))
    retrieved = documents.select(F.col("doc_id").alias("answer_id"), F.explode(pages).alias("c"), F.concat(F.lit("/data/"), F.col("source"), F.lit(".pdf")).alias("source_file"))
    return Cite.render(documents.select(F.col("doc_id").alias("answer_id"), answer.alias("answer")), retrieved.select("answer_id", "c.chunk_id", "c.page_number", "source_file"))


@R.add(f"""WITH d AS (SELECT doc_id, text, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) >= 3 AND x NOT IN ({', '.join(f"'{w}'" for w in T.STOPWORDS)}))) AS n FROM documents),
g AS (SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 'citation_mismatch' WHEN doc_id % 3 = 2 AND n >= 8 THEN 'unsupported_answer_claim' END AS reason FROM d) SELECT doc_id AS answer_id, reason IS NULL AS passed, reason FROM g""", "documents")
def citation_guard(documents):
    """Whole texts as answers: a third cites what wasn't retrieved, a third has its own text as context, a third another one."""
    k = F.col("doc_id") % 3
    answers = documents.select(F.col("doc_id").alias("answer_id"), F.concat("text", F.lit(" ["), _chunk(1), F.lit("]"), F.when(k == 0, " [ffff_chunk_0009]").otherwise("")).alias("answer"))
    retrieved = documents.select(F.col("doc_id").alias("answer_id"), _chunk(1).alias("chunk_id"), F.when(k == 1, F.col("text")).otherwise("qqqq").alias("content"))
    return Cite.guard(answers, retrieved)


PATTERNS = [("p1", ["total revenue", "revenue by"], 0.9), ("p2", ["how many"], 1.0), ("p3", ["show me the"], 0.5), ("p4", ["orders were placed"], 0.8)]
PATTERN_ROWS = ", ".join(f"('{p}', '{phrase}', {quality}::DOUBLE)" for p, phrases, quality in PATTERNS for phrase in phrases)


@R.add(f"""WITH own AS (SELECT question_id, unnest(list_distinct({runs_sql("w", (2, 3, 4))})) AS phrase FROM {ASKED_WORDS}), hits AS (SELECT question_id, pattern_id, count(*) * 2 * any_value(quality) AS points FROM own JOIN (VALUES {PATTERN_ROWS}) t(pattern_id, phrase, quality) USING (phrase) GROUP BY ALL)
SELECT question_id, pattern_id, points, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY points DESC, pattern_id) AS place FROM hits WHERE points > 0) WHERE place <= 2""", "conversations")
def pattern_matches(conversations):
    """Learned patterns by the trigger phrases in every question."""
    patterns = conversations.sparkSession.createDataFrame(PATTERNS, "pattern_id string, trigger_phrases array<string>, quality double")
    return K.match_patterns(questions(conversations), patterns).withColumn("place", F.col("place").cast("long"))
