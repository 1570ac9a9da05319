"""Retrieval: top-k searches, fusion, lexical ranking, diversity, and packing of contexts and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import content_words, context_estimate, word_runs, words
from ..functions.vectors import cosine
from ..session import beside
from . import blocks

MIN_RELEVANCE = 0.01
MAX_QUERIES = 1_000_000  # query vectors of one search, whose work grows with queries x rows


def metadata_filter(chunks: DataFrame, tenant: str | None = None, with_schema: bool = False, min_page: int | None = None, file_contains: str | None = None, **equal: str) -> DataFrame:
    """Payload conditions of a search: equal values, a page bound, text in the file name, visibility, and active rows.

    Rows without a tenant are shared; rows whose ``active`` is null count as active."""
    out = chunks
    for name, value in equal.items():
        out = out.filter(F.col(name) == value)
    if file_contains:
        out = out.filter(F.col("source_file").contains(file_contains))
    if min_page is not None:
        out = out.filter(F.col("page_number") >= min_page)
    if tenant is not None and tenant not in ("*", "all"):
        out = out.filter(F.col("user_id").isin(tenant, "system", "shared") | F.col("user_id").isNull())
    if "active" in out.columns:
        out = out.filter(~F.col("active").eqNullSafe(F.lit(False)))
    if not with_schema and "chunk_type" in out.columns:
        out = out.filter(~F.col("chunk_type").eqNullSafe(F.lit("SQL_SCHEMA")))
    return out


def dense_top_k(vectors: DataFrame, query: Column, k: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """The k rows most similar to one query vector; each task keeps k rows before they meet."""
    return vectors.select(id_col, cosine(F.col(vector_col), query).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def dense_top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for each of a stated set of query vectors, against all rows; see :mod:`.blocks`."""
    n = queries.count()
    if n > MAX_QUERIES:
        raise ValueError(f"{n} query vectors; search in blocks of {MAX_QUERIES}")
    last = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return blocks.top_k(vectors, queries, k, id_col, query_col, vector_col).withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


def sparse_top_k(postings: DataFrame, query: DataFrame, k: int, id_col: str, term_col: str = "term", weight_col: str = "weight") -> DataFrame:
    """The k rows with the largest dot product over shared terms; ``query`` is (term, query_weight)."""
    hits = postings.join(query, term_col)
    scores = hits.groupBy(id_col).agg(F.sum(F.col(weight_col) * F.col("query_weight")).alias("score"))
    return scores.orderBy(F.desc("score"), id_col).limit(k)


def reciprocal_rank_fusion(one: DataFrame, two: DataFrame, id_col: str, limit: int, k: int = 60) -> DataFrame:
    """Fuses two ranked lists (id, score); both are of bounded length. An empty second list leaves the first's order."""
    ranked = lambda df, name: df.select(id_col, F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias(name))
    both = ranked(one, "r1").join(ranked(two, "r2"), id_col, "full")
    part = lambda name: F.coalesce(1.0 / (F.lit(k) + F.col(name)), F.lit(0.0))
    return both.withColumn("fused", part("r1") + part("r2")).orderBy(F.desc("fused"), id_col).limit(limit)


def lexical_rerank(results: DataFrame, query: str | Column, text_col: str, score_col: str, id_col: str, k: int) -> DataFrame:
    """By the share of the query's content words that a text holds, then by its score."""
    q = content_words(F.lit(query) if isinstance(query, str) else query)
    share = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, content_words(text_col))) / F.size(q))
    return results.withColumn("overlap", share).orderBy(F.desc("overlap"), F.desc(score_col), id_col).limit(k)


def relevance_floor(results: DataFrame, score_col: str = "score", least: float = MIN_RELEVANCE) -> DataFrame:
    return results.filter(F.col(score_col).isNull() | (F.col(score_col) >= least))


def diversify(results: DataFrame, k: int, query_col: str, doc_col: str, score_col: str, id_col: str) -> DataFrame:
    """Document quotas in a ranked list: each document gets max(2, ceil(k / documents)) places, in the order in which
    documents first occur; places left over go to the best of the rest."""
    q = Window.partitionBy(query_col)
    ranked = results.withColumn("pos", F.row_number().over(q.orderBy(F.desc(score_col), id_col)))
    ranked = ranked.withColumns({"first_pos": F.min("pos").over(Window.partitionBy(query_col, doc_col)), "in_doc": F.row_number().over(Window.partitionBy(query_col, doc_col).orderBy("pos"))})
    docs = F.size(F.collect_set(doc_col).over(q))
    ranked = ranked.withColumn("docs", docs).withColumn("quota", F.when(F.col("docs") <= 1, k).otherwise(F.greatest(F.lit(2), F.ceil(F.lit(k) / F.col("docs")))))
    ranked = ranked.withColumn("over", (F.col("in_doc") > F.col("quota")).cast("int"))
    turn = F.row_number().over(q.orderBy("over", F.when(F.col("over") == 0, F.col("first_pos")).otherwise(F.col("pos")), "pos"))
    return ranked.withColumn("turn", turn).filter(F.col("turn") <= k).drop("first_pos", "in_doc", "docs", "quota", "over", "turn")


def pack_context(results: DataFrame, budget: int, query_col: str, order_col: str, text_col: str) -> DataFrame:
    """The leading results whose estimated tokens fit; the first stays in any case, and nothing follows the first that doesn't fit."""
    w = Window.partitionBy(query_col).orderBy(order_col)
    upto = results.withColumn("tokens", context_estimate(text_col)).withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = upto.withColumn("place", F.row_number().over(w))
    # running sums don't fall, so the first overflow ends the prefix
    return place.filter((F.col("upto") <= budget) | (F.col("place") == 1)).drop("place")


def fill_budget(costs: Column, budget: int) -> Column:
    """array<boolean>: which of the ordered costs are taken, skipping those that don't fit; the first always is."""
    start = F.struct(F.expr("cast(array() as array<boolean>)").alias("taken"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, c: Column) -> Column:
        take = (a["sum"] + c <= budget) | (F.size(a["taken"]) == 0)
        return F.struct(F.concat(a["taken"], F.array(take)).alias("taken"), (a["sum"] + F.when(take, c).otherwise(0)).cast("long").alias("sum"))

    return F.aggregate(costs, start, step, lambda a: a["taken"])


def limit_context(results: DataFrame, limit: int | None, query_col: str, order_col: str) -> DataFrame:
    """The first ``limit`` results of each query, two at least; all without a limit."""
    if limit is None:
        return results
    place = F.row_number().over(Window.partitionBy(query_col).orderBy(order_col))
    return results.withColumn("place", place).filter(F.col("place") <= max(limit, 2)).drop("place")


def pin_first(results: DataFrame, flag: Column, query_col: str, order_col: str) -> DataFrame:
    """Rows with the flag come first, those without a value among the others; ``place`` is the new order."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc(F.coalesce(flag, F.lit(False))), order_col)))


def match_patterns(questions: DataFrame, patterns: DataFrame, k: int = 2) -> DataFrame:
    """The k best learned patterns (pattern_id, trigger_phrases, quality) of each question, two points a phrase.

    Word runs of questions meet phrases, of two to four words, by an equi-join; the patterns go to the questions."""
    phrases = patterns.select("pattern_id", "quality", F.explode("trigger_phrases").alias("phrase"))
    own = questions.withColumn("phrase", F.explode(F.array_distinct(word_runs(words(F.lower("question")), (2, 3, 4)))))
    hits = own.join(beside(phrases), "phrase").groupBy("question_id", "pattern_id").agg((F.count("*") * 2 * F.first("quality")).alias("points")).filter("points > 0")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("points"), "pattern_id"))
    return hits.withColumn("place", place).filter(F.col("place") <= k)


def semantic_cache(lookups: DataFrame, cache: DataFrame, least: float = 0.95) -> DataFrame:
    """Adds ``cached_id`` and ``similarity``: the most similar live entry of the lookup's own scope and type.

    lookups: (lookup_id, scope, kind, at, embedding); cache: (cached_id, scope, kind, stored_at, ttl, embedding, safe).
    A lookup without a scope hits nothing; only entries that passed the safety gate are reused."""
    live = cache.filter("safe").select("cached_id", "scope", "kind", "stored_at", "ttl", F.col("embedding").alias("known"))
    pairs = lookups.join(live, ["scope", "kind"]).filter("stored_at <= at and at < stored_at + ttl")
    best = pairs.withColumn("similarity", cosine(F.col("embedding"), F.col("known"))).filter(F.col("similarity") >= least)
    best = best.groupBy("lookup_id").agg(F.max(F.struct("similarity", "cached_id")).alias("b")).select("lookup_id", "b.cached_id", "b.similarity")
    return lookups.join(best, "lookup_id", "left")


def cache_survivors(cache: DataFrame, size: int = 1000) -> DataFrame:
    """The ``size`` most recently used entries of each scope."""
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("used_at"), "cached_id"))
    return cache.withColumn("place", place).filter(F.col("place") <= size).drop("place")
