"""Benchmark decontamination by winnowing, in built-in functions only.

Every sequence of ``K`` (5) words gets a 64-bit hash; of each sliding window of 9 such hashes the smallest
is kept. Two texts that share 13 words share all hashes inside them, hence the smallest one, hence a
fingerprint: every shared span of 13 words is found. Fingerprints of the documents are semi-joined with
those of the benchmark; each hit is extended to the up to nine 13-word windows that contain it, and the
windows are joined by the hash of all their words with the distinct windows of the benchmark, and compared
word hash by word hash. Items of fewer than 13 words are one shorter window each, looked up at every
position; their (at most 12) lengths are read from the benchmark first.

Only the sides that come from the benchmark are ever broadcast, and only after they have been counted;
above the limits below the same joins are sort-merge joins.

Defined cases: null, empty or wordless texts have no words, no hits and no items; items without words have
no window; rows with the same id and text are counted as one document and returned once each, so there are no ties;
words are not split off the middle of other tokens; very long texts are one row of arrays, and their hits rows of
their own; extra columns are ignored, also those named like a result; with an empty benchmark nothing is contaminated;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut, settled

SPAN, K = 13, 5
WINDOW = SPAN - K + 1
BROADCAST_ROWS = 300_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    # anything else becomes a space first: splitting at single spaces is cheaper than collecting matches
    return F.filter(F.split(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")


def hashed(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``h``, the hashes of the text's words."""
    return df.withColumn("h", F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))


def _pairwise(name: str, other: str, step: int, f: str) -> str:
    """Combines each element of an array with the one ``step`` further on; what lies beyond the end is null."""
    return f"zip_with({name}, slice({other}, {step + 1}, greatest(size({other}) - {step}, 0)), (a, b) -> {f}(a, b))"


def _fingerprints(df: DataFrame) -> DataFrame:
    """Adds ``g``: a hash for each sequence of K words, and ``m``: where the smallest of each window stands.

    Hashes of sequences and minima of windows are built by doubling, from neighbours. A hash is compared by its high
    bits, then by its place, which the low 30 bits hold; so the first of equal ones is taken in any text.
    No filter may stand on these arrays: pushed below, it would compute them anew for each element."""
    df = df.withColumn("g", F.expr(_pairwise("h", "h", 1, "xxhash64"))).withColumn("g", F.expr(_pairwise("g", "g", 2, "xxhash64"))).withColumn("g", F.expr(_pairwise("g", "h", 4, "xxhash64")))
    df = df.withColumn("g", F.expr(f"slice(g, 1, greatest(size(h) - {K - 1}, 0))")).withColumn("v", F.expr("transform(g, (x, i) -> (x & -1073741824) | i)"))
    df = df.withColumn("m", F.expr(_pairwise("v", "v", 1, "least"))).withColumn("m", F.expr(_pairwise("m", "m", 2, "least"))).withColumn("m", F.expr(_pairwise("m", "m", 4, "least"))).withColumn("m", F.expr(_pairwise("m", "v", 8, "least")))
    return df.withColumn("m", F.expr(f"transform(array_distinct(slice(m, 1, greatest(size(h) - {SPAN - 1}, 0))), x -> x & 1073741823L)")).drop("v")


def _checked(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")


def benchmark_windows(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, n, window: hashes of its words) of every window of every item."""
    base = hashed(bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")), "text").filter("size(h) > 0")
    return base.select("item", F.explode(F.expr(f"if(size(h) < {SPAN}, array(h), transform(sequence(1, size(h) - {SPAN - 1}), i -> slice(h, i, {SPAN})))")).alias("window")).withColumn("n", F.size("window")).distinct()


def find_windows(docs: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """(key, at, n, wid) of every occurrence of a benchmark window in rows (key, h).

    The rows are read once: fingerprints of 13-word windows and the shorter windows are looked up together."""
    known = windows.groupBy("window", "n").agg(F.xxhash64(F.first("n"), F.col("window")).alias("wid"))
    counts = {r["n"]: r["c"] for r in known.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most 13 rows
    total = sum(counts.values())
    none = docs.select(key, F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("wid")).limit(0)
    if not total:
        return none
    looked_up = known.filter(F.col("n") < SPAN).select("n", F.col("wid").alias("print"))
    wide = _fingerprints(known.filter(F.col("n") == SPAN).select(F.col("window").alias("h")))
    looked_up = looked_up.unionByName(wide.select(F.lit(SPAN).alias("n"), F.expr("g[cast(m[0] as int)]").alias("print"))).distinct()
    places = [f"if(size(h) >= {n}, transform(sequence(0, size(h) - {n}), i -> struct({n} as n, i as at, cast(null as bigint) as print, slice(h, i + 1, {n}) as near)), array())" for n in sorted(counts) if n < SPAN]
    if counts.get(SPAN):
        docs = _fingerprints(docs)
        places.append(f"transform(m, p -> struct({SPAN} as n, cast(p as int) as at, g[cast(p as int)] as print, slice(h, cast(greatest(p - {WINDOW - 1}, 0) as int) + 1, {SPAN + WINDOW - 1}) as near))")
    each = docs.select(key, F.size("h").alias("size"), F.explode(F.expr(f"concat({', '.join(places)})")).alias("x")).select(key, "size", "x.n", "x.at", F.coalesce("x.print", F.xxhash64("x.n", "x.near")).alias("print"), "x.near")
    found = cut(each.join(_checked(looked_up, total), ["n", "print"], "left_semi"), "windows-found")  # dropped by settled()
    # 13-word windows that contain a hit: from eight words before it to the hit itself, inside the text
    base = F.expr(f"greatest(at - {WINDOW - 1}, 0)")
    starts = found.filter(F.col("n") == SPAN).select(key, "n", "near", base.alias("base"), F.explode(F.expr(f"sequence(greatest(at - {WINDOW - 1}, 0), least(at, size - {SPAN}))")).alias("at"))
    spans = starts.select(key, "n", "at", F.expr(f"slice(near, at - base + 1, {SPAN})").alias("window")).unionByName(found.filter(F.col("n") < SPAN).select(key, "n", "at", F.col("near").alias("window")))
    same = known.select("wid", F.col("n").alias("n_"), F.col("window").alias("same"))
    return spans.withColumn("wid", F.xxhash64("n", "window")).join(_checked(same, total), "wid").filter("window = same and n = n_").select(key, "at", "n", "wid").distinct()


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = 5) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans of hit words) for every row."""
    windows = benchmark_windows(bench, item_col, "text")
    # rows of equal id and text are one document: their hits are the same
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    base = hashed(docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text")), "text")
    hits = settled(lambda: find_windows(base.select("key", "h"), windows, "key"), "windows")
    # union of the hit spans of a document: a span begins where no earlier one reaches
    in_order = Window.partitionBy("key").orderBy("lo", "hi")
    runs = hits.select("key", F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi")).distinct()
    runs = runs.withColumn("begins", F.coalesce(F.col("lo") > F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    runs = runs.withColumn("span", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("key", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    named = windows.select(F.xxhash64(F.col("n"), F.col("window")).alias("wid"), "item")
    items = hits.select("key", "wid").distinct().join(named, "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(items, "key")
    counted = docs.select(key.alias("key"), F.size(words(F.col(text_col).cast("string"))).cast("long").alias("n_words"))
    out = counted.join(found, "key", "left")
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (s, x) -> s + x.hi - x.lo)"), F.lit(0).cast("long"))
    out = out.select(F.col("key.id").alias(id_col), F.col("key.t").alias("text_key"), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"), F.coalesce("spans", F.expr("cast(array() as array<struct<lo:int,hi:int>>)")).alias("spans"))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and 100 * n_hit >= {percent} * n_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    bad = cut(contamination(docs, bench, id_col, text_col, **how).filter("contaminated").select(F.col(id_col).alias("id__"), F.col("text_key").alias("t__")), "contaminated")
    bad = _checked(bad, bad.count())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["id__"]) & (F.xxhash64(docs[text_col]) == bad["t__"]), "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).drop("spans", "text_key")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = rf"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS n, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hit AS MATERIALIZED (SELECT doc_id, i, p.n, win.item FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM pos) p JOIN win ON p.s = win.s AND p.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""
