"""Suppression of repeated passages in ranked results.

The greedy rule is a fold over a short list (a column of arrays), or rounds over the similar pairs of lists of any
length. Repeats across the whole corpus are found by fingerprint, as a window over each fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import dedup_tokens, fingerprint, jaccard
from ..session import written

MIN_TOKENS = 12
FREQUENT = 1000  # tokens that are ordered by how often they occur


def exact_copies(df: DataFrame, text_col: str, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Adds ``copy_rank``: 1 for the best-ranked text of each fingerprint."""
    w = Window.partitionBy(*(partition or []), "fingerprint").orderBy(*order)
    return df.withColumn("fingerprint", fingerprint(text_col)).withColumn("copy_rank", F.row_number().over(w))


def near_duplicates(ranked: Column, threshold: float = 0.9, least: int = MIN_TOKENS) -> Column:
    """Kept items of a ranked array of struct(id, text): a text goes if it repeats, or nearly repeats, one that stays.

    Short texts only go as exact repeats; a threshold above 1 turns near repeats off."""
    kind = "array<struct<id:string,f:string,t:array<string>>>"
    items = F.transform(ranked, lambda x: F.struct(x["id"].cast("string").alias("id"), F.sha1(F.array_join(dedup_tokens(x["text"]), " ")).alias("f"), F.array_distinct(dedup_tokens(x["text"])).alias("t")))

    def step(kept: Column, x: Column) -> Column:
        again = F.exists(kept, lambda k: k["f"] == x["f"])
        near = (F.size(x["t"]) >= least) & F.exists(kept, lambda k: (F.size(k["t"]) > 0) & (jaccard(k["t"], x["t"]) >= threshold))
        return F.when(again | near, kept).otherwise(F.concat(kept, F.array(x)))

    return F.transform(F.aggregate(items, F.expr(f"cast(array() as {kind})"), step), lambda k: k["id"])


def similar_pairs(items: DataFrame, threshold: float, least: int = MIN_TOKENS) -> DataFrame:
    """(a, b): items (node, query, o, id, f, t: distinct tokens) of one list of which the later one, b, nearly repeats a.

    Of two sets that are similar enough, the first tokens in one order of all tokens share one, if so many are taken that
    the rest is too small to make up for it; and where they first share one, enough tokens are left in both. The FREQUENT
    most common tokens come last in the order, the commonest at the end, so few sets meet in one. Each row orders its own
    tokens: only the first ones are shuffled, as hashes, and the sets of those that met."""
    slots = lambda n: n - F.ceil(F.lit(threshold) * n - 1e-9) + 1
    counts = items.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    frequent = counts.orderBy(F.desc("df"), "token").limit(FREQUENT).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).getField("token").alias("frequent"))
    ordered = F.concat(F.sort_array(F.array_except("t", "frequent")), F.array_intersect("frequent", "t"))
    first = items.crossJoin(F.broadcast(frequent)).select("query", "node", F.size("t").alias("n"), F.posexplode(F.slice(ordered, F.lit(1), slots(F.size("t")).cast("int"))).alias("at", "token"))
    first = first.select("query", "node", "n", (F.col("n") - F.col("at")).alias("left"), F.xxhash64("token").alias("token"))
    x, y = first.alias("x"), first.alias("y")
    fits = (F.greatest("x.n", "y.n") >= least) & (F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n") - 1e-9)
    fits = fits & (F.least("x.left", "y.left") >= F.lit(threshold / (1 + threshold)) * (F.col("x.n") + F.col("y.n")) - 1e-6)
    met = x.join(y, F.col("x.query").eqNullSafe(F.col("y.query")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    side = lambda node, order, tokens: items.select(F.col("node").alias(node), F.struct("o", "id", "f", "node").alias(order), F.col("t").alias(tokens))
    both = met.join(side("a", "p", "s"), "a").join(side("b", "r", "u"), "b")
    later = F.when(F.col("p") < F.col("r"), F.size("u")).otherwise(F.size("s"))
    both = both.filter((later >= least) & (jaccard(F.col("s"), F.col("u")) >= threshold))
    return both.select(F.least("p", "r")["node"].alias("a"), F.greatest("p", "r")["node"].alias("b"))


def first_independent(edges: DataFrame) -> DataFrame:
    """(node): what goes if, in order, every node goes that an earlier one which stays points to by an edge (a, b).

    In each round nodes that nothing points to stay, and those that they point to go; edges of both are left out. Rounds
    grow with the longest chain of nodes that wait for each other, not with their number."""
    gone = None
    edges = written(edges, "edges")
    while not edges.isEmpty():
        stay = edges.select(F.col("a").alias("node")).distinct().join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
        out = written(edges.join(stay, edges["a"] == stay["node"], "left_semi").select(F.col("b").alias("node")).distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        left = edges.join(out, edges["a"] == out["node"], "left_anti")
        left = left.join(out, left["b"] == out["node"], "left_anti")
        edges = written(left.join(stay, left["a"] == stay["node"], "left_anti"), "edges")
    return edges.select(F.col("a").alias("node")) if gone is None else gone.distinct()


def suppress(results: DataFrame, query_col: str, id_col: str, text_col: str, order_col: str, threshold: float = 0.9, least: int = MIN_TOKENS) -> DataFrame:
    """(query, id) of the results that stay, for result lists of any length, by the rule of :func:`near_duplicates`.

    The first of texts with one fingerprint speaks for all of them: what it nearly repeats, its copies do too. The others
    are paired by a set-similarity join, and the greedy rule runs in rounds over the pairs. Null queries are one list;
    ties of order are broken by id, then by fingerprint."""
    if not threshold > 0:
        raise ValueError("a threshold is above 0")
    rows = results.select(F.monotonically_increasing_id().alias("node"), F.col(query_col).alias("query"), F.col(id_col).cast("string").alias("id"), F.col(order_col).alias("o"), dedup_tokens(text_col).alias("all"))
    items = written(rows.select("node", "query", "id", "o", F.unhex(F.sha1(F.array_join("all", " "))).alias("f"), F.array_distinct("all").alias("t")), "items")
    firsts = items.groupBy("query", "f").agg(F.min(F.struct("o", "id", "node"))["node"].alias("node")).select("node")
    items = written(items.join(firsts, "node", "left_semi"), "firsts")
    stay = items if threshold > 1 else items.join(first_independent(similar_pairs(items, threshold, least)), "node", "left_anti")
    return stay.select(F.col("query").alias(query_col), F.col("id").alias(id_col))
