"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens flows down a tree (domain, language, source by default). At each node the children
get shares by weight; a child that cannot use its share (its documents, read ``max_epochs`` times,
hold fewer tokens) gives the shortage to its siblings, and only what a whole subtree cannot use is
passed to the siblings of its ancestors. Each leaf then takes a token-prefix of its documents, dealt
in a seeded order of their own in every epoch.

The split of one node's budget is a closed form: with children sorted by capacity/weight, exactly a
prefix of them is filled, so a window over siblings finds it. Shares are whole tokens; what rounding
down leaves over goes to the largest remainders, then to the first name.
The prefix of a leaf is found without sorting the leaf in one task: documents fall into bins by their
seeded hash, bin totals are summed, and only the bin in which the budget ends is ordered.

Defined cases: null or blank texts have no tokens and are never selected; null tree columns count as
the value ``(none)``; null ids have a place of their own kind and are selected like others; rows of one id are
separate documents with one place, ordered by tokens and a hash of the text (equal rows are interchangeable); a text
counts whole, however long, and is selected only if all of it fits the budget; extra columns are ignored, also those
named like a result; an empty table gives an empty selection. The children of one node meet in a task; documents don't.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

BIN_ROWS = 2000  # documents of a bin, on average
BROADCAST_LEAVES = 50_000  # a leaf table of more rows is joined by shuffles


def count_tokens(text: Column) -> Column:
    """Words separated by ASCII white space."""
    return F.when(F.coalesce(F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")), " +"))).cast("long")


def _split(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Adds ``share`` to sibling rows (weight, capacity and their parent's ``budget``); without a weight above 0 it is 0."""
    claim = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(0.0)
    w = Window.partitionBy(*parent).orderBy(claim, *[c for c in nodes.columns if c == "node"])
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    left = F.greatest(F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0))
    out = nodes.withColumns({"left": left, "open": F.sum("weight").over(rest)})
    # the first child that isn't filled fixes the rate of all that follow
    out = out.withColumn("filled", F.expr("capacity * open <= weight * left"))
    first = F.min(F.when(~F.col("filled"), F.struct(claim.alias("claim"), "node", "left", "open"))).over(Window.partitionBy(*parent))
    out = out.withColumn("stop", first)
    # whole tokens are left over by rounding down; they go to the largest remainders
    out = out.withColumns({"floor": F.expr("if(filled, capacity, weight * stop.left div stop.open)"), "part": F.expr("if(filled, -1, weight * stop.left % stop.open)")})
    short = F.expr("stop.left") - F.sum(F.when(~F.col("filled"), F.col("floor"))).over(Window.partitionBy(*parent))
    place = F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("part"), "node"))
    share = F.col("floor") + (~F.col("filled") & (place <= short)).cast("int")
    return out.withColumn("share", share.cast("long")).drop("left", "open", "filled", "stop", "floor", "part")


def budgets(leaves: DataFrame, path: list[str], total: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """Adds ``budget`` to leaf rows (path columns, tokens). ``weights``: by path column and value; 1 if absent, and 0 leaves out what is below."""
    weights = weights or {}

    def weight(level: str) -> Column:
        known = weights.get(level) or {}
        return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col(level)], F.lit(1)) if known else F.lit(1)

    left_in = F.lit(True)
    for level in path:
        left_in = left_in & (weight(level) > 0)
    # what a weight of 0 leaves out counts for no ancestor either
    leaves = leaves.withColumn("capacity", F.when(left_in, F.col("tokens") * max_epochs).otherwise(0))
    got, parent = None, []
    for level in path:
        nodes = leaves.groupBy(*parent, level).agg(F.sum("capacity").alias("capacity")).withColumns({"weight": weight(level).cast("long"), "node": F.col(level)})
        nodes = nodes.withColumn("parent_budget", F.lit(total).cast("long")) if got is None else nodes.join(got, parent)
        got = _split(nodes, parent or [F.lit(0)], "parent_budget").select(*parent, level, F.col("share").alias("parent_budget"))
        parent = [*parent, level]
    return leaves.drop("capacity").join(got.withColumnRenamed("parent_budget", "budget"), path)


def order_key(seed: int, epoch: Column, ident: Column) -> Column:
    """Place of a document in an epoch: 32 hexadecimal digits that any engine with MD5 can recompute."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), ident.cast("string")).cast("binary"))


def mix(docs: DataFrame, path: list[str], total_tokens: int | None = None, max_epochs: int = 2, seed: int = 42, weights: Mapping[str, Mapping[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", share_of_corpus: float = 0.5) -> DataFrame:
    """(id, path columns, tokens, epoch, place, budget) of the selected documents.

    ``total_tokens`` is the budget; by default ``share_of_corpus`` of the corpus' tokens."""
    items = docs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(p).cast("string"), F.lit("(none)")).alias(p) for p in path], count_tokens(F.col(text_col)).alias("tokens"), F.xxhash64(text_col).alias("t")).filter("tokens > 0")
    items = cut(items, "mix-items")  # texts are read and counted once
    leaves = items.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    n_leaves, corpus = leaves.agg(F.count("*"), F.sum("tokens")).first()
    if total_tokens is None:
        total_tokens = int((corpus or 0) * share_of_corpus)
    plan = budgets(leaves, path, total_tokens, max_epochs, weights)
    # whole epochs are taken without any order; the last, partial one by bins of the seeded hash
    plan = plan.withColumns({"whole": F.expr("cast(budget div tokens as int)"), "rest": F.expr("budget % tokens"), "bins": F.expr(f"greatest(1, n div {BIN_ROWS})")}).drop("n")
    plan = cut(plan.withColumnRenamed("tokens", "leaf_tokens"), "mix-plan")  # read five times, made once
    each = items.join(F.broadcast(plan) if n_leaves <= BROADCAST_LEAVES else plan.hint("merge"), path)
    full = each.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    # kept as a column: the bin is the leading part of the key, so bins are in the order of the key
    part = each.filter("rest > 0").withColumn("epoch", F.col("whole")).withColumn("place", order_key(seed, F.col("epoch"), F.col("id")))
    part = part.withColumn("bin", F.expr("cast(conv(substr(place, 1, 8), 16, 10) as bigint) * bins div 4294967296"))
    sums = part.groupBy(*path, "bin").agg(F.sum("tokens").alias("in_bin"))
    sums = sums.withColumn("before", F.sum("in_bin").over(Window.partitionBy(*path).orderBy("bin")) - F.col("in_bin"))
    part = part.join(sums, [*path, "bin"])
    inside = part.filter("before + in_bin <= rest")
    edge = part.filter("before + in_bin > rest AND before < rest")
    run = Window.partitionBy(*path, "bin").orderBy("place", "id", "tokens", "t").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(run)).filter("upto <= rest").drop("upto")
    cols = ["id", *path, "tokens", "epoch", "place", "budget"]
    full = full.withColumn("place", order_key(seed, F.col("epoch"), F.col("id")))
    return full.select(cols).unionByName(inside.select(cols)).unionByName(edge.select(cols)).withColumnRenamed("id", id_col)


#: Production parameters of the query: the tree, its weights, and half of the corpus as the budget.
PATH = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"web": 3, "books": 2, "code": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2}}
DOMAIN_SQL = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') THEN 'web' WHEN source IN ('src6', 'src7', 'src8', 'src9', 'src10', 'src11', 'src12') THEN 'books' ELSE 'code' END"


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("domain", F.expr(DOMAIN_SQL))
    return mix(docs, PATH, weights=WEIGHTS)


def _split_sql(name: str, nodes: str, parent: list[str]) -> str:
    part = f"PARTITION BY {', '.join(parent)} " if parent else ""
    return f"""{name}_a AS (SELECT *, greatest(parent_budget - coalesce(sum(capacity) OVER ({part}ORDER BY capacity / weight, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft,
 sum(weight) OVER ({part}ORDER BY capacity / weight, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opn FROM ({nodes})),
{name}_b AS (SELECT *, capacity * opn <= weight * lft AS filled FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN NOT filled THEN {{'r': capacity / weight, 'node': node, 'lft': lft, 'opn': opn}} END) OVER ({part or ''}) AS stp FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN filled THEN capacity ELSE weight * stp.lft // stp.opn END AS flr, CASE WHEN filled THEN -1 ELSE weight * stp.lft % stp.opn END AS rmd FROM {name}_c),
{name} AS (SELECT *, CAST(flr + CASE WHEN NOT filled AND row_number() OVER ({part}ORDER BY rmd DESC, node) <= stp.lft - sum(CASE WHEN NOT filled THEN flr END) OVER ({part or ''}) THEN 1 ELSE 0 END AS BIGINT) AS share FROM {name}_d)"""


def _weight_sql(level: str) -> str:
    return f"CASE l.{level}" + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"


def op1_sql() -> str:
    words = "len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))"
    parts = [f"""WITH items AS (SELECT doc_id, {DOMAIN_SQL} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, CAST({words} AS BIGINT) AS tokens FROM documents WHERE {words} > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS leaf_tokens, CAST(sum(tokens) * 2 AS BIGINT) AS capacity FROM items GROUP BY ALL)"""]
    for k, level in enumerate(PATH):
        up, here = PATH[:k], PATH[: k + 1]
        cols = ", ".join(f"l.{c}" for c in here)
        budget = "CAST(any_value(p.share) AS BIGINT)" if k else "(SELECT CAST(floor(sum(leaf_tokens) * 0.5) AS BIGINT) FROM leaves)"
        join = f"JOIN {PATH[k - 1]}_s p ON {' AND '.join(f'l.{c} = p.{c}' for c in up)}" if k else ""
        nodes = f"SELECT {cols}, l.{level} AS node, CAST(sum(l.capacity) AS BIGINT) AS capacity, {_weight_sql(level)} AS weight, {budget} AS parent_budget FROM leaves l {join} GROUP BY {cols}"
        parts.append(_split_sql(f"{level}_s", nodes, up))
    parts.append("""picked AS (SELECT i.*, s.share AS budget, CAST(e.epoch AS INTEGER) AS epoch, md5('42/' || e.epoch || '/' || i.doc_id) AS place, l.leaf_tokens FROM items i JOIN source_s s USING (domain, lang, source) JOIN leaves l USING (domain, lang, source) CROSS JOIN (SELECT unnest([0, 1]) AS epoch) e),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + epoch * leaf_tokens AS upto FROM picked)
SELECT doc_id, domain, lang, source, tokens, epoch, place, budget FROM run WHERE upto <= budget""")
    return ",\n".join(parts)
