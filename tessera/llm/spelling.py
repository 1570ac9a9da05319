"""Spelling variant grouping by a trie self-join with active-node sets.

The vocabulary is a trie, partitioned by prefix. The active nodes of a node are the nodes whose strings differ from its
own by at most one edit; they follow from those of its parent, so one walk down the trie finds every pair of words at
distance one. A pair parts somewhere:

* below a partition's prefix: the subtree lies in one task, which builds it and propagates active-node sets;
* above it: from the node where the pair parts, its active nodes are at distance one already, so what follows must be
  equal. Such nodes lead to single words, and a join on (prefix, what follows) emits the pairs. Its groups have a word
  for each letter of the alphabet at most.

Prefixes grow until a subtree has at most SUBTREE words, so neither a frequent prefix nor the vocabulary's size decides
what a task holds; what a longer prefix no longer covers is left to the join. Words are told apart as they are; nothing is
approximated.

Forms: a word's form is its near word of the largest count if that has FACTOR times the word's own count. Counts grow
along forms by that factor, so chains of forms are short; roots are found by doubling.

Defined cases: null, empty or blank texts have no words; a very long text gives words like others; repeated rows count
again (with equal ids, they are damaged alike); null ids count as an empty id in the checksum; ties of counts go to the
word that is smaller in code-point order; words without near ones have n_near 0 and themselves as root; extra columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, drop_cut

RUN, LEAST, TWICE, DEAL, FACTOR = r"[A-Za-zÀ-ÿ]+", 7, 2, 31, 10
#: Words of a subtree that one task walks down at a time, and code points of the shortest prefix.
SUBTREE, SHORTEST = 2000, 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deal: int | None = None) -> DataFrame:
    """(word, n): runs of letters of at least LEAST code points that occur TWICE. With ``deal``, a checksum of id and run
    deletes one code point of every ``deal``-th of them: variants to be grouped."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), 0)).alias("run")).filter(F.length("run") >= LEAST)
    runs = runs.select("id", lowered(F.col("run")).alias("word"))
    if deal:
        h, size = F.col("h"), F.length("word")
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        place = F.pmod(h, size).cast("int")
        runs = runs.withColumn("word", F.when(h % deal == 0, F.concat(F.expr("left(word, int(pmod(h, length(word))))"), F.substring("word", place + 2, size))).otherwise(F.col("word")))
    return runs.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= TWICE)


def subtrees(words: DataFrame, least: int = SHORTEST, most: int | None = None) -> DataFrame:
    """(word, depth): how long the prefix is by which the word's subtree is cut off the trie; subtrees have at most ``most``
    words, or only such as end at their root."""
    most = most or SUBTREE
    rest, done, depth, made = words.select("word"), [], least, []
    while True:
        prefix = F.left("word", F.lit(depth))
        large = rest.filter(F.length("word") > depth).groupBy(prefix.alias("prefix")).count().filter(F.col("count") > most).select("prefix")
        large = cut(large, "spelling-large")
        if large.isEmpty():
            drop_cut(large)
            done.append(rest.withColumn("depth", F.lit(depth)))
            break
        inside = prefix == large["prefix"]
        done.append(rest.join(large.hint("merge"), inside, "left_anti").withColumn("depth", F.lit(depth)))
        kept = cut(rest.join(large.hint("merge"), inside, "left_semi"), "spelling-rest")
        made.append(kept)
        rest, depth = kept, depth + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = cut(out, "spelling-subtrees")
    for x in made:
        drop_cut(x)
    return out


def _walk(words: list[str], depth: int) -> Iterator[tuple[str, str]]:
    """Pairs of the words below one prefix of ``depth`` code points that are at distance one, by active-node sets."""
    children: list[dict[str, int]] = [{}]
    ends: list[str | None] = [None]
    for w in words:
        at = 0
        for c in w[depth:]:
            to = children[at].get(c)
            if to is None:
                to = children[at][c] = len(children)
                children.append({})
                ends.append(None)
            at = to
        ends[at] = w
    # active nodes of a node: itself at distance 0, and others at distance 1
    todo = [(0, list(children[0].values()))]
    while todo:
        node, near = todo.pop()
        if (word := ends[node]) is not None:
            for v in near:
                if (other := ends[v]) is not None:
                    yield word, other
        below = children[node]
        for c, child in below.items():
            active = {node}  # the letter is one too many
            active.update(to for v in near if (to := children[v].get(c)) is not None)  # the edit is behind
            active.update(to for to in below.values() if to != child)  # another letter stands there
            active.update(children[child].values())  # a letter is missing
            active.discard(child)
            todo.append((child, list(active)))


def _below(placed: DataFrame) -> DataFrame:
    """(word, near) of pairs that part below their subtree's root; each pair in both directions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        at = None

        def pairs() -> Iterator[pa.RecordBatch]:
            found = list(_walk(held, at[0])) if len(held) > 1 else []
            held.clear()
            for lo in range(0, len(found), 1 << 16):
                part = found[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.string())], names=["word", "near"])

        for batch in batches:
            for word, depth, prefix in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (depth, prefix) != at:
                    yield from pairs()
                    at = (depth, prefix)
                held.append(word)
        yield from pairs()

    rows = placed.filter(F.length("word") >= F.col("depth")).withColumn("prefix", F.expr("left(word, depth)"))
    return rows.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix").select("word", "depth", "prefix").mapInArrow(work, "word string, near string")


def _above(placed: DataFrame) -> DataFrame:
    """(word, near) of pairs that part above the roots of their subtrees, in both directions.

    At the node where they part one has a letter that the other has not, or another one; what follows is equal."""
    at = F.explode(F.expr("sequence(0, least(depth, length(word)) - 1)"))
    steps = placed.select("word", at.alias("at")).withColumn("prefix", F.expr("left(word, at)"))
    without = steps.select("at", "prefix", F.expr("substring(word, at + 2)").alias("rest"), "word", F.expr("substring(word, at + 1, 1)").alias("letter"))
    # as the word that lacks the letter: also where it ends just there
    lacking = placed.select("word", F.explode(F.expr("sequence(0, least(depth - 1, length(word)))")).alias("at")).select("at", F.expr("left(word, at)").alias("prefix"), F.expr("substring(word, at + 1)").alias("rest"), "word", F.lit("").alias("letter"))
    met = without.unionByName(lacking).groupBy("at", "prefix", "rest").agg(F.collect_list(F.struct("letter", "word")).alias("there")).filter("size(there) > 1")
    pairs = met.select(F.explode("there").alias("x"), "there").select("x", F.explode("there").alias("y")).filter("x.letter <> y.letter and x.word <> y.word")
    return pairs.select(F.col("x.word").alias("word"), F.col("y.word").alias("near"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near) of all words that differ by one inserted, deleted or replaced code point, in both directions."""
    placed = subtrees(words)
    return _below(placed).unionByName(_above(placed)).distinct()


def group(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n)."""
    words = cut(words, "spelling-words")
    pairs = near_pairs(words)
    counted = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    known = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("first.near").alias("form"), (-F.col("first.less")).alias("form_n"))
    enough = F.col("form_n") >= FACTOR * F.col("n")
    known = cut(known.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}), "spelling-known")
    drop_cut(words)
    roots = cut(known.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # each round doubles what a step passes over
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        drop_cut(roots)
        if longer.filter("moved").isEmpty():
            break
        roots = longer
    return known.join(longer.select("word", "root").hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return group(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), deal=DEAL))
