"""N-gram Jaccard join by a token-group matrix.

Each text becomes the set of its distinct three-word shingles (tokens). Similar sets are partitioned into small
groups, and each group's union of tokens is the row of a token-group matrix. A set (the query) that overlaps a group's
union in too few tokens can't be similar to any member, so the group stays closed; only groups that reach the bound are
opened and their members compared exactly.

Which cells of the matrix are worth a bound is decided by segments: at a similarity of ``percent`` two sets of at most m
tokens differ in at most d = 2 m (100 - percent) / (100 + percent) tokens. Tokens are dealt by hash to d + 1 segments, so
two similar sets agree on the whole of one segment at least. A set that shares no segment with another has no partner; a
query is bounded only against groups with a member that shares a segment with it. Frequent words, lines or passages don't
make segments hot, as a segment holds all of a set's tokens in it; sets that are nearly equal do, so

1. every set is compared with its group's hub, the set of which others share most, which joins groups of near copies in
   linear time;
2. in each segment only sets outside its largest component are bounded against the groups that occur there; members of
   one component needn't be compared, since links inside it change nothing (``links`` can list them all the same).

Rows (query, group) are never pairs of sets: a group has up to GROUP sets. Work on a group is cut into parts of QUERIES
queries, so no task gathers more than both bounds, however many queries a group has. Sets and tokens are told apart by
64-bit fingerprints.

Defined cases: null, empty or blank texts have no tokens and are linked with nothing; a text of fewer words than a
shingle is one token; a very long text counts as several sets where groups and parts are bounded; rows of equal sets are
one set, so repeated rows cost nothing more; rows of one id with different texts are linked only if these are similar,
and each of them names its own component; a component has the smallest id of its rows; rows with a null id are linked
with nothing and have a null component; extra columns, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .rolling import U64, buffers, mix64, seeds, word_hashes
from .shared import cut, drop_cut

WORDS = 3
#: Sets in a group, queries in a part of its work, groups of one segment in an array; tokens that count as one set.
GROUP, QUERIES, SLICE, TOKENS = 128, 256, 1024, 4000
BROADCAST_IDS = 500_000


def tokens(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles of a text."""
    at = word_hashes(data)
    n = len(at)
    if not n:
        return at
    place, width = seeds(words, 31) | U64(1), min(words, n)
    acc = np.full(n - width + 1, U64(width))
    for j in range(width):
        acc = acc * U64(0xD6E8FEB86659FD93) + at[j : n - width + 1 + j] * place[j]
    return np.unique(mix64(acc))


def classes(most: int, percent: int) -> np.ndarray:
    """Least sizes of the classes of sizes: similar sets are in one class or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, -(-100 * starts[-1] // percent)))
    return np.array(starts, np.int64)


def segments(items: np.ndarray, kind: int, most: int, percent: int) -> np.ndarray:
    """A fingerprint of the content of each segment, for sets of at most ``most`` tokens of the class ``kind``.

    ``items`` are sorted, and segments are stretches of the range of fingerprints: sums of spans give their contents."""
    n = 2 * most * (100 - percent) // (100 + percent) + 1
    edges = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(U64)
    ends = np.concatenate([[0], np.searchsorted(items, edges), [len(items)]])
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(items + U64(17)), dtype=U64)])
    return mix64(total[ends[1:]] - total[ends[:-1]] + mix64(np.arange(n, dtype=U64) + U64(kind << 32)))


def _sketch(rows: DataFrame, percent: int) -> DataFrame:
    """(id, n: tokens, node: fingerprint of the set, segs: of its own class and as the smaller one of the next) of rows (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = classes(1 << 10, percent)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, nodes, segs = [], [], []
                for data in buffers(part.column(1)):
                    items = tokens(data)
                    n.append(len(items))
                    nodes.append(int(mix64(items + U64(3)).sum(dtype=U64) + U64(len(items))))
                    if not len(items):
                        segs.append(np.empty(0, U64))
                        continue
                    while len(items) * 2 > starts[-1]:
                        starts = classes(4 * int(starts[-1]), percent)
                    k = int(np.searchsorted(starts, len(items), "right")) - 1
                    segs.append(np.concatenate([segments(items, k + j, int(starts[k + j + 1]) - 1, percent) for j in (0, 1)]))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, segs)]).astype(np.int32), pa.array(np.concatenate(segs).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(np.array(nodes, U64).view(np.int64)), lists], names=["id", "n", "node", "segs"])

    return rows.select("id", "text").mapInArrow(work, "id long, n long, node long, segs array<long>")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items) of the sets ``wanted`` (node, id: of a row that has it)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [tokens(x) for x in buffers(batch.slice(lo, 256).column(0))]
                nodes = [int(mix64(x + U64(3)).sum(dtype=U64) + U64(len(x))) for x in sets]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, U64).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "items"])

    few = wanted.count() <= BROADCAST_IDS
    limit = lambda keys: F.broadcast(keys) if few else keys.hint("merge")
    texts = rows.join(limit(wanted.select("id").distinct()), "id", "left_semi").select("text")
    found = texts.mapInArrow(work, "node long, items array<long>")
    return found.join(limit(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"])


def _partition(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, big, n, score): the group of similar sets that each set belongs to, by the segment that it shares with most others.

    ``score`` tells how much of a set others have: among copies of one text with changes of their own, the text has most."""
    shared = members.groupBy("node").agg(F.max(F.struct("c", "seg")).getField("seg").alias("big"), F.sum("c").alias("score"))
    return shared.join(sizes.hint("merge"), "node")


def _small(groups: DataFrame) -> DataFrame:
    """(node, group): groups cut down to GROUP sets, a very long set counting for several."""
    weight = F.expr(f"1 + n div {TOKENS}")
    parts = groups.groupBy("big").agg(F.ceil(F.sum(weight) / GROUP).alias("parts"))
    return groups.join(parts.hint("merge"), "big").select("node", F.xxhash64("big", F.pmod(F.xxhash64("node"), "parts")).alias("group"), "n")


def _open(cells: DataFrame, groups: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): links between queries and members of the cells (node, group), groups being (node, group).

    Of links between the same two components one is enough if there are ``labels`` (node, component)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, seen = None, set()

        def compared() -> pa.RecordBatch:
            links = [x for x in _matrix(held, percent) if x[0] != x[1] and (x[2] is None or x[2] not in seen and not seen.add(x[2]))] if held else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([min(x[:2]) for x in links], pa.int64()), pa.array([max(x[:2]) for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            group, part, query, node, component = (batch.column(k).to_pylist() for k in range(5))
            lists = batch.column(5)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
            for k in range(batch.num_rows):
                if (group[k], part[k]) != at:
                    yield compared()
                    at = (group[k], part[k])
                held.append((query[k], node[k], component[k], values[ends[k] : ends[k + 1]]))
        yield compared()

    per = cells.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    left = cells.join(per.hint("merge"), "group").select("group", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(True).alias("query"), "node")
    right = groups.join(per.hint("merge"), "group").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"), "node")
    rows = left.unionByName(right)
    rows = rows.withColumn("component", F.lit(None).cast("long")) if labels is None else rows.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.join(sets.hint("merge"), "node").select("group", "part", "query", "node", "component", "items")
    return rows.repartition("group", "part").sortWithinPartitions("group", "part", "query").mapInArrow(work, "a long, b long").distinct()


def _matrix(rows: list[tuple], percent: int) -> Iterator[tuple]:
    """(query, member, components or None) of the similar sets of one group; rows are (query?, node, component, items), members first."""
    members = [x for x in rows if not x[0]]
    sizes = np.array([len(x[3]) for x in members])
    if not len(members):
        return
    flat, owner = np.concatenate([x[3] for x in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    union, until = flat[first], np.append(first[1:], len(flat))
    for _, node, component, items in rows[len(members) :]:
        n = len(items)
        able = (100 * sizes >= percent * n) & (100 * n >= percent * sizes)
        if not able.any():
            continue
        where = np.searchsorted(union, items)
        where[where == len(union)] = 0
        where = where[union[where] == items]
        # the group's bound: a member of the least possible size needs so many tokens in common
        if (100 + percent) * len(where) < percent * (n + int(sizes[able].min())):
            continue
        count = until[where] - first[where]
        common = np.bincount(owner[np.repeat(first[where] - np.cumsum(count) + count, count) + np.arange(count.sum())], minlength=len(members))
        for k in np.flatnonzero(able & ((100 + percent) * common >= percent * (n + sizes))).tolist():
            _, other, theirs, _ = members[k]
            if component is None:
                yield node, other, None
            elif component != theirs:
                yield node, other, (min(component, theirs), max(component, theirs))


def _cells(members: DataFrame, groups: DataFrame, outside: DataFrame) -> DataFrame:
    """(node, group): the cells to bound: queries ``outside`` (seg, node), and the groups in which a member shares a segment with them.

    A segment's groups are gathered in arrays, so that a query which shares many segments with a group meets it once."""
    there = members.join(groups.select("node", "group").hint("merge"), "node").select("seg", "group").distinct()
    many = there.groupBy("seg").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    slices = there.join(many.hint("merge"), "seg").groupBy("seg", F.pmod(F.xxhash64("group"), "slices").alias("slice")).agg(F.collect_list("group").alias("groups"))
    met = outside.join(slices.select("seg", "groups").hint("merge"), "seg").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("groups"))).alias("groups"))
    return met.select("node", F.explode("groups").alias("group"))


def _shared(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets (node, n, id, copies) that rows have, and members (seg, node, c: sets of the segment) of segments that several sets share."""
    nodes = base.filter("n > 0 and id is not null").groupBy("node").agg(F.first("n").alias("n"), F.min("id").alias("id"), F.first("segs").alias("segs"))
    nodes = cut(nodes, "jaccard-nodes")
    keys = nodes.select("node", F.explode("segs").alias("seg"))
    several = keys.groupBy("seg").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("c")).filter("x <> y").select("seg", "c")
    members = cut(keys.join(several.hint("merge"), "seg").groupBy("seg", "node").agg(F.first("c").alias("c")), "jaccard-members")
    return nodes, members


def _prepared(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (id, n, node); members (seg, node); sizes (node, n); sets (node, items) of all members."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = cut(_sketch(rows, percent), "jaccard-base")
    nodes, members = _shared(base)
    wanted = cut(nodes.select("node", "n", "id").join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "jaccard-wanted")
    drop_cut(nodes)
    sets = cut(_sets(rows, wanted), "jaccard-sets")
    return base.select("id", "n", "node"), members, wanted.select("node", "n"), sets


def _classes(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, node) and (node, component) of linked sets."""
    base, members, sizes, sets = _prepared(docs, id_col, text_col, percent)
    big = cut(_partition(members, sizes), "jaccard-big")
    hubs = big.groupBy("big").agg(F.max(F.struct("score", "node")).getField("node").alias("hub"))
    cells = cut(big.join(hubs.hint("merge"), "big").filter("node <> hub").select("node", F.col("hub").alias("group")), "jaccard-cells")
    links = cut(_open(cells, cells.select("group", F.col("group").alias("node")).distinct(), sets, None, percent), "jaccard-links")
    drop_cut(cells)
    labels = components(links)
    groups = cut(_small(big), "jaccard-groups")
    at = members.join(labels.hint("merge"), "node", "left").select("seg", "node", F.coalesce("component", "node").alias("component"))
    per = at.groupBy("seg", "component").agg(F.count("*").alias("n")).groupBy("seg").agg(F.max(F.struct("n", "component")).getField("component").alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    split = cut(at.join(per.select("seg", "top").hint("merge"), "seg"), "jaccard-split")
    cells = cut(_cells(split, groups, split.filter("component <> top").select("seg", "node")), "jaccard-cells")
    more = cut(_open(cells, groups.select("node", "group"), sets, labels, percent), "jaccard-links")
    final = components(links.unionByName(more))
    for x in (big, labels, groups, split, cells, links, more):
        drop_cut(x)
    return base, final


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) of every row: classes of texts linked by similarity >= percent / 100."""
    base, final = _classes(docs, id_col, text_col, percent)
    linked = base.filter("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("least"))
    named = linked.join(final.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    named = named.join(names.hint("merge"), "component").select("node", "name")
    own = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("name"))
    return base.join(named.hint("merge"), "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(own, "id").alias("component_id"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Every link (a, b) between different sets, and membership (id, node) of the rows with a set.

    All members of near-copy groups are compared here, so this takes time with the square of such a group."""
    base, members, sizes, sets = _prepared(docs, id_col, text_col, percent)
    groups = cut(_small(_partition(members, sizes)), "jaccard-groups")
    cells = cut(_cells(members, groups, members), "jaccard-cells")
    found = cut(_open(cells, groups.select("node", "group"), sets, None, percent), "jaccard-links")
    for x in (groups, cells):
        drop_cut(x)
    return found, base.filter("n > 0 and id is not null").select(F.col("id").alias(id_col), "node")


def op11_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
