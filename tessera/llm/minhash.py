"""Near-duplicate classes by b-bit MinHash.

Each text becomes the set of its distinct five-word shingles. 128 minima are cut into 32 bands of
four, whose buckets give candidates; the low four bits of each minimum are packed into 64 bytes, and
the share of equal minima, corrected for chance agreement (2**-4), estimates the similarity of a
candidate from bit counts. Every candidate that could reach the threshold is then confirmed on the full
sets. At a similarity of exactly 0.75 the bands miss a pair with probability 5e-6.

No bucket is ever paired off into rows. Texts of equal sets are collapsed first; each bucket's members are
compared with one of its largest component, and only those that stay outside are held against the rest of
their bucket, in squares of signatures inside tasks (see ``find_links``). Since links inside a component
can't change it, no link between different texts is lost.

Defined cases: null, empty or blank texts have no shingles, are linked with nothing and kept; texts shorter
than five words are one shingle; a very long text is one set, and fewer of them share a task; every row is a document
of its own, also where ids repeat: rows of one id with equal texts are in one class, with different texts only if those
are similar; a class has the smallest id of its rows, and all rows that have this id are kept; rows with null ids are
kept and linked with nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .rolling import U64, buffers, mix64, seeds, word_hashes
from .shared import cut, drop_cut

WORDS, BANDS, ROWS, BITS = 5, 32, 4, 4
MINIMA = BANDS * ROWS
BLOCK, HUBS, ITEMS = 256, 2, 4000
SLACK = 0.18  # four and a half standard deviations of the estimate at 0.75
BROADCAST_IDS = 500_000

_MULTIPLY, _ADD = seeds(MINIMA, 5) | U64(1), seeds(MINIMA, 6)
_PLACE = seeds(WORDS, 7) | U64(1)


def shingles(data: np.ndarray) -> np.ndarray:
    """Sorted distinct fingerprints of the five-word shingles of a text."""
    words = word_hashes(data)
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        acc = U64(n) + np.zeros(1, U64)
        for j in range(n):
            acc = mix64(acc * _PLACE[0] + words[j : j + 1])
        return acc
    acc = np.zeros(n - WORDS + 1, U64)
    for j in range(WORDS):
        acc += words[j : n - WORDS + 1 + j] * _PLACE[j]
    return np.unique(mix64(acc))


def minima(items: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(U64).max, U64)
    for lo in range(0, len(items), 512):
        np.minimum(out, (items[lo : lo + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=out)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """The low bits of all minima as eight 64-bit numbers."""
    parts = (low & U64((1 << BITS) - 1)).reshape(8, 16)
    return (parts << (np.arange(16, dtype=U64) * U64(BITS))).sum(axis=1, dtype=U64)


def sketch(rows: DataFrame) -> DataFrame:
    """(id, linked, n: shingles, set_a, set_b: fingerprint of the set, sig: packed minima, bands) of rows (key, text, linked)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_seed = seeds(BANDS, 8)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, a, b, sig, bands = [], [], [], [], []
                for data in buffers(part.column(2)):
                    items = shingles(data)
                    n.append(len(items))
                    a.append(int(items.sum(dtype=U64)))
                    b.append(int(np.bitwise_xor.reduce(mix64(items + U64(9)))) if len(items) else 0)
                    low = minima(items)
                    sig.append(pack(low).view(np.int64))
                    acc = band_seed
                    for row in low.reshape(ROWS, BANDS):
                        acc = mix64(acc * U64(0xD6E8FEB86659FD93) + row)
                    bands.append(acc.view(np.int64) if len(items) else np.empty(0, np.int64))
                lists = lambda xs: pa.ListArray.from_arrays(np.cumsum([0, *map(len, xs)]).astype(np.int32), pa.array(np.concatenate(xs)))
                ints = lambda xs: pa.array(np.array(xs, U64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), ints(a), ints(b), lists(sig), lists(bands)], names=["id", "linked", "n", "set_a", "set_b", "sig", "bands"])

    return rows.select("key", "linked", "text").mapInArrow(work, "id long, linked boolean, n long, set_a long, set_b long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from bit counts: a minimum differs if any of its low bits does."""
    differ = F.lit(0)
    for k in range(8):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(MINIMA))) - chance) / (1 - chance)


def _sets(docs: DataFrame) -> DataFrame:
    """(id, items): the full shingle sets, sorted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(x).view(np.int64) for x in buffers(part.column(1))]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["id", "items"])

    return docs.mapInArrow(work, "id long, items array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "items": "xs"}).hint("merge"), "a").join(sets.withColumnsRenamed({"id": "b", "items": "ys"}).hint("merge"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("xs", "ys")).cast("long"))
    return cut(both.filter(F.expr(f"100 * common >= {percent} * (size(xs) + size(ys) - common)")).select("a", "b").distinct(), "minhash-links")


def _located(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, id, component)"""
    if labels is None:
        return members.select("key", "id", F.col("id").alias("component"))
    return members.join(labels, members.id == labels.node, "left").select("key", "id", F.coalesce("component", "id").alias("component"))


def _tops(at: DataFrame, salt: int) -> DataFrame:
    """(key, top: the largest component, hub: one of its rows, c: rows, o: rows outside it) of buckets with several components."""
    per = at.groupBy("key", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "key", F.lit(salt)).alias("h"), "id")).alias("hub"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "component", "hub")).alias("m"), F.sum("n").alias("c"), F.count("*").alias("parts")).filter("parts > 1")
    return per.select("key", F.col("m.component").alias("top"), F.col("m.hub.id").alias("hub"), "c", (F.col("c") - F.col("m.n")).alias("o"))


def _blocks(rows: DataFrame, left: Column, left_size: str = "o", size: str = "c") -> DataFrame:
    """Rows (key, id, o, c, ...) dealt into squares (key, i, j) of BLOCK by BLOCK: ``left`` rows against all rows of a bucket.

    A square's rows lie together in a partition, those of the left side first. ``left_size`` and ``size``: how many
    rows, or blocks of BLOCK rows' worth, the left side and the whole bucket have."""
    rows = rows.withColumns({"oi": F.expr(f"cast(ceil({left_size} / {BLOCK}) as int)"), "gj": F.expr(f"cast(ceil({size} / {BLOCK}) as int)"), "h": F.xxhash64("id")})
    one = rows.filter(left).withColumns({"right": F.lit(False), "i": F.expr("cast(pmod(h, oi) as int)"), "j": F.explode(F.sequence(F.lit(0), F.col("gj") - 1))})
    two = rows.withColumns({"right": F.lit(True), "i": F.explode(F.sequence(F.lit(0), F.col("oi") - 1)), "j": F.expr("cast(pmod(h, gj) as int)")})
    return one.unionByName(two).drop("oi", "gj", "h", "o", "c", "o_size", "c_size").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "right")


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole squares, from batches that are sorted by (key, i, j) in their first three columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy() for k in range(3)])
        other = np.flatnonzero((at != at[:, -1:]).any(axis=0))
        keep = int(other[-1]) + 1 if len(other) else 0  # the last square may go on in the next batch
        if keep or (held and any(held[-1].column(k)[0].as_py() != at[k, 0] for k in range(3))):
            yield pa.Table.from_batches([*held, batch.slice(0, keep)] if keep else held)
            held = []
        held.append(batch.slice(keep))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(table: pa.Table, least: float, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the left and of the right side that lie in one square and in different components, with their estimate if it is high enough."""
    key, i, j, right, component = (table.column(k).to_numpy() for k in (0, 1, 2, 3, 5))
    sig = np.frombuffer(table.column(6).combine_chunks().flatten().to_numpy(), np.int64).view(U64).reshape(-1, 8)
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    size = np.diff(np.append(new, len(key)))
    n_right = np.add.reduceat(right.astype(np.int64), new)
    n_left = size - n_right
    # every left row stands for one stretch of pairs with all right rows of its square
    rows = np.repeat(new, n_left) + _steps(n_left)
    width, first = np.repeat(n_right, n_left), np.repeat(new + n_left, n_left)
    ends = np.cumsum(width)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        w = width[lo:hi]
        x, y = np.repeat(rows[lo:hi], w), np.repeat(first[lo:hi], w) + _steps(w)
        lo = hi
        differ = np.zeros(len(x), np.int64)
        for k in range(8):
            z = sig[x, k] ^ sig[y, k]
            z |= z >> U64(1)
            z |= z >> U64(2)
            differ += np.bitwise_count(z & U64(0x1111111111111111))
        chance = 2.0**-BITS
        found = ((1 - differ / MINIMA) - chance) / (1 - chance)
        good = (found >= least) & (component[x] != component[y])
        yield x[good], y[good], found[good]


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _best(rows: DataFrame, least: float) -> DataFrame:
    """(key, id, other, more): for each left row of each square its best candidate, and whether there are others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _squares(batches):
            key, ids = table.column(0).to_numpy(), table.column(4).to_numpy()
            for x, y, found in _candidates(table, least):
                order = np.lexsort((ids[y], -found, x))
                x, y = x[order], y[order]
                head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
                more = np.diff(np.append(head, len(x))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(key[x[head]]), pa.array(ids[x[head]]), pa.array(ids[y[head]]), pa.array(more)], names=["key", "id", "other", "more"])

    return rows.select("key", "i", "j", "right", "id", "component", "sig").mapInArrow(work, "key long, id long, other long, more boolean")


def _exact(rows: DataFrame, least: float, percent: int) -> DataFrame:
    """(a, b): links of the squares, confirmed on the full sets where they lie; one for each two components of a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _squares(batches):
            ids, component = table.column(4).to_numpy(), table.column(5).to_numpy()
            lists = table.column(7).combine_chunks()
            ends = lists.offsets.to_numpy()
            items = lists.values.to_numpy().view(U64)
            seen: set[tuple[int, int]] = set()
            links = []
            for x, y, _ in _candidates(table, least):
                for row in np.unique(x):
                    own, others = items[ends[row] : ends[row + 1]], y[x == row]
                    parts = [items[ends[o] : ends[o + 1]] for o in others]
                    sizes = np.array(list(map(len, parts)))
                    flat = np.concatenate(parts)
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                    for o in others[100 * common >= percent * (len(own) + sizes - common)].tolist():
                        pair = (min(component[row], component[o]), max(component[row], component[o]))
                        if pair not in seen:
                            seen.add(pair)
                            links.append((min(ids[row], ids[o]), max(ids[row], ids[o])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return rows.select("key", "i", "j", "right", "id", "component", "sig", "items").mapInArrow(work, "a long, b long").distinct()


def find_links(members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all texts which any chain of links connects.

    1. HUBS times, each bucket's rows outside its largest component are compared with one row of that component.
    2. Each row that still stands outside is estimated against all rows of its bucket, in squares of signatures;
       its best candidate of each square is confirmed.
    3. Rows that have more candidates and still stand outside are confirmed against all of them, inside the
       tasks that hold the squares: pairs are never rows of a table."""
    least = percent / 100 - SLACK
    links, labels, found, sized = None, None, [], sigs
    sigs = sized.drop("n")

    def join(more: DataFrame) -> None:
        nonlocal links, labels
        found.append(more)
        links = more if links is None else links.unionByName(more)
        if labels is not None:
            drop_cut(labels)
        labels = components(links)

    for k in range(HUBS):
        at = _located(members, labels)
        pairs = at.join(_tops(at, k).hint("merge"), "key").filter("component <> top").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        pairs = pairs.join(sigs.withColumnsRenamed({"id": "b", "sig": "sb"}), "b").join(sigs.withColumnsRenamed({"id": "a", "sig": "sa"}).hint("merge"), "a")
        join(_confirm(pairs.filter(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b"), sets, percent))
    at = cut(_located(members, labels), "minhash-at")
    tops = cut(_tops(at, HUBS).drop("hub"), "minhash-tops")
    rows = at.join(tops.hint("merge"), "key").join(sigs, "id")
    best = cut(_best(_blocks(rows, F.col("component") != F.col("top")), least), "minhash-best")
    join(_confirm(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), sets, percent))
    # what was the largest component stays the one that others are held against
    after = _located(members, labels).join(tops.select("key", "top").hint("merge"), "key")
    named = labels.withColumnsRenamed({"node": "top", "component": "top_now"})
    after = after.join(named.hint("merge"), "top", "left").withColumn("top", F.coalesce("top_now", "top")).drop("top_now")
    open_rows = best.filter("more").select("key", "id").distinct().withColumn("open", F.lit(True))
    after = after.join(open_rows, ["key", "id"], "left").withColumn("left", F.coalesce("open", F.lit(False)) & (F.col("component") != F.col("top")))
    after = cut(after.select("key", "id", "component", "left"), "minhash-after")
    # a text counts as a row for each ITEMS shingles, so that the sets of a square fit its task however long texts are
    weighed = after.join(sized, "id").withColumn("w", F.expr(f"1 + n div {ITEMS}"))
    counts = weighed.groupBy("key").agg(F.sum("w").alias("c_size"), F.sum(F.when(F.col("left"), F.col("w")).otherwise(0)).alias("o_size")).filter("o_size > 0")
    rows = weighed.drop("n", "w").join(counts.hint("merge"), "key").join(sets.hint("merge"), "id")
    found.append(cut(_exact(_blocks(rows, F.col("left"), "o_size", "c_size"), least, percent), "minhash-links"))
    for x in (at, tops, best, after, labels):
        drop_cut(x)
    return links.unionByName(found[-1])


def _numbered(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(key, id, text, ...) as a table: keys number the rows, so rows of equal ids stay apart and no join multiplies them."""
    ident = F.col(id_col).cast("long") if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int") else F.col(id_col)
    return cut(df.select(F.monotonically_increasing_id().alias("key"), ident.alias("id"), F.col(text_col).cast("string").alias("text"), *more), "minhash-rows")


def _classes(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, text, linked): (key, n) of all of them, and (node, component) of those that are linked with another."""
    base = cut(sketch(rows), "minhash-base")
    full = base.filter("n > 0 and linked")
    same = ["n", "set_a", "set_b"]
    reps = full.groupBy(same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = full.select("id", *same).join(reps.filter("copies > 1").hint("merge"), same).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    sigs = cut(full.join(reps.select(F.col("rep").alias("id"), *same), ["id", *same], "left_semi").select("id", "n", "sig", "bands"), "minhash-reps")
    keys = sigs.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("key")
    members = cut(keys.join(shared.hint("merge"), "key"), "minhash-members")
    ids = members.select("id").distinct()
    sets = cut(_sets(rows.select(F.col("key").alias("id"), "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "id", "left_semi")), "minhash-sets")
    links = find_links(members, sigs.select("id", "n", "sig"), sets, percent)
    final = components(links.unionByName(copies))
    for x in (members, sigs, sets):
        drop_cut(x)
    return base.select(F.col("id").alias("key"), "n"), final


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: classes of texts linked by similarity >= percent / 100."""
    rows = _numbered(df, id_col, text_col)
    sizes, final = _classes(rows.withColumn("linked", F.col("id").isNotNull()), percent)
    ids = rows.select("key", "id")
    # a class is named by the smallest id in it
    linked = final.join(ids.hint("merge"), F.col("node") == F.col("key")).select("key", "component", "id")
    names = linked.groupBy("component").agg(F.min("id").alias("name"))
    named = linked.select("key", "component").join(names.hint("merge"), "component").select("key", "name")
    own = F.coalesce("name", "id")
    out = ids.join(sizes, "key").join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``df`` that stay: of each class the row of the smallest id (of equal ids, the first row). Null ids
    come after all others; of rows of equal id without any word, which are linked with nothing, one stays too."""
    rows = _numbered(df, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    sizes, final = _classes(rows.withColumn("linked", F.lit(True)), percent)
    ids = rows.select("key", "id")
    inside = final.join(ids.hint("merge"), F.col("node") == F.col("key")).select("key", "component", F.struct(F.col("id").isNull(), "id", "key").alias("order"))
    best = inside.groupBy("component").agg(F.min("order").alias("best"))
    gone = inside.join(best.hint("merge"), "component").filter("key <> best.key").select("key")
    blank = rows.select("key", "id", "text").join(sizes.filter("n = 0").select("key"), "key")
    first = blank.groupBy("id", "text").agg(F.min("key").alias("first"), F.count("*").alias("c")).filter("c > 1")
    again = blank.join(first.hint("merge"), blank["id"].eqNullSafe(first["id"]) & blank["text"].eqNullSafe(first["text"])).filter("key <> first").select("key")
    gone = cut(gone.unionByName(again), "minhash-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    return rows.join(gone, "key", "left_anti").select("row.*")


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
