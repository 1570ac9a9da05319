"""Repeated passages by prefix doubling of the suffix array, on positions thinned by minimisers.

A byte is removed if a string of ``length`` (200) bytes that covers it starts anywhere else in the corpus. Positions
are ranked by their prefixes: the rank of a prefix of 2h bytes is the pair of the ranks of h bytes at p and at p + h.
Only whether ranks are equal matters here, so a rank is a 64-bit name that is made anew from the pair, and a pair is
128 bits. Spark groups the pairs at offsets 25, 50 and 100; positions whose pair is unique are past any repeat and
leave, the others are ranked again at the doubled offset, until strings of ``length`` bytes have been compared.

The rounds before the last don't need a row for each byte. A start can repeat only if every shorter string inside its
``length`` bytes does, so one stands for it: the one with the smallest name (a minimiser), which depends on those
bytes alone and is therefore the same at each repeat. Neighbouring starts with one minimiser form a run, and a run is
a row; a name that stands twice inside a run (periodic text) counts twice. In the last round

1. runs that are equal as a whole, with all bytes that their starts reach, repeat in all their starts;
2. of the other runs, and of one run for each group of equal ones, every block of up to WIDTH starts is a row with the
   pair of ranks of the bytes that they share; only where such a pair has blocks that differ, every start is a row.

After the first round only the bytes that surviving starts reach travel on. A group of any size meets as counts;
joins back to the rows are sort-merge joins, which adaptive execution splits if one pair is frequent. Tasks work
through texts in pieces of ``PIECE`` starts, whatever the size of a text or a run.

Defined cases: null counts as an empty text; texts shorter than ``length`` lose nothing; repeated rows are documents of
their own, so both copies are removed, and ties don't exist, since no copy is preferred; null ids are kept; extra
columns are carried along, but for those that are added; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rolling import U64, buffers, grams, mix64, prefix, sliding_min, spans
from .shared import cut, drop_cut

PIECE = 1 << 16  # arrays of a piece fit the cache of a core
BITS = 63  # starts of one mask
WIDTH = 8  # starts of one block: what they reach beyond each other fits a long


def _batches(batch: pa.RecordBatch, column: int | str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each."""
    sizes = np.fromiter((x.as_buffer().size if x.is_valid else 0 for x in batch.column(column)), np.int64, batch.num_rows)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column as one array, and where each value ends."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, np.uint8)), ends[1:] - ends[0]


def _doubled(rank: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of twice the length (less, if the halves overlap), made from the pairs of ranks at ``offset``."""
    if len(rank) <= offset:
        return np.empty(0, U64)
    pair = rank[:-offset] * U64(0xD6E8FEB86659FD93)
    pair += rank[offset:]
    return mix64(pair)


def _ranks(pre: np.ndarray, base: int, offset: int) -> np.ndarray:
    """Ranks of all prefixes of ``offset`` bytes: those of ``base`` bytes are hashes, the others are doubled."""
    rank, h = grams(pre, base), base
    while h < offset:
        rank, h = _doubled(rank, h), 2 * h
    return rank


def _highest_around(low: np.ndarray, w: int) -> np.ndarray:
    """For each place the highest minimum of the windows of ``w`` places that hold it."""
    edge = np.zeros(w - 1, U64)
    return sliding_min(np.concatenate([edge, low, edge]), w, np.maximum)


def _schedule(length: int) -> tuple[int, list[int]]:
    """Bytes that are hashed at first, and the offsets of the rounds: each doubles the last, up to half the length."""
    base = -(-length // 8)
    return base, [base, 2 * base, length - 4 * base]


def _runs(rows: DataFrame, length: int, offset: int, counted: bool = False) -> DataFrame:
    """Runs of starts with one minimiser of 2 * ``offset`` bytes, of rows (key, at, reach): first start, number of
    more starts, the pair of ranks (r1, r2), and a name of all bytes that the starts reach. If ``counted``, only the pair
    and how often it counts here."""
    base = _schedule(length)[0]
    window = length - 2 * offset + 1

    def piece(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        pre = prefix(data)
        half = _ranks(pre, base, offset)
        each = _doubled(half, offset)
        low = np.where(valid, sliding_min(each, window), U64(0))
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.append(first[1:], len(low)) - 1
        real = valid[first]
        first, last = first[real], last[real]
        # minima stand where a value is as high as the highest minimum around it
        places = np.flatnonzero(each == _highest_around(low, window))
        places = places[np.argsort(each[places], kind="stable")]
        left, right = (np.searchsorted(each[places], low[first], side) for side in ("left", "right"))
        return first, last - first, half[places[left]], half[places[left] + offset], np.minimum(right - left, 2) if counted else spans(pre, first, last + length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, "reach"):
                data, ends = _joined(part.column("reach"))
                base_at = None if counted else part.column("at").to_numpy() - (ends - np.diff(ends, prepend=0))
                for lo in range(0, len(data) - length + 1, PIECE):
                    some = data[lo : lo + PIECE + length - 1]
                    start = np.arange(lo, lo + len(some) - length + 1)
                    one, two = np.searchsorted(ends, start[[0, -1]], "right")
                    text = np.repeat(np.arange(one, two + 1), np.diff(np.minimum(ends[one : two + 1], start[-1] + 1), prepend=lo))
                    first, more, r1, r2, last = piece(some, ends[text] - start >= length)
                    pair = [pa.array(x.view(np.int64)) for x in (r1, r2)]
                    if counted:
                        yield pa.RecordBatch.from_arrays([*pair, pa.array(last.astype(np.int32))], names=["r1", "r2", "n"])
                        continue
                    k = text[first]
                    cols = [part.column("key").take(pa.array(k)), part.column("at").take(pa.array(k)), pa.array(first + lo + base_at[k]), pa.array(more.astype(np.int32)), *pair, pa.array(last.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "at", "first", "more", "r1", "r2", "whole"])

    if counted:
        return rows.select("reach").mapInArrow(work, "r1 long, r2 long, n int")
    return rows.select("key", "at", "reach").mapInArrow(work, "key binary, at long, first long, more int, r1 long, r2 long, whole long")


def _not_unique(rows: DataFrame, length: int, offset: int) -> DataFrame:
    """The runs whose pair of ranks occurs again. What counts them reads and gives no more than it needs."""
    again = _runs(rows, length, offset, counted=True).groupBy("r1", "r2").agg(F.sum("n").alias("n")).filter("n > 1").select("r1", "r2")
    return _runs(rows, length, offset).join(again.hint("merge"), ["r1", "r2"])


def _survivors(rows: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Rows (key, at, reach) with the bytes that the starts of ``runs`` reach; neighbouring runs become one row."""
    found = runs.groupBy("key", "at").agg(F.collect_list(F.struct(F.col("first").alias("lo"), (F.col("first") + F.col("more") + 1).alias("hi"))).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, 2):
                at, which, first, reach = part.column(1).to_pylist(), [], [], []
                for k, (data, hits) in enumerate(zip(buffers(part.column(2)), part.column(3))):
                    for lo, hi in zip(*(x.tolist() for x in _merge(hits))):
                        which.append(k)
                        first.append(lo)
                        reach.append(data[lo - at[k] : hi - at[k] + length - 1].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), pa.array(first, pa.int64()), pa.array(reach, pa.binary())], names=["key", "at", "reach"])

    return rows.join(found.hint("shuffle_hash"), ["key", "at"]).select("key", "at", "reach", "spans").mapInArrow(work, "key binary, at long, reach binary")


def _starts(asked: DataFrame, length: int, counted: bool = False, width: int = 1) -> DataFrame:
    """A row per block of starts of the listed runs of rows (key, at, reach, runs): if ``counted``, of all runs, with
    whether it is asked about, else of those that are, with the place of its first start.

    A start's distance to the minimiser of its own string depends on that string alone. Neighbouring starts whose
    distances have one quotient by ``width`` are a block; a distance's remainder says where in the block a start is.
    (r1, r2) are the ranks of the bytes that any start of the block would reach. ``left`` and ``right`` have the bytes
    before and behind these that its own starts reach, the nearest lowest, and in the top byte how many they are."""
    base, offsets = _schedule(length)
    place = U64((1 << 32) - 1)

    def blocks(data: np.ndarray, start: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
        half = _ranks(prefix(data), base, 4 * base)
        # the leftmost of the smallest names, by their upper bits
        nearest = (sliding_min(half & ~place | np.arange(len(half), dtype=U64), offsets[-1] + 1)[start] & place).astype(np.int64)
        end = nearest - (nearest - start) // width * width  # the last start that the block can have
        first = np.flatnonzero(np.concatenate([[True], (end[1:] != end[:-1]) | (run[1:] != run[:-1])]))
        last, end = np.append(first[1:], len(start)) - 1, end[first]
        before, behind = end - start[first], start[last] - end + width - 1
        left, right = before << 56, behind << 56
        for k in range(width - 1):
            left |= np.where(k < before, data[np.maximum(end - 1 - k, 0)].astype(np.int64) << 8 * k, 0)
            right |= np.where(k < behind, data[np.minimum(end - width + 1 + length + k, len(data) - 1)].astype(np.int64) << 8 * k, 0)
        return first, half[end].view(np.int64), half[end + offsets[-1] - width + 1].view(np.int64), left, right

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, "reach"):
                data, ends = _joined(part.column("reach"))
                runs, moved = part.column("runs"), part.column("at").to_numpy() - (ends - np.diff(ends, prepend=0))
                text, runs = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy())), runs.flatten()
                first, more = (runs.field(x).to_numpy(zero_copy_only=False) for x in ("first", "more"))
                asks = np.asarray(runs.field("asks").to_numpy(zero_copy_only=False), bool)
                first = first - moved[text]
                # runs that are listed, in groups of about PIECE bytes from the first to the last
                order = np.argsort(first, kind="stable")
                order = order if counted else order[asks[order]]
                text, first, more, asks = text[order], first[order], more[order].astype(np.int64), asks[order]
                lo = 0
                while lo < len(first):
                    hi = max(lo + 1, int(np.searchsorted(first, first[lo] + PIECE)))
                    begin, n = int(first[lo]), more[lo:hi] + 1
                    run = np.repeat(np.arange(lo, hi), n)
                    start = np.repeat(first[lo:hi] - begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    head, *cols = blocks(data[begin : int(first[hi - 1] + more[hi - 1]) + length], start, run)
                    cols, of = [pa.array(x) for x in cols], text[run[head]]
                    if counted:
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(asks[run[head]])], names=["r1", "r2", "left", "right", "asks"])
                    else:
                        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(of)), pa.array(start[head] + begin + moved[of]), *cols], names=["key", "start", "r1", "r2", "left", "right"])
                    lo = hi

    if counted:
        return asked.select("at", "reach", "runs").mapInArrow(_grouped(work), "r1 long, r2 long, left long, right long, asks boolean")
    return asked.select("key", "at", "reach", "runs").mapInArrow(_grouped(work), "key binary, start long, r1 long, r2 long, left long, right long")


def _repeated_starts(asked: DataFrame, length: int) -> DataFrame:
    """(key, block, bits) of the starts that are asked about and repeat. Blocks that share no bytes with another don't;
    blocks whose bytes are all equal do, in all starts; only of the others every start is a row."""
    width = min(WIDTH, _schedule(length)[1][-1] + 1)
    pair = ["r1", "r2"]
    blocks = cut(_starts(asked, length, counted=True, width=width), "suffix-blocks")
    again = blocks.groupBy(pair).agg(F.count("*").alias("c"), F.max("asks").alias("asks"), *[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("left", "right")])
    again = cut(again.filter("c > 1 and asks").select(*pair, F.expr("min_left = max_left and min_right = max_right").alias("alike")), "suffix-again")
    found = cut(_starts(asked, length, width=width).join(again.hint("merge"), pair), "suffix-found")
    # a start is named by its place in the block and by what it reaches beyond the bytes of all
    each = F.explode(F.sequence(F.lit(width - 1) - F.shiftright("right", 56), F.shiftright("left", 56)))
    own = {"l": F.expr("left & (shiftleft(1L, cast(8 * i as int)) - 1) | shiftleft(i, 56)"), "r": F.expr(f"right & (shiftleft(1L, cast(8 * ({width - 1} - i) as int)) - 1)")}
    partners = blocks.join(again.filter("not alike").select(pair).hint("merge"), pair).withColumn("i", each).withColumns(own)
    twice = partners.groupBy(*pair, "l", "r").agg(F.count("*").alias("c")).filter("c > 1").select(*pair, "l", "r")
    single = found.filter("not alike").withColumn("i", each).withColumns(own).join(twice.hint("merge"), [*pair, "l", "r"])
    single = single.select("key", F.expr("start + shiftright(left, 56) - i").alias("start"), F.lit(1).cast("long").alias("n"))
    whole = found.filter("alike").select("key", "start", F.expr(f"shiftright(left, 56) + shiftright(right, 56) - {width - 2}").alias("n"))
    # n bits from ``start`` on, which can go on in the next mask
    bits = whole.unionByName(single).withColumns({"q": F.expr(f"cast(start % {BITS} as int)"), "ones": F.expr("shiftleft(1L, cast(n as int)) - 1")})
    parts = F.array(F.struct(F.expr(f"start div {BITS}").alias("block"), F.expr(f"shiftleft(ones, q) & {(1 << BITS) - 1}L").alias("bits")), F.struct(F.expr(f"start div {BITS} + 1").alias("block"), F.expr(f"shiftright(ones, {BITS} - q)").alias("bits")))
    masks = bits.select("key", F.inline(parts)).filter("bits <> 0").groupBy("key", "block").agg(F.bit_or("bits").alias("bits"))
    masks = cut(masks, "suffix-single")  # its shuffle files go before those of the equal runs come
    for x in (blocks, again, found):
        drop_cut(x)
    return masks


def _grouped(work, rows: int = 50_000):
    """``work`` with its small batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in work(batches):
            held.append(x)
            n += x.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``key__`` (128 bits, equal for rows of equal id and text) and ``text__``."""
    ident, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    whole = F.concat_ws("/", ident.isNull().cast("string"), text.isNull().cast("string"), F.length(ident).cast("string"), ident, text)
    return df.withColumns({"key__": F.unhex(F.md5(whole.cast("binary"))), "text__": F.coalesce(text, F.lit(""))})


def repeated_runs(rows: DataFrame, length: int = 200) -> DataFrame:
    """(key, spans, masks) of the repeated bytes of rows (key, text): spans [lo, hi), and bits of single starts."""
    base, offsets = _schedule(length)
    state = rows.select("key", F.lit(0).cast("long").alias("at"), F.col("text").cast("binary").alias("reach"))
    old = None
    for k, offset in enumerate(offsets[:-1]):
        runs = _not_unique(state, length, offset)
        if k < len(offsets) - 2:
            new = cut(_survivors(state, runs.select("key", "at", "first", "more"), length), f"suffix-{2 * offset}")
            if old is not None:
                drop_cut(old)
            state = old = new
    left = cut(runs, "suffix-runs")
    same = ["r1", "r2", "whole", "more"]
    groups = cut(left.groupBy(same).agg(F.count("*").alias("c"), F.min(F.struct("key", "at", "first")).alias("one")), "suffix-groups")
    equal = left.join(groups.filter("c > 1").select(same).hint("merge"), same).select("key", F.col("first").alias("lo"), (F.col("first") + F.col("more") + length).alias("hi"))
    # runs of one pair that are all equal are done; a single run is asked about, and so are periodic ones
    open_pairs = groups.groupBy("r1", "r2").agg(F.max(F.col("c") == 1).alias("open")).filter("open").select("r1", "r2")
    todo = groups.join(open_pairs.hint("merge"), ["r1", "r2"]).select("one.key", "one.at", F.struct("one.first", "more", (F.col("c") == 1).alias("asks")).alias("run"))
    todo = todo.groupBy("key", "at").agg(F.collect_list("run").alias("runs"))
    asked = cut(state.join(todo.hint("shuffle_hash"), ["key", "at"]).select("key", "at", "reach", "runs"), "suffix-asked")
    drop_cut(old)
    single = _repeated_starts(asked, length)
    drop_cut(asked)
    spans_ = equal.select("key", F.struct("lo", "hi").alias("span"), F.lit(None).cast("struct<block:long,bits:long>").alias("mask"))
    masks = single.select("key", F.lit(None).cast("struct<lo:long,hi:long>").alias("span"), F.struct("block", "bits").alias("mask"))
    found = cut(spans_.unionByName(masks).groupBy("key").agg(F.collect_list("span").alias("spans"), F.collect_list("mask").alias("masks")), "suffix-spans")
    for x in (left, groups, single):
        drop_cut(x)
    return found


def _unmasked(found: pa.Scalar, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings whose starts are set in masks, as spans."""
    if not found.is_valid or not len(found.values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    block, bits = (found.values.field(x).to_numpy(zero_copy_only=False) for x in ("block", "bits"))
    row, bit = np.nonzero((bits[:, None] >> np.arange(BITS)) & 1)
    lo = block[row] * BITS + bit
    return lo, lo + length


def _merge(found: pa.Scalar, *more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint and maximal spans."""
    parts = list(more)
    if found.is_valid and len(found.values):
        parts.append(tuple(found.values.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi")))
    lo, hi = (np.concatenate([p[k] for p in parts] or [np.empty(0, np.int64)]) for k in (0, 1))
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def _without(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    keep = np.ones(len(data), bool)
    for a, b in zip(lo.tolist(), hi.tolist()):
        keep[a:b] = False
    return data[keep]


def _whole_characters(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk so that no character loses only some of its bytes."""
    inner = (data & 0xC0) == 0x80
    a, b = lo.copy(), hi.copy()
    for _ in range(3):
        a = np.where((a < hi) & inner[np.minimum(a, len(data) - 1)], a + 1, a)
        b = np.where((b < len(data)) & (b > a) & inner[np.minimum(b, len(data) - 1)], b - 1, b)
    return a, np.maximum(a, b)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, texts: bool = True) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, kept_sha256 and, if ``texts``, kept_text (whole characters)."""
    df = df.drop(*({"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"} - {id_col, text_col}))
    rows = keyed(df, id_col, text_col)
    found = repeated_runs(rows.select(F.col("key__").alias("key"), F.col("text__").alias("text")), length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, batch.num_columns - 3):
                out = []
                for data, hits, bits in zip(buffers(part.column(part.num_columns - 3)), part.column(part.num_columns - 2), part.column(part.num_columns - 1)):
                    lo, hi = _merge(hits, _unmasked(bits, length))
                    kept = _without(data, lo, hi) if len(lo) else data
                    text = (kept if not len(lo) else _without(data, *_whole_characters(data, lo, hi))).tobytes().decode() if texts else None
                    out.append((len(data), len(data) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), text))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                names = part.schema.names[:-3] + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], *cols], names=names)

    carry = [c for c in df.columns if c != text_col] if texts else [id_col]
    found = found.select(F.col("key").alias("key__"), F.col("spans").alias("spans__"), F.col("masks").alias("masks__"))
    joined = rows.join(found.hint("shuffle_hash"), "key__", "left").select(*[F.col(f"`{c}`") for c in carry], "text__", "spans__", "masks__")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-3])
    return joined.mapInArrow(work, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op7_suffix(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept_text")
