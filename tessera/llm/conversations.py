"""Conversation structure repair by signature deduplication.

Every row of a conversation becomes one letter: the initial of its role and its fault. The letters in order are the
conversation's signature, and few signatures are different: each is solved once, by a recursion that is memoised on what
is left of a signature, so that signatures share the solutions of their common endings. The cheapest edits (the audit)
are joined back to all conversations of a signature and replayed on their rows.

Edits: Keep (0), Rerole to user or assistant (3), Delete (4; the only way for blank and duplicate rows), Insert an empty
turn of user or assistant (3); a truncated row that stays costs 3 more. The roles that are left must read
``(s?(ua)+)?``; of equally cheap audits the one first in ASCII order counts. Two inserts side by side are never cheapest:
after them the roles that may follow are those that could follow before, and a system turn that stands alone is deleted
for less. So the rows' letters and the state decide which role an R or an I gives.

Texts and roles aren't gathered by conversation: a row meets its part of the audit by conversation and block of BLOCK
rows, and digests read the repaired rows as a sorted stream. What a task holds of one conversation is a letter or two per
row; the numbering and the digest of one conversation are sequential by definition and run as streams over it.

Defined cases: a null role or text is one space (a blank row, or a role that no pattern has); null turns come first and
are left out of gaps; rows of one turn are ordered by role and text, so repeated rows are next to each other and are
duplicates; a null conversation id is a conversation of its own; empty texts are blank; very long texts are one row's
value and never copied into signatures; extra columns, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import cut

SPACE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 256
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEEDS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_AFTER = {"u": USER, "a": ASSISTANT}


def rows_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, key, turn, role, text): the columns of interest, nulls as one space; ``key`` stands for the conversation, null or not."""
    ident = F.col(conv)
    return df.select(ident.alias("conv_id"), F.when(ident.isNull(), "").otherwise(F.concat(F.lit("="), ident.cast("string"))).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """The rows with the faults that a checksum of conversation and turn deals to them: dropped, emptied, without sentence
    ends, repeated, or said by the user."""
    of = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("kind")
    hit = rows.withColumn("kind", F.crc32(of.cast("binary")) % 20).filter("kind <> 0")
    hit = hit.withColumns({"text": F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(kind == 4, "user").otherwise(F.col("role"))})
    return hit.withColumn("again", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "again")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``at`` (their place in the conversation, from 0), ``fault`` (blank, duplicate, truncated or null) and ``letter``."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    blank = bare == ""
    # fingerprints stand for texts here, so that long ones aren't sorted by
    print_of = [F.length("text"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    again = F.row_number().over(Window.partitionBy("key", "role", *print_of, blank).orderBy(F.col("turn").asc_nulls_first())) > 1
    marked = rows.withColumn("fault", F.when(blank, "blank").when(again, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated"))
    # of equal rows, the first one isn't a duplicate
    placed = marked.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(*order, F.coalesce(F.col("fault") == "duplicate", F.lit(False)))) - 1)
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return placed.withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known))


def signatures(marked: DataFrame) -> DataFrame:
    """(key, conv_id, signature, gaps, blank, duplicate, truncated, illegal) of each conversation."""
    pair = F.concat(F.lag(F.left("role", F.lit(1))).over(Window.partitionBy("key").orderBy("at")), F.left("role", F.lit(1)))
    rows = marked.withColumn("odd", ~F.coalesce(pair.isin("su", "ua", "au"), F.lit(True)))
    count = lambda what: F.count_if(what).alias
    blocks = rows.groupBy("key", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.any_value("conv_id").alias("conv_id"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("letters"),
        *[count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")], count(F.col("odd"))("illegal"), F.min("turn").alias("lo"), F.max("turn").alias("hi"),
    )
    turns = marked.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("turn").alias("turns"))
    whole = blocks.groupBy("key").agg(
        F.any_value("conv_id").alias("conv_id"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "").alias("signature"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    return whole.join(turns, "key").withColumn("gaps", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0).cast("long"))).drop("lo", "hi", "turns")


@functools.lru_cache(maxsize=1 << 18)
def _best(letters: str, state: int) -> tuple[tuple, ...]:
    """The cheapest ways (cost, audit, end state) through ``letters`` from ``state`` to each state that can be reached."""
    if not letters:
        return ((0, "", state),)
    letter, rest = letters[0], letters[1:]
    found: dict[int, tuple] = {}
    for at, before, paid in ((state, "", 0), (_AFTER[_NEEDS[state]], "I", INSERT)):
        steps = [("D", DELETE, at)]
        if letter != "x":
            extra, role = (TRUNCATED if letter.isupper() else 0), letter.lower()
            if role == "s" and at == START:
                steps.append(("K", extra, SYSTEM))
            elif role == _NEEDS[at]:
                steps.append(("K", extra, _AFTER[role]))
            steps.append(("R", REROLE + extra, _AFTER[_NEEDS[at]]))
        for edit, cost, to in steps:
            for more, audit, end in _best(rest, to):
                way = (paid + cost + more, before + edit + audit, end)
                if end not in found or way < found[end]:
                    found[end] = way
    return tuple(found.values())


def solve(signature: str, block: int = 64) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, ties by ASCII order.

    Long signatures are solved block by block: costs to the end are carried backwards, then the audit is read off
    forwards. An insert stands before the row that follows, so audits of a block that end in different states differ
    in a letter, and the choice within a block decides between equal costs."""
    parts = [signature[k : k + block] for k in range(0, len(signature), block)]
    tail = {START: 0, ASSISTANT: 0, USER: INSERT}
    last = {USER: "I"}
    to_go = [tail]
    for part in reversed(parts):
        after = to_go[-1]
        to_go.append({s: min(c + after[e] for c, _, e in ways) for s in range(4) if (ways := [w for w in _best(part, s) if w[2] in after])})
    to_go.reverse()
    state, audit = START, []
    for part, after in zip(parts, to_go[1:], strict=True):
        ways = [(c + after[e], a, e) for c, a, e in _best(part, state) if e in after]
        _, edits, state = min(ways, key=lambda w: (w[0], w[1] + (last.get(w[2], "") if part is parts[-1] else "")))
        audit.append(edits)
    return to_go[0][START], "".join(audit) + last.get(state, "")


def script(signature: str, audit: str) -> str:
    """Two letters per row and two at the end: who is inserted before it (u, a, -), and what becomes of it (K, D, u, a)."""
    out, state, before, k = [], START, "-", 0
    for edit in audit:
        if edit == "I":
            before = _NEEDS[state]
            state = _AFTER[before]
            continue
        if edit == "K":
            role, done = signature[k].lower(), "K"
            state = SYSTEM if role == "s" else _AFTER[role]
        elif edit == "R":
            done = _NEEDS[state]
            state = _AFTER[done]
        else:
            done = "D"
        out.append(before + done)
        before, k = "-", k + 1
    return "".join(out) + before + "-"


def audits(found: DataFrame) -> DataFrame:
    """``found`` with cost, audit and script of each signature; every distinct signature is solved once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            solved = [solve(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in solved], pa.int64()), pa.array([x[1] for x in solved]), pa.array([script(x, y[1]) for x, y in zip(texts, solved, strict=True)])], names=["signature", "cost", "audit", "script"])

    solved = found.select("signature").distinct().mapInArrow(work, "signature string, cost long, audit string, script string")
    return found.join(solved, "signature")


def replay(marked: DataFrame, solved: DataFrame) -> DataFrame:
    """(key, conv_id, at, step, role, text): the repaired rows, in the order of (at, step)."""
    block = F.floor(F.col("at") / BLOCK)
    n = F.floor(F.length("script") / 2)  # one step more than rows
    parts = solved.select("key", "conv_id", "script", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).alias("block"), (n - 1).alias("end"))
    parts = parts.select("key", "conv_id", "block", "end", F.substring("script", F.col("block") * (2 * BLOCK) + 1, F.lit(2 * BLOCK)).alias("part"))
    on = (F.col("at") % BLOCK).cast("int")
    joined = marked.select("key", block.cast("int").alias("block"), "at", "role", "text").join(parts.select("key", "conv_id", "block", "part"), ["key", "block"])
    before, done = F.substring("part", 2 * on + 1, F.lit(1)), F.substring("part", 2 * on + 2, F.lit(1))
    name = lambda c: F.when(c == "u", "user").when(c == "a", "assistant")
    turn = lambda step, role, text: F.struct(F.lit(step).alias("step"), role.alias("role"), text.alias("text"))
    inserted = F.when(before != "-", turn(0, name(before), F.lit("")))
    kept = F.when(done != "D", turn(1, F.coalesce(name(done), F.col("role")), F.col("text")))
    made = joined.select("key", "conv_id", "at", F.inline(F.filter(F.array(inserted, kept), lambda x: x.isNotNull())))
    closing = F.substring("script", -2, 1)
    ends = solved.filter(closing != "-").select("key", "conv_id", (n - 1).cast("int").alias("at"), F.lit(0).alias("step"), name(closing).alias("role"), F.lit("").alias("text"))
    return made.unionByName(ends)


def digests(repaired: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of ``role:text`` lines, read as a sorted stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def out(keys: list, values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "repaired_sha256"])

        for batch in batches:
            keys, values = [], []
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != at:
                    if digest:
                        keys.append(at)
                        values.append(digest.hexdigest())
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield out(keys, values)
        if digest:
            yield out([at], [digest.hexdigest()])

    return repaired.repartition("key").sortWithinPartitions("key", "at", "step").select("key", "role", "text").mapInArrow(work, "key string, repaired_sha256 string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns (conv_id, position, role, text) of the conversations as they are."""
    marked = cut(faults(rows_of(df, conv, turn, role, text)), "conv-rows")
    done = replay(marked, audits(signatures(marked)))
    return done.select(F.col("conv_id").alias(conv), F.row_number().over(Window.partitionBy("key").orderBy("at", "step")).alias("position"), F.col("role").alias(role), F.col("text").alias(text))


def report(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Faults, audit and digest for every conversation of ``named`` (key, conv_id), of ``rows`` as they are."""
    marked = cut(faults(rows), "conv-rows")
    solved = cut(audits(signatures(marked)), "conv-audits")
    found = solved.select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").join(digests(replay(marked, solved)), "key", "left")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = named.join(found, "key", "left")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    rows = rows_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return report(damage(rows), rows.groupBy("key").agg(F.any_value("conv_id").alias("conv_id")))
