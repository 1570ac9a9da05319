"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations
from tessera.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        for _ in range(2 if k == 3 else 1):
            yield conv, turn, "user" if k == 4 else role, text


def fault_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else None if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_audit(roles, faults, most_inserts=1):
    """(cost, audit, kept rows) of all edits with at most so many inserts in a row that give a legal conversation."""
    def go(k, out, audit, cost, inserts):
        if inserts < most_inserts and len(out) <= len(roles) + 2:
            for r in ("user", "assistant"):
                yield from go(k, [*out, (r, None)], audit + "I", cost + 3, inserts + 1)
        if k == len(roles):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "o" for r, _ in out)):
                yield cost, audit, out
            return
        more = 3 if faults[k] == "truncated" else 0
        yield from go(k + 1, out, audit + "D", cost + 4, 0)
        if faults[k] not in ("blank", "duplicate"):
            yield from go(k + 1, [*out, (roles[k], k)], audit + "K", cost + more, 0)
            for r in ("user", "assistant"):
                yield from go(k + 1, [*out, (r, k)], audit + "R", cost + more + 3, 0)

    return min(go(0, [], "", 0, 0), key=lambda w: w[:2])


def brute(rows, search=every_audit):
    by = defaultdict(list)
    for row in damaged(rows):
        by[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        roles, fault = [r[2] for r in own], fault_of(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, kept = search(roles, fault)
        text = "\n".join(f"{r}:{'' if k is None else own[k][3]}" for r, k in kept)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(spark, rows, **extra):
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    base = conversations.rows_of(df)
    found = conversations.report(conversations.damage(base), base.groupBy("key").agg(F.any_value("conv_id").alias("conv_id")))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in found.collect()}


def stepwise(roles, faults):
    """The same by the cheapest ways to each state, for conversations that are too long to try everything."""
    best = {"": (0, "", [])}
    after = {"u": "u", "a": "ua"}
    for k in [*range(len(roles)), None]:
        for s, (cost, audit, kept) in list(best.items()):
            r = "a" if s == "u" else "u"
            to, name = after[r], {"u": "user", "a": "assistant"}[r]
            if k is None and s == "u":
                best["ua"] = min(best.get("ua", (9e9, "")), (cost + 3, audit + "I", [*kept, (name, None)]), key=lambda w: w[:2])
        if k is None:
            break
        new = {}

        def put(s, way, new=new):
            new[s] = min(new.get(s, (9e9, "")), way, key=lambda w: w[:2])

        for s, (cost, audit, kept) in best.items():
            for at, c, a, out in ((s, cost, audit, kept), (after["a" if s == "u" else "u"], cost + 3, audit + "I", [*kept, ("assistant" if s == "u" else "user", None)])):
                put(at, (c + 4, a + "D", out))
                if faults[k] in ("blank", "duplicate"):
                    continue
                c += 3 if faults[k] == "truncated" else 0
                need = "a" if at == "u" else "u"
                if roles[k][:1] == need:
                    put(after[need], (c, a + "K", [*out, (roles[k], k)]))
                elif roles[k][:1] == "s" and at == "":
                    put("s", (c, a + "K", [*out, (roles[k], k)]))
                put(after[need], (c + 3, a + "R", [*out, ("user" if need == "u" else "assistant", k)]))
        best = new
    return min((best[s] for s in ("", "ua") if s in best), key=lambda w: w[:2])


def test_solver_on_every_short_signature():
    roles, faults = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}, {"x": "blank"}
    for n in range(4):
        for letters in itertools.product("suaoUx" if n == 3 else "suaoSUAx", repeat=n):
            r = [roles.get(x.lower(), "user") for x in letters]
            f = [faults.get(x, "truncated" if x.isupper() else None) for x in letters]
            want = every_audit(r, f, 2 if n < 3 else 1)[:2]
            assert conversations.solve("".join(letters)) == want == stepwise(r, f)[:2], letters


def test_blocks_change_nothing():
    import random

    pick = random.Random(5)
    for n in (7, 64, 65, 130, 700):
        for _ in range(20):
            s = "".join(pick.choice("suuaaaSUAox") for _ in range(n))
            assert conversations.solve(s) == conversations.solve(s, 3) == conversations.solve(s, 1)
            roles = [{"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[x.lower()] for x in s]
            assert conversations.solve(s, 9) == stepwise(roles, ["blank" if x == "x" else "truncated" if x.isupper() else None for x in s])[:2]


def test_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op12_conversations"](spark, data).collect()} == brute(rows, stepwise)


def test_hard(spark):
    rows = []
    for c in range(60):
        rows += [(c, t, ("system", "user", "assistant", "user", "assistant")[t], f"Turn {t} of {c}{'.!? x'[(c + t) % 5]}") for t in range(c % 6 if c % 6 < 5 else 4)]
    rows += [(100, None, None, None), (100, None, "user", ""), (100, 3, "user", "a."), (100, 3, "user", "a."), (100, 3, "assistant", "b. \n"), (100, 9, "", "no role."), (100, 5, "user", " ")]
    rows += [(None, t, r, "word. " * 4000) for t, r in enumerate(("user", "assistant", "user"))]
    rows += [(101, None, "user", "only null turns"), (102, 1, "üser", "odd role."), (103, -5, "assistant", "late?"), (103, 40, "user", "!")]
    rows += rows[-3:]
    assert got(spark, rows, key=F.lit("x"), at=F.lit(1), fault=F.lit("y"), cost=F.lit(2)) == brute(rows)


def test_long_conversation(spark):
    rows = [(7, t, ("user", "assistant")[t * t % 7 % 2], f"Text {t % 90}{'.' if t % 5 else ''}") for t in range(1500)]
    assert got(spark, rows) == brute(rows, stepwise)


def test_empty(spark):
    assert got(spark, []) == {}


@pytest.mark.parametrize("n", [0, 40])
def test_dropped_whole(spark, n):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0][:5]
    rows = [(c, 1, "user", "Gone.") for c in gone] + [(c, 1, "user", "x") for c in range(500, 500 + n)]
    assert got(spark, rows) == brute(rows)


def test_repair_returns_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Yes?"), (1, 1, "user", "Yes?"), (1, 2, "assistant", "Cut")]
    done = conversations.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    want = every_audit([r[2] for r in rows], fault_of(rows))[2]
    assert [(r["role"], r["text"]) for r in done] == [(r, "" if k is None else rows[k][3]) for r, k in want]
    assert [r["position"] for r in done] == list(range(1, len(done) + 1))
