"""Operators on texts against brute force: decontamination, near-duplicates, repeated passages, licences, mixing."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, licences, minhash, mixing, suffixes
from tessera.llm.components import components
from tessera.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))
HARD = [None, "", "   \n\t ", "one", "four words are here", "a b c d e", "the same text again and again, " * 20, "the same text again and again, " * 20, "ünïcödé ßtraße " * 30, LONG, LONG + " tail", "\U0001f600" * 120, "x" * 1000]


def table(spark, texts, ids=None, **extra):
    rows = [(k if ids is None else ids[k], t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return df


def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLE[name])


# --- decontamination -------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(texts, items):
    windows = defaultdict(set)
    for ident, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(ident))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_small(spark):
    item = " ".join(f"q{k}" for k in range(20))
    items = [(1, item), (2, "short item"), (3, None), (10, "!!"), (4, item.upper() + " more"), (5, "short item")]
    texts = [*HARD, item, f"before {item} after", "this has a Short, ITEM inside", " ".join(f"q{k}" for k in range(12)), f"{LONG} {item}", item]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(table(spark, texts, n_words=F.lit(1), spans=F.lit("x")), bench).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == brute_contamination(texts, items)


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(table(spark, HARD), none).collect()
    assert len(got) == len(HARD) and not any(r["contaminated"] or r["n_hit"] for r in got)
    assert decontamination.contamination(table(spark, []), none).count() == 0
    assert decontamination.decontaminate(table(spark, HARD + HARD), none).count() == 2 * len(HARD)


def test_decontaminate_keeps_columns(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = table(spark, ["one two three", "clean text", None, "one two three"], ids=[None, 1, None, 7])
    assert sorted(str(r["text"]) for r in decontamination.decontaminate(docs, bench).select(docs.columns).collect()) == ["None", "clean text"]


# --- near-duplicates -------------------------------------------------------------------------------------------


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or min(len(x), len(y)) * 100 < 75 * max(len(x), len(y)):
                continue
            n = len(x & y)
            if 100 * n >= 75 * (len(x) + len(y) - n):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {k: (len(sets[k]), find(k), find(k) == k) for k in ids}


def test_near_duplicates_of_table(spark, data):
    docs = documents(spark, data)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op5_minhash"](spark, data).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_near_duplicates_hard(spark):
    base = [f"token{k}" for k in range(100)]
    chain = [" ".join(base[:k] + [f"other{j}" for j in range(k, 100)]) for k in range(100, 60, -3)]  # neighbours are close, ends aren't
    texts = [*HARD, *chain, " ".join(base), " ".join(base).upper(), *["copy of a copy of a copy"] * 50]
    got = minhash.near_duplicates(table(spark, texts, component_id=F.lit(0), id=F.lit(1))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(list(enumerate(texts)))


@pytest.mark.parametrize("reach", [1, 2])
def test_components_of_chains(spark, reach):
    n = 500
    pairs = [(k, k + d) for d in range(1, reach + 1) for k in range(n - d)]
    shuffled = {k: k * 7919 % 10_007 for k in range(n)}
    links = [*pairs, *[(20_000 + shuffled[a], 20_000 + shuffled[b]) for a, b in pairs], *[(50_000 + k, 60_000) for k in range(50)]]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: 0 if x < 10_000 else 50_000 if x >= 50_000 else 20_000 for pair in links for x in pair}


def test_near_duplicates_of_many_revisions(spark):
    words = [f"token{k}" for k in range(1300)]
    texts = [" ".join(words[4 * k : 4 * k + 60]) for k in range(300)]  # each like the one before, unlike those five earlier
    got = minhash.near_duplicates(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(list(enumerate(texts)))
    assert {r["component_id"] for r in got} == {0}


def test_near_duplicates_at_threshold(spark):
    a = " ".join(f"w{k}" for k in range(11))  # seven shingles; six of eight in common are exactly 0.75
    b = " ".join(f"w{k}" for k in range(1, 12))
    got = minhash.near_duplicates(table(spark, [a, b])).collect()
    assert {r["component_id"] for r in got} == {0}


def test_drop_near_duplicates(spark):
    docs = table(spark, ["a b c d e f", "a b c d e f", None, "", "z y x w v u"], ids=[5, 2, 9, None, None])
    kept = minhash.drop_near_duplicates(docs)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["2", "9", "None", "None"]
    assert minhash.drop_near_duplicates(table(spark, [])).count() == 0


# --- repeated passages -----------------------------------------------------------------------------------------


def brute_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[k : k + length]) for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        keep, end, spans, k = bytearray(), 0, 0, 0
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                start = max(k, end)
                gone[start : k + length] = b"\x01" * (k + length - start)
                end = k + length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        keep = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(keep), spans, hashlib.sha256(keep).hexdigest()))
    return out


def repeats(df):
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(df, texts=False).orderBy("doc_id").collect()]


def test_repeats_of_table(spark, data):
    docs = documents(spark, data)
    rows = docs.orderBy("doc_id").collect()
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op7_suffix"](spark, data).orderBy("doc_id").collect()]
    assert got == brute_repeats([r["text"] for r in rows])


def test_repeats_hard(spark):
    p = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(450))
    texts = [*HARD[:9], HARD[11], HARD[12], p[:199], p, "aa" + p[50:300] + "bb" + p[100:300], p[:200] + "|" + p[:200], "y" * 199, "y" * 200, "ab" * 300, "z" * 201, *[p[200:420] + str(k) for k in range(30)]]
    assert repeats(table(spark, texts, n_bytes=F.lit(1), spans=F.lit(2))) == brute_repeats(texts)


def test_repeats_of_frequent_passage(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 64)
    p = "".join(chr(97 + (k * 7 + k * k) % 26) for k in range(300))
    texts = [f"{k} " + p[k % 40 : 240 + k % 40] + f" end {k}" for k in range(60)]
    assert repeats(table(spark, texts)) == brute_repeats(texts)


def test_repeats_of_periods(spark):
    """Periodic runs of many lengths, alone, in each other and with one byte changed."""
    texts = [("ab" * 400)[: 190 + 7 * k] for k in range(12)] + ["abc" * 90, "abc" * 70 + "x" + "abc" * 70, "q" * 399, "q" * 199 + "r" + "q" * 199, "0123456789" * 25 + "|", "|" + "0123456789" * 20]
    assert repeats(table(spark, texts)) == brute_repeats(texts)


@pytest.mark.parametrize("length", [64, 100, 131])
def test_repeats_of_other_lengths(spark, length):
    p = "".join(chr(97 + (k * k + k // 5) % 26) for k in range(300))
    texts = [p, "aa" + p[50:180] + "bb" + p[100:300], p[:length] + "|" + p[: length - 1], "z" * (length + 1), None, p[10 : 10 + length - 1]]
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(table(spark, texts), length=length, texts=False).orderBy("doc_id").collect()]
    assert got == brute_repeats(texts, length)


class Captured:
    """Stands for a DataFrame and hands out the function that would work on its batches."""

    def select(self, *cols):
        return self

    def mapInArrow(self, work, schema):  # noqa: N802
        return work


def test_memory_of_long_periodic_runs():
    """600 periodic runs of different lengths, 8 MB in all, in one batch: memory stays that of a piece."""
    import resource

    import pyarrow as pa

    reach = [(b"ab%d" % k * 10_000)[: 13_000 + k] for k in range(600)]
    keys, at = pa.array([b"k"] * 600, pa.binary()), pa.array([0] * 600, pa.int64())
    runs = pa.array([[{"first": 0, "more": len(x) - 200, "asks": True}] for x in reach], pa.list_(pa.struct([("first", pa.int64()), ("more", pa.int32()), ("asks", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([keys, at, pa.array(reach, pa.binary()), runs], names=["key", "at", "reach", "runs"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for work in (suffixes._starts(Captured(), 200), suffixes._runs(Captured(), 200, 25), suffixes._runs(Captured(), 200, 50)):
        assert sum(x.num_rows for x in work(iter([batch]))) > 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_kept_text_has_whole_characters(spark):
    p = "ä" * 150
    rows = suffixes.dedup(table(spark, ["1" + p, "22" + p, None])).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in rows] == ["1", "22", ""]
    assert suffixes.dedup(table(spark, [])).count() == 0


# --- licences --------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = licences.TEXTS["MIT"]
    varied = "Copyright (c) 2019 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ;").replace("\n", "\r\n")
    texts = [mit, varied, mit + " extra words", "text\nReleased under the MIT Licence\nmore", None, "", "...", "Licensed under the Apache License, Version 2.0", LONG]
    got = licences.scan(table(spark, texts, digest=F.lit("x"), licence=F.lit("y"))).orderBy("doc_id").collect()
    assert [r["licence"] for r in got] == ["MIT", "MIT", None, None, None, None, None, "Apache-2.0", None]
    assert [r["notice_licences"] for r in got][3] == "MIT"
    assert [r["digest"] is None for r in got][4:7] == [True, True, True]
    assert licences.scan(table(spark, [])).count() == 0


def test_licence_files(spark):
    """Files as projects have them: titles, holders with and without a year, other spellings, other line breaks."""
    mit, bsd, isc = (licences.TEXTS[k] for k in ("MIT", "BSD-3-Clause", "ISC"))
    texts = [
        ("MIT License\n\nCopyright (c) 2020 Example Corp.\n\n" + mit, "MIT"),
        ("The MIT License (MIT)\n\nCopyright (c) <year> <holder>\nCopyright (c) Example Corp.\n\n" + mit, "MIT"),
        ("Copyright Example Inc.\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"),
        ("BSD 3-Clause License\n\n# Copyright 2019, The Authors\n\n" + bsd.replace("copyright holder", "copyright owner").replace("AUTHORS", "authors"), "BSD-3-Clause"),
        ("ISC License\r\n\r\n(c) 2001-2004 by Someone\r\n\r\n" + isc.replace("\n", "\r\n"), "ISC"),
    ]
    got = licences.scan(table(spark, [t for t, _ in texts] + ["Copyright 2020 X. Licensed under the Apache License, Version 2.0.\nmore"])).orderBy("doc_id").collect()
    assert [r["licence"] for r in got] == [k for _, k in texts] + [None]
    assert got[-1]["notice_licences"] == "Apache-2.0"


def test_digests_of_published_texts(spark):
    """The fixed digests are those of the texts that the system has, also when their paragraphs are wrapped anew."""
    import os
    import textwrap

    folder, files = "/usr/share/common-licenses", {"GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "Artistic-1.0": "Artistic"}
    texts = {k: open(f"{folder}/{f}", encoding="utf-8").read() for k in licences.DIGESTS if os.path.exists(f"{folder}/{(f := files.get(k, k))}")}
    if not texts:
        pytest.skip("no published texts here")
    fill = lambda p: textwrap.fill(p, 100, break_on_hyphens=False, break_long_words=False)
    wrapped = {k: "\n\n".join(p if k == 0 or "Copyright" in p else fill(p) for k, p in enumerate(re.split(r"\n[ \t]*\n", t))) for k, t in texts.items()}
    got = licences.scan(table(spark, [*texts.values(), *(wrapped[k] for k in ("Apache-2.0", "MPL-2.0", "GPL-3.0") if k in wrapped)])).orderBy("doc_id").collect()
    assert [r["licence"] for r in got] == [*texts, *(k for k in ("Apache-2.0", "MPL-2.0", "GPL-3.0") if k in wrapped)]


# --- mixing ----------------------------------------------------------------------------------------------------


def test_budgets_flow_to_siblings_first(spark):
    leaves = spark.createDataFrame([("w", "en", "a", 10), ("w", "en", "b", 1000), ("w", "de", "c", 1000), ("x", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, ["domain", "lang", "source"], 800, 1).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}  # a's shortage stays inside its language
    short = leaves.withColumn("tokens", F.when(F.col("lang") == "de", 20).otherwise(F.col("tokens")))
    got = {r["source"]: r["budget"] for r in mixing.budgets(short, ["domain", "lang", "source"], 800, 1).collect()}
    assert got == {"a": 10, "b": 370, "c": 20, "d": 400}  # c's goes to the other language before the other domain


def test_budgets_leave_no_token_over(spark):
    leaves = spark.createDataFrame([("w", "en", x, 100) for x in "abcdefg"] + [("x", "en", "h", 100)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, ["domain", "lang", "source"], 101, 1).collect()}
    assert sum(got.values()) == 101 and got["h"] == 50 and sorted(got[x] for x in "abcdefg") == [7, 7, 7, 7, 7, 8, 8] and got["a"] == got["b"] == 8


def test_weights_of_zero_leave_out(spark):
    path = ["domain", "lang", "source"]
    leaves = spark.createDataFrame([("w", "en", "a", 100), ("w", "de", "b", 1000), ("x", "de", "c", 1000), ("y", "en", "d", 1000), ("y", "en", "e", 1000)], "domain string, lang string, source string, tokens long")
    budget = lambda df, **weights: {r["source"]: r["budget"] for r in mixing.budgets(df, path, 900, 1, weights).collect()}
    got = budget(leaves, lang={"de": 0}, source={"e": 0})
    assert got == {"a": 100, "b": 0, "c": 0, "d": 800, "e": 0}
    assert budget(leaves.filter("source in ('a', 'd')")) == {"a": 100, "d": 800}
    assert set(budget(leaves, lang={"de": 0, "en": 0}).values()) == {0} == set(budget(leaves, domain={"w": 0, "x": 0, "y": 0}).values())
    docs = table(spark, ["a b c", "d e f"], source=F.when(F.col("doc_id") == 0, "s").otherwise("t"), domain=F.lit("d"))
    assert {r["source"] for r in mixing.mix(docs, ["domain", "source"], weights={"source": {"s": 0}}, share_of_corpus=1.0).collect()} == {"t"}


def test_mix_hard_rows(spark):
    texts = [*HARD, "same text here", "same text here", "another text of this id"]
    docs = table(spark, texts, ids=[*range(len(HARD)), 900, 900, 900], domain=F.lit("d"), tokens=F.lit("x"), t=F.lit(1), budget=F.lit(0))
    got = mixing.mix(docs, ["domain", "source"], max_epochs=1, share_of_corpus=1.0).collect()
    assert Counter(r["tokens"] for r in got) == Counter(n for t in texts if (n := len([w for w in re.split("[ \t\n\x0b\f\r]+", t or "") if w])))
    few = lambda: sorted((r["doc_id"], r["tokens"]) for r in mixing.mix(docs.filter("doc_id = 900"), ["domain", "source"], total_tokens=8, max_epochs=1).collect())
    assert few() == few()


def test_decontamination_of_many_spans(spark):
    """A long text with thousands of separate hits."""
    text = " ".join(f"short item {k}" for k in range(3000))
    bench = spark.createDataFrame([(1, "short item"), (2, "item 7 short item 8")], "item_id long, text string")
    got = decontamination.contamination(table(spark, [text]), bench).first()
    assert (got["n_words"], got["n_hit"], got["n_items"]) == brute_contamination([text], [(1, "short item"), (2, "item 7 short item 8")])[0][:3]
    assert len(got["spans"]) == 2998  # two join at the longer item, and the one behind it touches them


def test_mix_prefix(spark):
    docs = table(spark, ["a b c", "d e", None, " ", "f", "g h i j"], domain=F.lit(None).cast("string"), place=F.lit(1), epoch=F.lit("x"))
    got = mixing.mix(docs, ["domain", "source"], total_tokens=14, max_epochs=2).collect()
    by_epoch = Counter()
    for r in got:
        by_epoch[r["epoch"]] += r["tokens"]
    assert by_epoch[0] == 10 and by_epoch[1] <= 4
    order = sorted((r["place"], r["doc_id"]) for r in mixing.mix(docs, ["domain", "source"], total_tokens=20, max_epochs=2).collect() if r["epoch"] == 1)
    assert sorted((r["place"], r["doc_id"]) for r in got if r["epoch"] == 1) == order[: sum(r["epoch"] == 1 for r in got)]
    assert mixing.mix(table(spark, [], domain=F.lit("d")), ["domain", "source"]).count() == 0


def test_near_duplicates_of_a_family(spark, monkeypatch):
    """Copies that are changed more or less, so that only some of them are close to each other, in small squares."""
    import random

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HUBS", 1)
    rnd = random.Random(5)
    base = [f"token{k}" for k in range(120)]
    texts = []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(120)] = f"new{k}x{rnd.random()}"
        texts.append(" ".join(w))
    got = minhash.near_duplicates(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(list(enumerate(texts)))
