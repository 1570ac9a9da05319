"""Spelling variants against deletion neighbourhoods by hand."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling
from tessera.llm.queries import QUERIES

from .test_texts import HARD, table


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def counted(rows):
    n = Counter()
    for k, text in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def brute(n):
    by = defaultdict(set)
    for w in n:
        for key in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by[key].add(w)
    links = defaultdict(set)
    for group in by.values():
        for a, b in itertools.combinations(group, 2):
            if near(a, b):
                links[a].add(b)
                links[b].add(a)
    form = {}
    for w in n:
        if links[w]:
            best = min(links[w], key=lambda v: (-n[v], v))
            form[w] = best if n[best] >= 10 * n[w] else None

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return {w: (n[w], len(links[w]), form.get(w), n[form[w]] if form.get(w) else None, root(w)) for w in n}


def found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = QUERIES["op13_spelling"](spark, data)
    assert set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    assert found(got) == brute(counted([(r["doc_id"], r["text"]) for r in docs.collect()]))


WORDS = ["abcdefg", "abcdefgh", "abcdefh", "bbcdefg", "bcdefgh", "abcdeffg", "xabcdefg", "abdcefg", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "àbcdefg", "Àbcdefg", "abcdefgÿ", "abc" + "d" * 9, "abc" + "d" * 10, "stationed", "stations", "station"]


@pytest.mark.parametrize("most", [1, 2, 5, 2000])
def test_pairs_at_any_depth(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "SUBTREE", most)
    got = {(r["word"], r["near"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in WORDS], "word string, n long")).collect()}
    assert got == {(a, b) for a in WORDS for b in WORDS if near(a, b)}


def test_hard(spark):
    texts = [*HARD, *["Stationary STATIONARY stationery " * 3 + "statiònary stationaryx"] * 12, "stationery1stationary_stationaryy-Stationaryyy stationaryyy"] + ["chain" + "x" * k + "end " for k in range(1, 5) for _ in range((3, 60, 900, 950)[k - 1])] + ["abc" + "d" * 300, "abc" + "d" * 301] * 2
    want = brute(counted(list(enumerate(texts))))
    assert any(v[4] not in (w, v[2]) for w, v in want.items() if v[2])
    assert found(spelling.group(spelling.vocabulary(table(spark, texts, word=F.lit("x"), n=F.lit(1), h=F.lit(2)), deal=31))) == want


def test_empty_and_nulls(spark):
    assert found(spelling.group(spelling.vocabulary(table(spark, []), deal=31))) == {}
    rows = spelling.vocabulary(table(spark, ["letters letters", None, "", "letters"], ids=[None, 1, 2, None])).collect()
    assert [(r["word"], r["n"]) for r in rows] == [("letters", 3)]
