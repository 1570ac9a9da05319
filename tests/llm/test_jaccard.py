"""The n-gram Jaccard join against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard
from tessera.llm.queries import QUERIES

from .test_texts import HARD, table


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset({tuple(w)} if w else ())


def brute(rows, percent=90):
    """{id: (n, component)} and the number of linked pairs of different sets."""
    sets = {k: shingle_set(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids, pairs = sorted(sets), set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                continue
            n = len(x & y)
            if 100 * n >= percent * (len(x) + len(y) - n):
                p, q = sorted((find(a), find(b)))
                up[q] = p
                if x != y:
                    pairs.add(frozenset((x, y)))
    return {k: (len(sets[k]), find(k)) for k in ids}, len(pairs)


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert found(QUERIES["op11_jaccard"](spark, data)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])[0]


def revised(words, edits, tag):
    out = list(words)
    for j, k in enumerate(edits):
        out[k] = f"{tag}{j}"
    return " ".join(out)


def test_hard(spark):
    base = [f"word{k}" for k in range(300)]
    near = [revised(base, [(37 * k) % 300, (91 * k + 5) % 300][: k % 3], f"e{k}x") for k in range(150)]  # most are linked, some only by others
    passage = [" ".join(base[:60] + [f"own{k}y{j}" for j in range(k % 9)]) for k in range(90)]
    texts = [*HARD, *near, *passage, "a b c d e f g h i j k", "a b c d e f g h i j k l", "A B C D E F G H I J K"]
    want, _ = brute(list(enumerate(texts)))
    assert found(jaccard.similar(table(spark, texts, node=F.lit(1), seg=F.lit("x"), component=F.lit(2)))) == want


@pytest.mark.parametrize("percent", [75, 100])
def test_thresholds_and_all_links(spark, percent):
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base[a:b]) for a in range(0, 12, 2) for b in range(28, 41, 3)] + ["one", "one", "two words", None]
    want, pairs = brute(list(enumerate(texts)), percent)
    assert found(jaccard.similar(table(spark, texts), percent=percent)) == want
    links, rows = jaccard.links(table(spark, texts), percent=percent)
    assert links.count() == pairs and rows.count() == len(texts) - 1


def test_small_groups_and_parts(spark, monkeypatch):
    for name, value in (("GROUP", 4), ("QUERIES", 3), ("SLICE", 2), ("TOKENS", 50)):
        monkeypatch.setattr(jaccard, name, value)
    base = [f"w{k}" for k in range(120)]
    texts = [revised(base, [k % 120], f"e{k}x") for k in range(60)]
    want, pairs = brute(list(enumerate(texts)))
    assert found(jaccard.similar(table(spark, texts))) == want
    assert jaccard.links(table(spark, texts))[0].count() == pairs


def test_ids(spark):
    texts = ["a b c d", "a b c d", "e f g h", "e f g h", "a b c d", None, ""]
    rows = jaccard.similar(table(spark, texts, ids=[7, 3, 3, 9, None, None, 5])).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == sorted([(7, 2, 3), (3, 2, 3), (3, 2, 3), (9, 2, 3), (None, 2, None), (None, 0, None), (5, 0, 5)], key=str)
    assert jaccard.similar(table(spark, [])).count() == 0
    assert jaccard.links(table(spark, []))[0].count() == 0


def test_similar_sets_agree_on_a_segment():
    pick = np.random.default_rng(3)
    for n in (1, 2, 9, 10, 11, 40, 333):
        starts = jaccard.classes(2 * n, 90)
        for _ in range(60):
            a = pick.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            for gone in range(n + 1):
                m = n - gone
                for more in range(0, n - m + 1):
                    if 100 * m < 90 * (n + more) or m + more > n:
                        continue
                    b = np.concatenate([a[:m], pick.integers(0, 1 << 63, more, np.uint64)])
                    k = int(np.searchsorted(starts, n, "right")) - 1
                    most = int(starts[k + 1]) - 1
                    assert set(jaccard.segments(np.sort(a), k, most, 90)) & set(jaccard.segments(np.sort(b), k, most, 90))
                    assert np.searchsorted(starts, len(b), "right") - 1 in (k, k - 1)
