"""The last suffix round has a row per block of starts, aligned by what the starts reach; it removes what brute force does."""

from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffixes


def _removed(texts: list[str], length: int) -> list[int]:
    raw = [t.encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            gone[k : k + length] |= seen[b[k : k + length]] > 1
        out.append(int(gone.sum()))
    return out


def _letters(seed: int, n: int) -> str:
    return "".join(map(chr, np.random.default_rng(seed).integers(97, 123, n)))


def test_rows(spark):
    """Far fewer rows than starts, and equal ones wherever a passage stands."""
    passage = _letters(1, 900)
    texts = [_letters(k + 2, 37 * k) + passage for k in range(3)]
    rows = spark.createDataFrame([(bytes([k]), 0, bytearray(t, "ascii"), [(37 * k, 700, True)]) for k, t in enumerate(texts)], "key binary, at long, reach binary, runs array<struct<first: long, more: int, asks: boolean>>")
    starts, blocks = suffixes._starts(rows, 200).count(), suffixes._starts(rows, 200, width=suffixes.WIDTH)
    assert starts == 3 * 701
    found = blocks.collect()
    assert 4 * len(found) < starts
    width = suffixes.WIDTH
    assert sum((r["left"] >> 56) + (r["right"] >> 56) - width + 2 for r in found) == starts
    assert set(Counter((r["r1"], r["r2"], r["left"], r["right"]) for r in found).values()) == {3}
    assert suffixes._starts(rows, 200, counted=True, width=width).count() == len(found)


@pytest.mark.parametrize("length", [200, 33, 8, 5])
def test_edges(spark, length):
    """Repeats that begin and end anywhere in a block, at one place or at several, periodic text and repeated rows."""
    passage = _letters(99, 3 * length + 20)
    texts = [_letters(k, k % 3) + passage[k : len(passage) - (7 * k) % 20] + _letters(50 + k, 5) for k in range(17)]
    texts += ["ab" * length, "x" + "ab" * length, "z" * 3 * length, texts[0], texts[0], ""]
    docs = spark.createDataFrame([(min(k, 20), t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = suffixes.dedup(docs, length=length, texts=False).select("n_bytes", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(zip(map(len, texts), _removed(texts, length)))
