"""What counts pairs of ranks in the suffix rounds gives the pairs of the rows that they are joined to, and nothing else."""

import numpy as np
import pytest

from tessera.llm import rolling, suffixes


@pytest.mark.parametrize("w", [1, 2, 7, 64, 101, 151])
def test_windows(w):
    x = np.random.default_rng(w).integers(0, 1 << 63, 400).astype(np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(x, w)
    assert (rolling.sliding_min(x, w) == view.min(axis=1)).all()
    assert (rolling.sliding_min(x, w, np.maximum) == view.max(axis=1)).all()
    assert len(rolling.sliding_min(x[: w - 1], w)) == 0


def test_counted(spark):
    texts = ["".join(chr(97 + (k * j * j + j) % 26) for j in range(900)) * (1 + k % 2) for k in range(6)]
    rows = spark.createDataFrame([(bytes([k]), 0, bytearray(t, "ascii")) for k, t in enumerate(texts)], "key binary, at long, reach binary")
    pairs = lambda df: sorted((r["r1"], r["r2"]) for r in df.collect())
    for offset in (25, 50):
        counts, runs = suffixes._runs(rows, 200, offset, counted=True), suffixes._runs(rows, 200, offset)
        assert counts.columns == ["r1", "r2", "n"] and pairs(counts) == pairs(runs) != []
    asked = rows.selectExpr("key", "at", "reach", "array(named_struct('first', 0L, 'more', 30, 'asks', true), named_struct('first', 500L, 'more', 9, 'asks', false)) AS runs")
    counts, starts = suffixes._starts(asked, 200, counted=True), suffixes._starts(asked, 200)
    assert counts.count() == 6 * 41 and starts.count() == 6 * 31
    assert pairs(counts.filter("asks")) == pairs(starts)
