"""Vectorised polynomial fingerprints of byte spans and words, used inside tasks on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


_CODES = seeds(256, 77)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64, at least ``n`` of them."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 1 << 16)
        _powers[base] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, base, U64))])
    return _powers[base]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the fingerprint of any span."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_CODES[data] * _power(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans [start, stop); equal bytes give equal values wherever they stand."""
    raw = (pre[stop] - pre[start]) * _power(_INVERSE, len(pre))[start]
    return mix64(raw + (stop - start).astype(U64) * U64(0x632BE59BD9B4E019))


def grams(pre: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all spans of ``k`` bytes, as ``spans`` gives them."""
    n = len(pre) - k
    if n <= 0:
        return np.empty(0, U64)
    raw = pre[k:] - pre[:-k]
    raw *= _power(_INVERSE, n)[:n]
    raw += U64(k * 0x632BE59BD9B4E019 % (1 << 64))
    return mix64(raw)


def sliding_min(x: np.ndarray, w: int, least=np.minimum) -> np.ndarray:
    """Minimum (or what ``least`` gives of two) of each window of ``w`` values, by doubling."""
    n, h = len(x), 1
    if n < w:
        return np.empty(0, x.dtype)
    while 2 * h <= w:
        x = least(x[:-h], x[h:])
        h *= 2
    return least(x[: n - w + 1], x[w - h :])


def word_hashes(data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Fingerprints of the words of ``data``: A-Z lower-cased, separated by ASCII white space."""
    out, lo = [], 0
    while lo < len(data):
        hi = lo + piece
        if hi < len(data):  # end the piece at white space; a longer word makes a longer piece
            space = _SPACE[data[hi:]]
            hi = hi + int(space.argmax()) if space.any() else len(data)
        part = data[lo:hi]
        edge = np.diff(np.concatenate([[True], _SPACE[part], [True]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            out.append(spans(prefix(_LOWER[part]), start, stop))
        lo = hi
    return np.concatenate(out) if out else np.empty(0, U64)


def buffers(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column, without copying; null counts as empty."""
    empty = np.empty(0, np.uint8)
    for x in column:
        raw = x.as_buffer() if x.is_valid else None
        yield np.frombuffer(raw, np.uint8) if raw is not None and raw.size else empty
