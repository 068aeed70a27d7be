"""Vectorised words and hashes over the bytes of Arrow string arrays.

A word is a maximal run of ASCII letters and digits and of all bytes from 0x80
on, in lower case: ``[0-9a-z\\x{80}-\\x{10FFFF}]+`` of ``lower(text)``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffer

U = np.uint64
BASE, SEG = 0x9E3779B97F4A7C15 | 1, 1 << 20
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True
_pow: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _pow:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(SEG + 1, base, U)
            p[0] = 1
            _pow.append(np.multiply.accumulate(p))
    return _pow[0], _pow[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; the spans are in order and don't overlap."""
    out = np.empty(len(start), U)
    pw, inv = powers()
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SEG, side="right")))
        lo, hi = int(start[at]), int(end[to - 1])
        if hi - lo <= SEG:
            h = np.zeros(hi - lo + 1, U)
            np.cumsum((data[lo:hi].astype(U) + U(1)) * pw[: hi - lo], out=h[1:])
            s, e = start[at:to] - lo, end[at:to] - lo
            out[at:to] = (h[e] - h[s]) * inv[s]
        else:  # one span longer than a segment: Horner by segments
            v = 0
            for a in range(lo, hi, SEG):
                part = data[a : min(hi, a + SEG)].astype(U) + U(1)
                v = (v + int(((part * pw[: len(part)]).sum(dtype=U))) * pow(BASE, a - lo, 1 << 64)) % (1 << 64)
            out[at] = v
        at = to
    return mix(out ^ (end - start).astype(U))


class Words(NamedTuple):
    """Hashes of all words, the rows' offsets into them, and their spans of bytes."""

    hashes: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def words(arr: pa.Array, lower: bool = True) -> Words:
    data, off = buffer(pc.utf8_lower(arr) if lower else arr)
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), np.zeros(len(off), np.int64), z, z)
    w = WORD[data]
    cut = off[1:-1]
    cut = cut[cut < len(data)]
    edge = w.copy()
    edge[1:] &= ~w[:-1]
    edge[cut] = w[cut]
    start = np.flatnonzero(edge)
    edge = w.copy()
    edge[:-1] &= ~w[1:]
    cut = cut[cut > 0] - 1
    edge[cut] = w[cut]
    end = np.flatnonzero(edge) + 1
    return Words(span_hashes(data, start, end), np.searchsorted(start, off), start, end)


def grams(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within rows, and their offsets; rows with fewer words have none."""
    size = np.diff(off)
    count = np.maximum(size - n + 1, 0)
    to = np.concatenate([[0], np.cumsum(count)])
    if not to[-1]:
        return np.zeros(0, U), to
    at = np.repeat(off[:-1] - to[:-1], count) + np.arange(to[-1])
    g = h[at].copy()
    for k in range(1, n):
        g = g * U(0x9FB21C651E98DF25) + h[at + k]
    return mix(g + U(n)), to


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(off) - 1))]).astype(np.int64)


def row_reduce(ufunc, values: np.ndarray, off: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduceat`` by rows, with ``empty`` for rows without values."""
    out = np.full(len(off) - 1, empty, values.dtype)
    has = np.flatnonzero(np.diff(off) > 0)
    if len(has):
        out[has] = ufunc.reduceat(values, off[has])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
