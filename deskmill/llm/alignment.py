"""Local alignment of word sequences, many pairs at a time in numpy.

Words are 64-bit hashes.  Sequences of a batch are padded with values that match nothing.
"""

from __future__ import annotations

import numpy as np

#: Padding of the two sides: never equal to each other.
PAD_A, PAD_B = np.uint64(1), np.uint64(2)


def padded(sequences: list[np.ndarray], pad: np.uint64, width: int = 0) -> np.ndarray:
    out = np.full((len(sequences), max([width, *map(len, sequences)])), pad)
    for row, s in zip(out, sequences, strict=True):
        row[: len(s)] = s
    return out


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each pair of rows, and its last position in ``a`` and in ``b`` (the first best cell in row order)."""
    n, width = b.shape
    h = np.zeros((n, width + 1), np.int32)
    ramp = gap * np.arange(width + 1, dtype=np.int32)
    best, end_a, end_b = (np.zeros(n, np.int32) for _ in range(3))
    for i in range(a.shape[1]):
        new = np.zeros_like(h)
        new[:, 1:] = h[:, :-1] + np.where(a[:, i : i + 1] == b, np.int32(match), np.int32(mismatch))
        new[:, 1:] = np.maximum(new[:, 1:], h[:, 1:] - gap)
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps along b
        column = h.argmax(axis=1)
        top = h[np.arange(n), column]
        better = top > best
        best, end_a, end_b = np.where(better, top, best), np.where(better, i, end_a), np.where(better, column - 1, end_b)
    return best, end_a, end_b


def banded(template: np.ndarray, texts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Banded local alignment of one template to rows that begin ``band`` words before its place.

    Row cell d of step i is text word i + d.  Per row: score (match 2, else -1), matched words, first and last text word.
    """
    n, cells = len(texts), 2 * band + 1
    zero = np.zeros((n, cells), np.int32)
    score, hits, first = zero.copy(), zero.copy(), zero.copy()
    best, best_hits, best_first, best_last = (np.zeros(n, np.int32) for _ in range(4))
    rows = np.arange(n)
    for i, word in enumerate(template):
        same = texts[:, i : i + cells] == word
        s = score + np.where(same, 2, -1).astype(np.int32)
        m, f = hits + same, np.where(score > 0, first, np.arange(i, i + cells, dtype=np.int32))
        up = zero - 1
        up[:, :-1] = score[:, 1:] - 1  # a template word without partner
        take = up > s
        s[take] = up[take]
        m[:, :-1], f[:, :-1] = np.where(take[:, :-1], hits[:, 1:], m[:, :-1]), np.where(take[:, :-1], first[:, 1:], f[:, :-1])
        for d in range(1, cells):  # a text word without partner
            take = s[:, d - 1] - 1 > s[:, d]
            s[:, d] = np.where(take, s[:, d - 1] - 1, s[:, d])
            m[:, d], f[:, d] = np.where(take, m[:, d - 1], m[:, d]), np.where(take, f[:, d - 1], f[:, d])
        gone = s <= 0
        s[gone], m[gone] = 0, 0
        score, hits, first = s, m, f
        d = s.argmax(axis=1)
        better = s[rows, d] > best
        best, best_hits = np.where(better, s[rows, d], best), np.where(better, m[rows, d], best_hits)
        best_first, best_last = np.where(better, f[rows, d], best_first), np.where(better, i + d, best_last)
    return best, best_hits, best_first, best_last


def seed_hits(hashes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values of ``hashes`` are in ``seeds`` (ascending, may repeat): places, and an index of each equal seed."""
    if not len(seeds) or not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.searchsorted(seeds, hashes)
    some = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == hashes)
    low = low[some]
    n = np.searchsorted(seeds, hashes[some], side="right") - low
    place = np.repeat(some, n)
    return place, np.repeat(low, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
