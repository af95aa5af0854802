"""Vectorised word splitting and hashing shared by the text operators.

A whole Arrow batch of texts is handled at once: the UTF-8 bytes of all its texts are one
numpy array, words are runs of bytes other than space and 0x09-0x0D, and every word gets a
64-bit hash.  Hashes are polynomial over the bytes (taken from prefix sums, so words of any
length cost the same) and finished with a bit mixer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
#: Odd multiplier of the byte polynomial and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Length up to which powers are kept; longer buffers are worked in pieces of this size.  A worker keeps the
#: powers while it lives and a piece takes some 40 bytes a byte, so this is small; hashes don't depend on it.
_PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    filled, step = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * U64(step)
        filled, step = filled + take, step * step & (1 << 64) - 1
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"], _TABLES["down"] = _powers(_P, _PIECE + 1), _powers(_P_INV, _PIECE + 1)
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: 1 for the six white-space bytes that separate words.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The same for every ASCII byte that is no letter or digit.
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all other bytes unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a batch of texts, in order; text i has words[first[i]:first[i + 1]]."""

    data: np.ndarray  # bytes of all texts, each followed by one space
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # of each text, in start; one more at the end
    hash: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a space, and where each text starts (one more at the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.empty(0, np.uint8)
    sizes = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.full(starts[-1], 0x20, np.uint8)
    keep = np.ones(starts[-1], bool)
    keep[starts[1:] - 1] = False
    data[keep] = body[offsets[0] : offsets[-1]]
    return data, starts


def split_words(column: pa.Array, lower: bool = False, hashed: bool = True, marks: bool = False) -> Words:
    """Words of each text; null and blank texts have none.  ``lower`` maps A-Z only; ``marks``: all ASCII marks part words too."""
    data, starts = text_bytes(column)
    if lower:
        data = _LOWER[data]
    space = (_IS_MARK if marks else _IS_SPACE)[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    words = Words(data, start, end, np.searchsorted(start, starts))
    if hashed:
        words.hash = word_hashes(data, start, end)
    return words


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    up, down = _tables()
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        low = start[at]
        stop = int(np.searchsorted(end, low + _PIECE, side="right"))
        if stop <= at:  # one word longer than a piece
            out[at] = U64(_long_hash(data[start[at] : end[at]]))
            at += 1
            continue
        high = end[stop - 1]
        part = (data[low:high].astype(U64) + U64(1)) * up[: high - low]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=total[1:])
        s = start[at:stop] - low
        out[at:stop] = mix((total[end[at:stop] - low] - total[s]) * down[s])
        at = stop
    return out


def _long_hash(word: np.ndarray) -> int:
    value, scale = 0, 1
    up, _ = _tables()
    for i in range(0, len(word), _PIECE):
        part = word[i : i + _PIECE].astype(U64) + U64(1)
        value = (value + int((part * up[: len(part)]).sum(dtype=U64)) * scale) & (1 << 64) - 1
        scale = scale * pow(_P, len(part), 1 << 64) & (1 << 64) - 1
    return int(mix(np.array([value], U64))[0])


def window_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring words (runs over text ends too; callers mask those)."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    total = word_hash[:n].copy()
    for i in range(1, size):
        total *= U64(0xD6E8FEB86659FD93)
        total += word_hash[i : i + n]
    return mix(total)


def whole_windows(first: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """True for the window starts whose ``size`` words lie in one text."""
    n = n_words - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + size <= last


def pieces(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 22):
    """The batch in slices of about ``max_bytes`` of text, one row at least; bounds a task's memory."""
    sizes = pa.compute.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def joined_by_space(words: Words) -> Words:
    """The same words over text in which one space stands between words (leading white space becomes one space)."""
    space = _IS_SPACE[words.data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    place = np.cumsum(keep) - 1
    data = np.where(space, np.uint8(0x20), words.data)[keep]
    return Words(data, place[words.start], place[words.end - 1] + 1, words.first, words.hash)
