"""Simple-8b word-aligned integer coding in numpy.

Every 64-bit word has a 4-bit selector on top and packs as many of the next ids as fit its 60 data
bits.  Ids are coded in blocks of BLOCK; no word crosses a block, so each block is decoded on its
own from its word offset.  Selector 0 is an escape: the next word holds one id of 2**60 or more,
whose own top four bits are never zero.  The free slots of a block's last word are zero.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 1024
#: Ids and bits of selectors 1 to 14 (fixed values of the published format).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_ROOM = BLOCK + 60


def _width(ids: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(ids.shape, np.uint8), ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= U64(1 << step)
        out += (big * np.uint8(step)).astype(np.uint8)
        rest = np.where(big, rest >> U64(step), rest)
    return out + (rest > 0)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word offset of each block."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, U64), np.empty(0, np.int32)
    grid = np.zeros((blocks, _ROOM), U64)
    full = np.zeros(blocks * BLOCK, U64)
    full[:n] = ids
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    width = _width(grid[:, :BLOCK])
    column = np.arange(BLOCK, dtype=np.int16)
    selector = np.zeros((blocks, BLOCK), np.int8)
    for s in range(len(COUNTS) - 1, 0, -1):  # ends with the selector that packs most ids
        misfit = np.where(width > BITS[s], column, np.int16(BLOCK + 60))
        ahead = np.minimum.accumulate(misfit[:, ::-1], axis=1)[:, ::-1]
        selector[ahead - column >= COUNTS[s]] = s
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    at, block, places = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(block):  # one word of every unfinished block
        s = selector[block, at]
        places.append((block, at, s))
        at = at + COUNTS[s]
        more = at < lengths[block]
        block, at = block[more], at[more]
    b, p, s = (np.concatenate(x) for x in zip(*places, strict=True))
    order = np.lexsort((p, b))
    b, p, s = b[order], p[order], s[order]
    size = np.where(s == 0, 2, 1)
    offset = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), U64)
    flat = grid.reshape(-1)
    for k in range(len(COUNTS)):
        if len(mine := np.flatnonzero(s == k)):
            source = b[mine] * _ROOM + p[mine]
            if k == 0:
                words[offset[mine] + 1] = flat[source]
                continue
            packed = np.full(len(mine), U64(k) << U64(60))
            for i in range(COUNTS[k]):
                packed |= flat[source + i] << U64(i * BITS[k])
            words[offset[mine]] = packed
    starts = np.searchsorted(b, np.arange(blocks))
    return words, offset[starts].astype(np.int32)


def decode(words: np.ndarray, block_offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of all blocks."""
    if not n:
        return np.empty(0, U64)
    blocks = len(block_offsets)
    selector = (words >> U64(60)).astype(np.int64)
    header = np.ones(len(words), bool)
    header[np.flatnonzero(selector == 0) + 1] = False
    where = np.flatnonzero(header)
    s = selector[where]
    block = np.searchsorted(block_offsets, where, side="right") - 1
    slot = np.cumsum(COUNTS[s]) - COUNTS[s]
    first = np.searchsorted(where, block_offsets)
    slot = slot - slot[first][block]
    grid = np.zeros((blocks, _ROOM), U64)
    flat = grid.reshape(-1)
    target = block * _ROOM + slot
    for k in range(len(COUNTS)):
        if len(mine := np.flatnonzero(s == k)):
            if k == 0:
                flat[target[mine]] = words[where[mine] + 1]
                continue
            data, mask = words[where[mine]], U64((1 << int(BITS[k])) - 1)
            for i in range(COUNTS[k]):
                flat[target[mine] + i] = data >> U64(i * BITS[k]) & mask
    return grid[:, :BLOCK].reshape(-1)[:n]
