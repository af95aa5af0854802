"""Sum-of-squares online packing of token sequences.

Each partition is one online stream.  A document's ids are cut into whole windows and a rest; a rest
of s ids goes to the fill level h (0: a new window) for which the sum of squared counts of
partially filled windows is least afterwards; counts per level are kept in an array.  At the end
of the stream the few windows still open are joined and cut anew into whole windows, and what
remains into power-of-two lengths, which need no padding.

No row is shuffled: partitions pack on their own and a sequence id names partition and window,
so the work is linear and a lost task is repeated with the same result.

Cases: a null or empty text is one end id; null doc_ids are kept; repeated rows are documents of
their own; a very long text is cut into as many windows as it fills; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.tables import small_batches
from deskmill.llm.tokens import VOCAB, encoder
from deskmill.llm.words import pieces

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class SumOfSquares:
    """Chooses levels; ``count[h]`` is the number of open windows filled with h ids."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def level(self, size: int) -> int:
        """Level to put ``size`` ids on (0: a new window); of equal choices the fullest."""
        count, top = self.count, self.capacity - size
        # 2 * (count[h + size] - count[h]) + 2 is the change of the sum; leaving a level by closing a window saves more.
        change = 2 * (count[size:] - count[: top + 1]) + 2
        change[0] = 2 * count[size] + 1
        change[top] = 1 - 2 * count[top] if top else 0
        usable = count[: top + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Put a piece (its second item has the size); returns the window if that closes it."""
        size = piece[1]
        h = self.level(size)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        window.append(piece)
        if h + size == self.capacity:
            return window
        self.open[h + size].append(window)
        self.count[h + size] += 1
        return None

    def rest(self) -> list[list]:
        """Windows still open, the fullest first."""
        return [w for level in reversed(self.open) for w in level]


def _cut(pieces: list[tuple], capacity: int) -> Iterator[list[tuple]]:
    """Windows over joined pieces: whole ones, then powers of two."""
    left = sum(p[1] for p in pieces)
    window, room = [], 0
    for doc_id, size, start, ids, doc_tokens in pieces:
        while size:
            if not room:
                if window:
                    yield window
                window, room = [], min(capacity, 1 << left.bit_length() - 1)
            take = min(size, room)
            window.append((doc_id, take, start, ids[: 4 * take], doc_tokens))
            ids, start, size, room, left = ids[4 * take :], start + take, size - take, room - take, left - take
    if window:
        yield window


def pack_documents(docs: DataFrame, capacity: int = 1024, vocab: str = VOCAB, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and place; see the module's notes."""
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocab)
        packer, sequence, rows, held = SumOfSquares(capacity), TaskContext.get().partitionId() << 32, [], 0

        def emit(window: list[tuple]) -> None:
            nonlocal sequence, held
            offset = 0
            for doc_id, size, start, ids, doc_tokens in window:
                rows.append((doc_id, start, size, ids, doc_tokens, sequence, offset))
                offset += size
            sequence += 1
            held += offset

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            held = 0
            return out

        for part in (p for batch in batches for p in pieces(batch, max_bytes=1 << 19)):
            found, counts = tokens.encode_ended(part["text"], end_id)
            data, end = found.astype("<u4").tobytes(), 0
            for doc_id, n in zip(part["doc_id"].to_pylist(), counts.tolist(), strict=True):
                begin, end = end, end + 4 * n
                whole = n - n % capacity
                for at in range(0, whole, capacity):
                    emit([(doc_id, capacity, at, data[begin + 4 * at : begin + 4 * (at + capacity)], n)])
                if whole < n and (window := packer.place((doc_id, n - whole, whole, data[begin + 4 * whole : end], n))):
                    emit(window)
                if held > 1 << 18:
                    yield batch_of()
        for window in _cut([p for w in packer.rest() for p in w], capacity):
            emit(window)
        if rows:
            yield batch_of()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, PIECES)
