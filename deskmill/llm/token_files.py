"""Token-id files: whole documents as Simple-8b blocks, in ascending doc_id order.

A file is a Parquet container, so that Spark's committer keeps it whole when executors are lost.
Its rows are records of whole documents:

shard            number of the file, ascending with doc_id
start            ids of the shard before this record
n_ids            ids of the record
doc_ids, sizes   the record's documents and their ids (the end id included)
block_offsets    word offset of each block of 1024 ids
words            Simple-8b words, little-endian (see simple8b.py)

Cases: a null or empty text has only the end id; null doc_ids come first; rows with the same
doc_id are separate documents next to each other, ordered by a hash of their text, and equal rows in any
order; a very long text is one record; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskmill.llm import simple8b
from deskmill.llm.common import text_mb
from deskmill.llm.tokens import VOCAB, encoder
from deskmill.llm.words import pieces

FILE_SCHEMA = "shard int, start long, n_ids long, doc_ids array<long>, sizes array<int>, block_offsets array<int>, words binary"
_ARROW = pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("block_offsets", pa.list_(pa.int32())), ("words", pa.binary())])


def write_token_files(docs: DataFrame, path: str, vocab: str = VOCAB, end_id: int = 0, record_ids: int = 1 << 18, file_mb: float = 16) -> None:
    """Encode ``docs`` (doc_id, text) and write the files under ``path``, each of about ``file_mb`` of text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tokens = TaskContext.get().partitionId(), encoder(vocab)
        start, held, doc_ids, sizes = 0, [], [], []

        def record() -> pa.RecordBatch:
            ids = np.concatenate(held).astype(np.uint64)
            words, offsets = simple8b.encode(ids)
            row = [[shard], [start], [len(ids)], [doc_ids], [sizes], [offsets.tolist()], [words.astype("<u8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        n = 0
        for part in (p for batch in batches for p in pieces(batch, max_bytes=1 << 21)):
            ids, counts = tokens.encode_ended(part["text"], end_id)
            end = np.cumsum(counts)
            for doc_id, size, b in zip(part["doc_id"].to_pylist(), counts.tolist(), end.tolist(), strict=True):
                if held and n + size > record_ids:
                    yield record()
                    start, n, held, doc_ids, sizes = start + n, 0, [], [], []
                held.append(ids[b - size : b])
                doc_ids.append(doc_id)
                sizes.append(size)
                n += size
        if held:
            yield record()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The last key parts rows that are equal in all, so that no number of them is one task's.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("spread")]
    rows = rows.repartitionByRange(int(text_mb(docs) / file_mb) + 1, *order).sortWithinPartitions(*order)
    rows.mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, broadcast_files: int = 1_000_000) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit).

    The starts of the files, two numbers each, are broadcast when there are at most ``broadcast_files`` of them.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per file: the only thing that is ordered as a whole.
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    if totals.count() <= broadcast_files:
        starts = F.broadcast(starts)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words = np.frombuffer(row["words"], "<u8")
                ids = simple8b.decode(words, np.array(row["block_offsets"], np.int64), row["n_ids"]).astype("<u4")
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                data = [ids[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                starts = row["shard_start"] + row["start"] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.join(starts, "shard").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
