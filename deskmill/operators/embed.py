"""Embedding chunks with a pluggable model, in batches bounded by count and bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(dimensions: int = 64) -> Embedder:
    """An offline model: unit vectors of hashed words, the same on every machine."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def batches_of(texts: list[str], max_items: int, max_bytes: int) -> Iterator[list[int]]:
    """Positions of greedy batches; one text over the bytes goes alone."""
    batch, size = [], 0
    for i, text in enumerate(texts):
        n = len(text.encode())
        if batch and (len(batch) == max_items or size + n > max_bytes):
            yield batch
            batch, size = [], 0
        batch.append(i)
        size += n
    if batch:
        yield batch


def embed_chunks(df: DataFrame, embedder: Callable[[], Embedder] = hashed_words, text_col: str = "content", max_items: int = 96, max_bytes: int = 200_000) -> DataFrame:
    """``df`` with an embedding; ``embedder`` makes the model, once per task.  Texts without a vector get null."""
    schema = T.StructType([f for f in df.schema.fields if f.name != "embedding"] + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder()
        for table in tables:
            texts = [t or "" for t in table[text_col].to_pylist()]
            vectors: list = [None] * len(texts)
            for batch in batches_of(texts, max_items, max_bytes):
                for i, v in zip(batch, model([texts[i] for i in batch]), strict=False):
                    vectors[i] = None if v is None else np.asarray(v, np.float32).tolist()
            kept = [c for c in table.schema.names if c != "embedding"]
            yield pa.RecordBatch.from_arrays([table[c] for c in kept] + [pa.array(vectors, pa.list_(pa.float32()))], [*kept, "embedding"])

    return df.mapInArrow(run, schema)
