"""Custom sources, reply hooks and a table function, for users of the library."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = {"entry", "category", "global", "file", "url", "qa", "source"}
_SOURCES: dict[str, tuple[DataFrame, Callable]] = {}
_REPLIES: list[Callable] = []


def register_source(handle: str, items: DataFrame, text_fn: Callable[[dict], str]) -> None:
    """A source of items (item_id, site_id, title, ...) whose text ``text_fn`` makes from a row; the later of two wins."""
    if not re.fullmatch(r"[a-z0-9_-]{1,20}", handle) or handle in RESERVED:
        raise ValueError(f"bad source handle: {handle}")
    _SOURCES[handle] = items, text_fn


def source_texts(handle: str) -> DataFrame:
    """(item_id, site_id, title, text, status, error): no text is ``empty``, an exception an ``error`` row."""
    items, text_fn = _SOURCES[handle]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                text, error = "", None
                try:
                    text = text_fn(row) or ""
                except Exception as e:  # an item's failure is a row, not the job's
                    error = f"{type(e).__name__}: {e}"
                out.append((text, "error" if error else "indexed" if text.strip() else "empty", error))
            yield batch[["item_id", "site_id", "title"]].assign(text=[x[0] for x in out], status=[x[1] for x in out], error=[x[2] for x in out])

    return items.mapInPandas(extract, "item_id long, site_id long, title string, text string, status string, error string")


def transform_reply(fn: Callable) -> None:
    """Add a column function that replies pass through, in order."""
    _REPLIES.append(fn)


def transformed(replies: DataFrame, column: str = "reply") -> DataFrame:
    for fn in _REPLIES:
        replies = replies.withColumn(column, fn(F.col(column)))
    return replies


def register_chunk_function(spark: SparkSession, name: str = "chunk_text") -> None:
    """Make ``SELECT * FROM chunk_text(text, size, overlap)`` work in SQL."""
    from deskmill.operators.chunking import chunks_sql

    chunks = chunks_sql(f"{name}.text", f"{name}.size", f"{name}.overlap")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, size INT, overlap INT) RETURNS TABLE (position INT, section STRING, content STRING) RETURN SELECT inline({chunks})")
