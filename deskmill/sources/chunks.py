"""The chunk table: packed vectors and a token estimate per chunk, in a folder per kind of source and bucket of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions.tables import table_if_any
from deskmill.functions.vectors import pack_vector, unpack_vector

KEY = ("source_type", "source_id", "site_id", "position")
SOURCE = ("source_type", "source_id")
_SCHEMA = "source_id long, site_id long, position int, content string, tokens long, vector binary, source_type string, bucket int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*SOURCE), F.lit(buckets)).cast("int").alias("bucket")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the table; chunks without a vector keep a null one, and about four characters are a token."""
    types = {"source_type": "string", "source_id": "long", "site_id": "long", "position": "int"}
    return chunks.select(*(F.col(c).cast(types[c]).alias(c) for c in KEY), "content", F.ceil(F.length("content") / 4).cast("long").alias("tokens"), pack_vector(F.col("embedding")).alias("vector"))


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/_layout").first()["buckets"]


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """A folder is written by as few tasks as its size asks for: those that are too large are split."""
    out = rows.hint("rebalance", "source_type", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" else "static")
    out.partitionBy("source_type", "bucket").parquet(path)


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", buckets: int = 64) -> None:
    """Add ``chunks`` to the table at ``path``, or make it anew (mode ``overwrite``).

    ``buckets`` is fixed when a table is made: about as many as let one of them be rewritten in little time.
    """
    spark = chunks.sparkSession
    if mode == "overwrite":
        rows = chunk_rows(chunks).select("*", _bucket(buckets))
        rows.hint("rebalance", "source_type", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("source_type", "bucket").parquet(path)
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")
        return
    layout = table_if_any(spark, f"{path}/_layout", "buckets int")
    if layout is None:
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/_layout")
    else:
        buckets = layout.first()["buckets"]
    _write(chunk_rows(chunks).select("*", _bucket(buckets)), path, "append")


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a table, with their vectors."""
    t = _table(spark, path).where("source_id IS NOT NULL")
    return t.select(*KEY, "content", "tokens", F.when(F.col("vector").isNotNull(), unpack_vector(F.col("vector"))).alias("embedding"))


def replace_chunks(new: DataFrame, touched: DataFrame, path: str, failed: DataFrame | None = None) -> None:
    """Replace all chunks of the touched sources together; only the folders that hold such sources are read and rewritten.

    ``new`` are the sources' chunks with their embeddings; a touched source without any loses its own, one of ``failed``
    (source_type, source_id) keeps them.  The new rows are complete before the folders are swapped, and doing it again
    gives the same table.  A folder that is left without chunks keeps one row without a source, which readers skip.
    """
    spark = new.sparkSession
    buckets = _buckets(spark, path)
    sources = touched.select(F.col("source_type").cast("string").alias("source_type"), F.col("source_id").cast("long").alias("source_id")).distinct()
    if failed is not None:
        sources = sources.join(failed.select(*SOURCE), list(SOURCE), "left_anti")
    sources = sources.select("*", _bucket(buckets))
    folders = sources.select("source_type", "bucket").distinct()
    rows = chunk_rows(new).join(sources.select(*SOURCE), list(SOURCE), "left_semi").select("*", _bucket(buckets))
    kept = _table(spark, path).where("source_id IS NOT NULL").join(folders, ["source_type", "bucket"], "left_semi").join(sources.select(*SOURCE), list(SOURCE), "left_anti")
    columns = kept.columns
    marks = folders.select("source_type", "bucket", *(F.lit(None).alias(c) for c in columns if c not in ("source_type", "bucket")))
    _write(kept.select(columns).unionByName(rows.select(columns)).unionByName(marks.select(columns)), path, "overwrite")
