"""Shared folders, table reading and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (spark.checkpoint.dir); in local mode a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives lost executors."""
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_mb(docs: DataFrame, column: str = "text") -> float:
    """Size of a text column in MB, by one pruned scan."""
    row = docs.select(F.sum(F.octet_length(F.col(column).cast("string"))).alias("n")).first()
    return (row["n"] or 0) / 1e6


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
