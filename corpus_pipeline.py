"""The corpus pipeline: documents through quality rules, dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and reread as the
next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm.common import checkpoint, free_name, table
from deskmill.llm.decontamination import without_leaks
from deskmill.llm.line_frequency import line_frequency_rules
from deskmill.llm.packing import pack_documents
from deskmill.llm.simhash import keep_first_of_group
from deskmill.llm.substring_dedup import dedup_substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that are too frequent on their host go from the others."""
    into = free_name(docs, "quality")
    judged = line_frequency_rules(docs, into=into).where(F.col(f"{into}.kept"))
    return judged.select(*(F.col(f"{into}.text_kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return keep_first_of_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that stand earlier in the corpus are cut out."""
    return dedup_substrings(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", packing)]
#: Token ids and alignments can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
