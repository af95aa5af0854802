"""Queries of this subpackage's operators; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm import queries_audit, queries_matching, queries_models, queries_native
from deskmill.llm.common import shared_folder, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.token_files import read_token_files, write_token_files

    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.substring_dedup import remove_repeated_passages

    found = remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.simhash import fingerprints, hamming_components

    return hamming_components(fingerprints(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_token_files, op3_substring_dedup, op6_packing, op9_simhash)} | queries_native.QUERIES | queries_matching.QUERIES | queries_models.QUERIES | queries_audit.QUERIES
ORACLES: dict[str, str] = {**queries_native.ORACLES, **queries_audit.ORACLES}
