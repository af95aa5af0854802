"""Queries of the operators that learn: language identification and URL rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm.common import table

#: The listed rules of the query (fixed values).
LISTED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.language_id import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    found = predict(docs, train(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.url_rules import judge_urls, listed_rules, mine_rules

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(pages, listed_rules(spark, LISTED), mine_rules(labelled))


QUERIES = {f.__name__: f for f in (op7_language_id, op8_url_filter)}
