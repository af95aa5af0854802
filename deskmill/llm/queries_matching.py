"""Queries of the operators that match documents against given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskmill.llm.common import table


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op2_decontamination, op10_license_scan)}
