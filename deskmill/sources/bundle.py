"""Portable index bundles: NDJSON with a header line and a line per source with its chunks nested."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions.vectors import pack_vector, unpack_vector
from deskmill.sources.chunks import replace_chunks

FORMAT = 1
_CHUNK = "array<struct<position: int, site: string, content: string, embedding: string>>"
_LINE = f"format int, model string, dimensions int, kind string, uid string, chunks {_CHUNK}"


def export_bundle(chunks: DataFrame, sites: DataFrame, elements: DataFrame, path: str, model: str, dimensions: int, only: list[str] | None = None) -> DataFrame:
    """Write a gzip bundle and report (kind, exported, chunks, skipped, dropped).

    Site ids become handles and element ids uids; chunks of unknown sites are dropped, sources without an element are skipped; both are counted.
    """
    every = chunks.where(F.col("source_type").isin(only)) if only else chunks
    every = every.join(sites.select("site_id", F.col("handle").alias("site")), "site_id", "left").withColumn("known", F.expr("site_id IS NULL OR site IS NOT NULL"))
    lost = every.groupBy(F.col("source_type").alias("kind")).agg(F.count_if(~F.col("known")).alias("dropped"))
    c = every.where("known").drop("known")
    c = c.join(elements.select(F.col("id").alias("source_id"), "uid"), "source_id", "left")
    c = c.withColumn("packed", F.base64(pack_vector(F.col("embedding"))))
    nested = F.transform(F.sort_array(F.collect_list(F.struct("position", "id", "site", "content", "packed"))), lambda x: F.struct(x["position"].alias("position"), x["site"].alias("site"), x["content"].alias("content"), x["packed"].alias("embedding")))
    rows = c.where("uid IS NOT NULL").groupBy(F.col("source_type").alias("kind"), "uid").agg(nested.alias("chunks"))
    header = chunks.sparkSession.range(1).select(F.lit(json.dumps({"format": FORMAT, "model": model, "dimensions": dimensions})).alias("value"))
    header.coalesce(1).write.option("compression", "gzip").text(f"{path}/header")
    rows.select(F.to_json(F.struct("kind", "uid", "chunks")).alias("value")).write.option("compression", "gzip").text(f"{path}/sources")
    per = c.groupBy(F.col("source_type").alias("kind")).agg(
        F.countDistinct(F.when(F.col("uid").isNotNull(), F.col("source_id"))).alias("exported"), F.count_if(F.col("uid").isNotNull()).alias("chunks"), F.countDistinct(F.when(F.col("uid").isNull(), F.col("source_id"))).alias("skipped"))
    return lost.join(per, "kind", "left").na.fill(0).select("kind", "exported", "chunks", "skipped", "dropped")


@dataclass
class ImportPlan:
    """What an import would do: the chunks and the sources (source_type, source_id) it places, and (kind, placed, skipped, written, dropped)."""

    chunks: DataFrame
    sources: DataFrame
    report: DataFrame


def plan_import(spark: SparkSession, path: str, sites: DataFrame, elements: DataFrame, model: str, dimensions: int, reembed: bool = False, site_map: dict[str, str] | None = None) -> ImportPlan:
    """The chunks of a bundle placed in this installation; refuses newer formats and other models.  Nothing is written.

    A source whose uid no element has is skipped, a chunk whose site this installation doesn't have is dropped.
    """
    head = spark.read.text(f"{path}/header").select(F.from_json("value", _LINE).alias("h")).select("h.*").first()
    if head is None or head["format"] is None or head["format"] > FORMAT:
        raise ValueError("unknown bundle format")
    if not reembed and (head["model"] != model or head["dimensions"] != dimensions):
        raise ValueError(f"bundle was embedded by {head['model']} ({head['dimensions']})")
    lines = spark.read.text(f"{path}/sources").select(F.from_json("value", _LINE).alias("l")).select("l.kind", "l.uid", "l.chunks").where("kind IS NOT NULL")
    placed = lines.join(elements.select("uid", F.col("id").alias("source_id")), "uid", "left")
    rows = placed.where("source_id IS NOT NULL").select("kind", "source_id", F.explode("chunks").alias("c")).select("kind", "source_id", "c.*")
    names = F.create_map(*[F.lit(x) for pair in site_map.items() for x in pair]) if site_map else None
    rows = rows.withColumn("site", F.coalesce(names[F.col("site")], "site")) if names is not None else rows
    rows = rows.join(sites.select(F.col("handle").alias("site"), "site_id"), "site", "left")
    known = F.col("site").isNull() | F.col("site_id").isNotNull()
    vector = F.lit(None).cast("array<float>") if reembed else unpack_vector(F.unbase64("embedding"))
    written = rows.groupBy("kind").agg(F.count_if(known).alias("written"), F.count_if(~known).alias("dropped"))
    report = placed.groupBy("kind").agg(F.count_if(F.col("source_id").isNotNull()).alias("placed"), F.count_if(F.col("source_id").isNull()).alias("skipped"))
    report = report.join(written, "kind", "left").na.fill(0, ["written", "dropped"])
    own = rows.where(known).select(F.col("kind").alias("source_type"), "source_id", "site_id", "position", "content", vector.alias("embedding"))
    return ImportPlan(own, placed.where("source_id IS NOT NULL").select(F.col("kind").alias("source_type"), "source_id"), report)


def import_bundle(table: str, plan: ImportPlan, dry_run: bool = False) -> DataFrame:
    """Replace the chunks of all placed sources in the table at ``table``, and give the report; with ``dry_run`` only the report.

    A placed source takes over what the bundle has of it: all its former chunks go, also where every new one is dropped.
    Importing again gives the same table.
    """
    if not dry_run:
        replace_chunks(plan.chunks, plan.sources, table)
    return plan.report
