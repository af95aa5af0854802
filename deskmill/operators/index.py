"""Index maintenance: replacing, selecting and checking sources and their chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source_type", "source_id"]


def replace_source_chunks(index: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """The index with all chunks of the touched sources replaced together; a source without new chunks loses its own."""
    return index.join(touched.select(*KEY).distinct(), KEY, "left_anti").unionByName(new.join(touched.select(*KEY).distinct(), KEY, "left_semi"))


def split_live(items: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Training status of each item (id, status): only live ones are indexed."""
    out = items.join(chunk_counts, "id", "left")
    status = F.when(F.col("status") != "live", "skipped").when(F.coalesce("chunk_count", F.lit(0)) > 0, "indexed").otherwise("empty")
    return out.withColumn("message", F.when(F.col("status") != "live", F.concat(F.lit("Not indexed: entry is "), "status", F.lit(".")))).withColumn("train_status", status)


def url_path(url: Column) -> Column:
    path = F.btrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.when(path == "", "__home__").otherwise(path)


def covered_urls(urls: DataFrame, entries: DataFrame, sections: list[str]) -> DataFrame:
    """(url, covered): whether a live entry of a page-rendered section has the URL's path."""
    live = entries.where((F.col("status") == "live") & F.col("section").isin(sections)).select(F.col("uri").alias("path")).distinct().withColumn("hit", F.lit(True))
    return urls.withColumn("path", url_path(F.col("url"))).join(live, "path", "left").select("url", F.coalesce("hit", F.lit(False)).alias("covered"))


def index_health(tracked: DataFrame, elements: DataFrame, standalone: DataFrame | None = None) -> DataFrame:
    """(kind, id, problem) of each tracked source that has one; the first class that fits wins."""
    e = elements.select(F.col("id").alias("element_id"), "date_updated", "date_deleted", F.lit(True).alias("found"))
    t = tracked.join(e, "element_id", "left")
    problem = (
        F.when(F.col("found").isNull() | F.col("date_deleted").isNotNull(), "orphaned")
        .when(F.col("status") == "error", "failed")
        .when((F.col("chunk_count") == 0) & (F.col("status") != "skipped"), "blank")
        .when(F.col("last_trained_at").isNull() | (F.col("date_updated") > F.col("last_trained_at")), "stale")
    )
    out = t.select(F.lit("entry").alias("kind"), "id", problem.alias("problem"))
    if standalone is not None:
        alone = F.when(F.col("status") == "error", "failed").when((F.col("status") != "skipped") & (F.col("chunk_count") == 0), "blank")
        out = out.unionByName(standalone.select("kind", "id", alone.alias("problem")))
    return out.where("problem IS NOT NULL")


def index_totals(health: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row with the number of problems, of chunks, and of chunks whose vector is still JSON only (``vector_json`` without ``vector``)."""
    problems = health.agg(F.count("*").alias("problems"))
    held = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("vector_json").isNotNull() & F.col("vector").isNull()).alias("legacy_vectors"))
    return problems.crossJoin(held)  # one row each


def untrained_by_section(live: DataFrame, tracked: DataFrame) -> DataFrame:
    return live.join(tracked.select(F.col("element_id").alias("entry_id"), "site_id").distinct(), ["entry_id", "site_id"], "left_anti").groupBy("section").agg(F.count("*").alias("missing"))


def retrain_selection(tracked: DataFrame, elements: DataFrame | None = None, kinds: list[str] | None = None, stale_only: bool = False) -> DataFrame:
    """(kind, id, site_id) to index again: all tracked rows of some kinds, or the stale ones; QA rows only if active."""
    t = tracked if "kind" in tracked.columns else tracked.withColumn("kind", F.lit("entry"))
    if kinds is not None:
        t = t.where(F.col("kind").isin(kinds))
    if "active" in t.columns:
        t = t.where((F.col("kind") != "qa") | F.col("active"))
    if stale_only:
        t = t.join(index_health(t, elements).where("problem = 'stale'").select("id"), "id", "left_semi")
    return t.select("kind", "id", "site_id")


def training_summary(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    s = sources.groupBy("kind").agg(F.count("*").alias("sources"), F.max("last_trained_at").alias("last_trained_at"))
    c = chunks.groupBy(F.col("source_type").alias("kind")).agg(F.count("*").alias("chunks"))
    out = s.join(c, "kind", "full")
    return out.select("kind", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "last_trained_at")


def source_chunks(chunks: DataFrame, source_type: str, source_id: int) -> DataFrame:
    return chunks.where((F.col("source_type") == source_type) & (F.col("source_id") == source_id)).orderBy("position")


def add_urls(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Valid new URLs as pending sources."""
    c = candidates.withColumn("url", F.btrim("url", F.lit(" \t\n\r\0\x0b"))).where(F.rlike("url", F.lit(r"(?i)^https?://[^/\s?#]+")))
    c = c.groupBy("url").agg(F.min("site_id").alias("site_id"))
    return c.join(known.select("url"), "url", "left_anti").select("url", "site_id", F.lit("manual").alias("source"), F.lit("pending").alias("status"))


def qa_text(qa: DataFrame, sites: DataFrame, translator=None) -> DataFrame:
    """Text variants of active QA pairs: pinned to a site, shared, or one per site through ``translator`` (a column function).

    A shared pair that is translated has a row for every site: that product is the result asked for.
    """
    q = qa.where("active").select(F.col("id").alias("source_id"), "site_id", "translate", "question", "answer")
    s = sites.select(F.col("site_id").alias("sid"), "language")
    pinned = q.where("site_id IS NOT NULL").join(s, F.col("site_id") == F.col("sid"), "left").drop("sid")
    shared = q.where("site_id IS NULL AND NOT translate").withColumn("language", F.lit(None).cast("string"))
    each = q.where("site_id IS NULL AND translate").drop("site_id").crossJoin(s.withColumnRenamed("sid", "site_id"))
    if translator:
        each = each.withColumns({c: translator(F.col(c), F.col("language")) for c in ("question", "answer")})
    out = reduce(DataFrame.unionByName, [x.select("source_id", "site_id", "language", "question", "answer") for x in (pinned, shared, each)])
    return out.select("source_id", "site_id", "language", F.substring("question", 1, 200).alias("title"), F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("text"))


def contextualize(chunks: DataFrame, prefix: bool = True) -> DataFrame:
    """Chunks (title, section, content) with their place in front of the text, and a token estimate that counts it."""
    head = F.concat_ws(" > ", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")), F.when(F.coalesce("section", F.lit("")) != "", F.col("section")))
    text = F.when(head != "", F.concat(head, F.lit("\n\n"), "content")).otherwise(F.col("content")) if prefix else F.col("content")
    out = chunks.withColumn("content", text).withColumn("section", F.substring("section", 1, 500))
    return out.withColumn("tokens", F.ceil(F.length("content") / 4).cast("long"))
