"""Document files, fetched pages and sitemaps as frames."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskmill.functions.html_region import html_region
from deskmill.functions.tables import small_batches, stored
from deskmill.functions.text import normalize_text, page_title
from deskmill.operators.records import absolute_url, header_lines, record_blocks

EXTENSIONS = ("txt", "md", "docx")


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word file, one per line; tabs and breaks kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    xml = re.sub(r"<w:tab\b[^>]*/>", "\t", re.sub(r"<w:br\b[^>]*/>", "\n", xml))
    return html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml))).strip()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, text, error) of every file under ``path``; a bad file is a row with an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                ext, text, error = name.rsplit(".", 1)[-1].lower(), None, None
                try:
                    if ext not in EXTENSIONS:
                        error = f"unsupported: {ext}"
                    else:
                        text = docx_text(data) if ext == "docx" else data.decode("utf-8", "replace")
                        if not text.strip():
                            text, error = None, "no text"
                except (KeyError, zipfile.BadZipFile) as e:
                    error = f"unreadable: {e}"
                rows.append((name, ext, text, error))
            yield pd.DataFrame(rows, columns=["path", "ext", "text", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(read, "path string, ext string, text string, error string")


def page_text(pages: DataFrame, region: bool = False, selector: str = "", strip_chrome: bool = True) -> DataFrame:
    """(url, title, text) of fetched pages (url, html); ``region`` keeps the content region only, and normalizes twice as rendered records do."""
    small_batches(pages.sparkSession)
    body = html_region(F.col("html"), selector, strip_chrome) if region else F.col("html")
    once = pages.select("url", page_title(F.col("html"), F.col("url")).alias("title"), normalize_text(body).alias("text"))
    return _normalized(once) if region else once


def _normalized(df: DataFrame) -> DataFrame:
    """``df`` with normalized ``text``, which has been through normalization in part: it is made first, once (explode of one item keeps Spark from merging the steps)."""
    made = df.select(*(c for c in df.columns if c != "text"), F.explode(F.array("text")).alias("text"))
    return made.withColumn("text", normalize_text(F.col("text"))).select(df.columns)


def rendered_text(records: DataFrame, pages: DataFrame, id: str, title: str, url: str, fields: list[str], labels: dict[str, str] | None = None, excluded: tuple[str, ...] | dict[str, tuple[str, ...]] = (), header: dict[str, str] | None = None, scope: str | None = None, selector: str = "", strip_chrome: bool = True) -> DataFrame:
    """(id, text, rendered) of records by their pages (url, html): header lines, then the page's content region, normalized.

    A record without an absolute URL, a page or any text in its region has its labelled fields instead.  Of several pages with
    one URL the least html counts.
    """
    small_batches(pages.sparkSession)
    found = pages.where(F.col("html").isNotNull()).groupBy(F.col("url").alias("_page")).agg(F.min("html").alias("_html"))
    # Exploded, so that Spark doesn't make the body a second time for the filter.
    body = found.select("_page", F.explode(F.array(normalize_text(html_region(F.col("_html"), selector, strip_chrome)))).alias("_body")).where("_body <> ''")
    head, extra = header_lines(F.col(title), F.col(url), header), record_blocks(records, fields, labels, excluded, scope)
    own = F.concat_ws("\n\n", F.when(head != "", head), *extra)
    r = records.select(F.col(id).alias("id"), absolute_url(F.col(url)).alias("_url"), head.alias("_head"), own.alias("_own"))
    r = r.join(body, F.col("_url") == F.col("_page"), "left")
    text = F.when(F.col("_body").isNull(), F.col("_own")).otherwise(F.concat("_head", F.lit("\n\n"), "_body"))
    return r.select("id", text.alias("text"), F.col("_body").isNotNull().alias("rendered")).transform(_normalized)


_SITEMAP = "url array<struct<loc: string>>, sitemap array<struct<loc: string>>"
#: Places of own URLs lie after those of all children.
_OWN = 1 << 40


def parsed_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, urls, children): addresses of (sitemap_url, xml) in their order; none of what isn't XML."""
    x = sitemaps.select("sitemap_url", F.from_xml("xml", _SITEMAP, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("x"))
    locs = lambda c: F.filter(F.transform(F.coalesce(c, F.array()), lambda e: F.btrim(e["loc"], F.lit(" \t\r\n"))), lambda u: F.coalesce(u, F.lit("")) != "")
    return x.select("sitemap_url", locs(F.col("x.url")).alias("urls"), locs(F.col("x.sitemap")).alias("children"))


def sitemap_places(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, path): every sitemap below a root at its first place, as the positions on the way to it.

    A frontier goes down one level a round along ``edges`` (parent, position, child); only the least path to a node is kept and
    followed, so neither cycles nor sitemaps with several parents multiply.  Rounds end when no path is new or less than before.
    """
    edges = stored(edges, "sitemap-edges")
    start = roots.select(F.col("sitemap_url").alias("root"), F.col("sitemap_url").alias("node"), F.array().cast("array<bigint>").alias("path")).distinct()
    known = frontier = stored(start, "sitemap-places")
    while True:
        step = frontier.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), F.concat("path", F.array("position")).alias("path"))
        step = step.groupBy("root", "node").agg(F.min("path").alias("path"))
        before = known.withColumnRenamed("path", "before")
        frontier = stored(step.join(before, ["root", "node"], "left").where("before IS NULL OR path < before").select("root", "node", "path"), "sitemap-frontier")
        if frontier.isEmpty():
            return known
        known = stored(known.unionByName(frontier).groupBy("root", "node").agg(F.min("path").alias("path")), "sitemap-places")


def sitemap_urls(sitemaps: DataFrame, cap: int = 500) -> DataFrame:
    """(sitemap_url, position, url) of sitemaps (sitemap_url, xml): of an index all children's URLs first, however deep, then its own.

    Each URL stands at its first place, and each sitemap counts at its first; what a cycle leads back to, what isn't XML and
    children that aren't there give nothing.
    """
    p = stored(parsed_sitemaps(sitemaps), "sitemaps")
    edges = p.select(F.col("sitemap_url").alias("parent"), F.posexplode("children").alias("position", "child")).withColumn("position", F.col("position").cast("long"))
    known = edges.join(p.select(F.col("sitemap_url").alias("child")), "child", "left_semi").groupBy("parent", "child").agg(F.min("position").alias("position"))
    own = p.select(F.col("sitemap_url").alias("node"), F.posexplode("urls").alias("i", "url"))
    places = sitemap_places(known, p).join(own, "node").select("root", "url", F.concat("path", F.array(F.col("i") + F.lit(_OWN))).alias("place"))
    once = places.groupBy("root", "url").agg(F.min("place").alias("place"))
    w = Window.partitionBy("root").orderBy("place")
    return once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap).select(F.col("root").alias("sitemap_url"), "position", "url")
