"""Queries of sources: nested sitemaps made of the pages' addresses, and the table of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.functions.tables import shared_path
from deskmill.plans.core_queries import ORACLES, QUERIES
from deskmill.plans.views import view
from deskmill.sources.chunks import read_chunks, replace_chunks, write_chunks
from deskmill.sources.files import sitemap_urls

#: Sitemaps over the pages: ``root`` is an index of ten indexes, each of which is an index of five lists, lists some pages of its
#: own, and leads back to ``root`` and to its neighbour.
_LISTED = [("concat('list', page_id % 10, '-', page_id % 5)", "true"), ("concat('index', page_id % 10)", "page_id % 7 = 0")]
_TREE = """SELECT 'root' AS parent, concat('index', CAST(i AS {STR})) AS child, i AS position FROM ({TEN}) AS ten
UNION ALL SELECT concat('index', CAST(i AS {STR})) AS parent, concat('list', CAST(i AS {STR}), '-', CAST(j AS {STR})) AS child, j + 1 AS position FROM ({TEN}) AS ten, ({FIVE}) AS five
UNION ALL SELECT concat('index', CAST(i AS {STR})) AS parent, 'root' AS child, 0 AS position FROM ({TEN}) AS ten
UNION ALL SELECT concat('index', CAST(i AS {STR})) AS parent, concat('index', CAST((i + 1) % 10 AS {STR})) AS child, 9 AS position FROM ({TEN}) AS ten"""


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def a3_sitemap_urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("trim(url) <> ''")
    lists = [pages.where(which).select(F.expr(name).alias("sitemap_url"), F.lit(1).alias("kind"), F.col("page_id").alias("at"), F.trim("url").alias("loc")) for name, which in _LISTED]
    tree = spark.sql(_TREE.replace("{STR}", "STRING").replace("{TEN}", "SELECT id AS i FROM range(10)").replace("{FIVE}", "SELECT id AS j FROM range(5)"))
    tree = tree.select(F.col("parent").alias("sitemap_url"), F.lit(0).alias("kind"), F.col("position").cast("long").alias("at"), F.col("child").alias("loc"))
    rows = lists[0].unionByName(lists[1]).unionByName(tree)
    entries = F.transform(F.sort_array(F.collect_list(F.struct("kind", "at", "loc"))), lambda e: F.concat(F.when(e["kind"] == 1, "<url><loc>").otherwise("<sitemap><loc>"), _escaped(e["loc"]), F.when(e["kind"] == 1, "</loc></url>").otherwise("</loc></sitemap>")))
    xml = rows.groupBy("sitemap_url").agg(F.concat(F.lit('<m xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(entries, "\n"), F.lit("</m>")).alias("xml"))
    return sitemap_urls(xml)


QUERIES["a3_sitemap_urls"] = a3_sitemap_urls
_DUCK = _TREE.replace("{STR}", "VARCHAR").replace("{TEN}", "SELECT unnest(range(10)) AS i").replace("{FIVE}", "SELECT unnest(range(5)) AS j")
ORACLES["a3_sitemap_urls"] = f"""
WITH RECURSIVE edge AS ({_DUCK}),
own AS (SELECT concat('list', page_id % 10, '-', page_id % 5) AS node, page_id AS i, trim(url) AS url FROM pages WHERE trim(url) <> ''
  UNION ALL SELECT concat('index', page_id % 10) AS node, page_id AS i, trim(url) AS url FROM pages WHERE page_id % 7 = 0 AND trim(url) <> ''),
node AS (SELECT parent AS n FROM edge UNION SELECT node AS n FROM own),
walk AS (
  SELECT n AS root, n AS node, CAST([] AS BIGINT[]) AS path, [n] AS seen FROM node
  UNION ALL SELECT w.root, e.child, list_append(w.path, CAST(e.position AS BIGINT)), list_append(w.seen, e.child)
  FROM walk w JOIN edge e ON e.parent = w.node WHERE e.child IN (SELECT n FROM node) AND NOT list_contains(w.seen, e.child)
),
first_ AS (SELECT root, node, min(path) AS path FROM walk GROUP BY root, node),
place AS (SELECT root, url, min(list_append(path, CAST(i + 1099511627776 AS BIGINT))) AS spot FROM first_ JOIN own USING (node) GROUP BY root, url),
r AS (SELECT root, url, row_number() OVER (PARTITION BY root ORDER BY spot) AS position FROM place)
SELECT root AS sitemap_url, CAST(position AS INTEGER) AS position, url FROM r WHERE position <= 500
"""


def c1_replace_in_table(spark, sf_dir):
    """The table of all chunks is written, then every fourth source is replaced in its own folders."""
    path = shared_path(spark, "chunks")
    c = view(spark, sf_dir, "chunks")
    write_chunks(c, path, "overwrite")
    touched = c.where("source_id % 4 = 1")
    replace_chunks(touched.where("source_id % 8 = 1").withColumn("content", F.upper("language")), touched, path)
    return read_chunks(spark, path).select("source_type", "source_id", "content")


QUERIES["c1_replace_in_table"] = c1_replace_in_table
ORACLES["c1_replace_in_table"] = ORACLES["c1_replace_source_chunks"]
