"""Queries of sources, texts, chunks and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions import text as T
from deskmill.functions.urls import audit_links, normalize_url, og_meta
from deskmill.functions.vectors import pack_vector, unpack_vector
from deskmill.operators.chunking import chunk_text
from deskmill.operators.embed import embed_chunks
from deskmill.operators.index import contextualize
from deskmill.operators.records import labelled_text, validate_submissions
from deskmill.plans.core_queries import query as _query
from deskmill.plans import core_queries
from deskmill.plans.views import view
from deskmill.sources.chunks import chunk_rows
from deskmill.sources.files import page_text, rendered_text

query = _query


@query(None, "pages")
def a1_page_text(p):
    return page_text(p)


@query(None, "pages")
def a1_page_text_region(p):
    return page_text(p, region=True)


@query("SELECT vec_id, embedding FROM embeddings", "embeddings")
def a7_vector_round_trip(e):
    return e.select("vec_id", unpack_vector(pack_vector(F.col("embedding"))).alias("embedding"))


@query("SELECT source_type, source_id, site_id, position, content, CAST(ceil(length(content)/4.0) AS BIGINT) AS tokens, CAST(4*len(embedding) AS INTEGER) AS bytes FROM chunks", "chunks")
def a8_chunk_rows(c):
    return chunk_rows(c).withColumn("bytes", F.octet_length("vector")).drop("vector")


@query(None, "pages")
def b3_normalize_text(p):
    return p.select("page_id", T.normalize_text(F.col("html")).alias("text"))


@query(None, "pages")
def b5_og_meta(p):
    return p.select("page_id", F.to_json(og_meta(F.col("html"))).alias("meta"))


@query("SELECT p_partkey AS id, 'Title: '||p_name||chr(10)||chr(10)||'Brand: '||p_brand||chr(10)||chr(10)||'P size: '||p_size AS text FROM part", "part")
def b7_labelled_text(p):
    return labelled_text(p, "p_partkey", "p_name", None, ["p_brand", "p_type", "p_size"], {"p_brand": "Brand"}, ("p_type",))


@query("""SELECT c_custkey AS id, 'Title: '||c_name||CASE WHEN c_custkey%2=1 THEN chr(10)||'URL: https://example.com/c/'||c_custkey ELSE '' END||chr(10)||'Section: '||c_mktsegment
||CASE WHEN c_mktsegment<>'BUILDING' THEN chr(10)||chr(10)||'Nation:'||chr(10)||n_name||chr(10)||'Lies In: '||r_name ELSE '' END
||chr(10)||chr(10)||'Segment: '||CASE WHEN c_custkey%3=0 THEN 'trade of '||lower(c_mktsegment) ELSE c_mktsegment END||CASE WHEN c_custkey%5<>0 THEN chr(10)||chr(10)||'Photos: front of '||c_name ELSE '' END AS text
FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey""", "customer", "nation", "region")
def b7_related_text(c, n, r):
    n = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.array(F.struct(F.col("n_name").alias("title"), F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("r_name").alias("value"))).alias("liesIn"))).alias("nation"))
    option = F.struct(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("trade of "), F.lower("c_mktsegment"))).alias("label"), F.col("c_mktsegment").alias("value"))
    asset = F.struct(F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("front of "), "c_name")).alias("alt"), F.concat(F.lit("IMG_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("title"))
    d = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).withColumns({"segment": option, "photos": F.array(asset)})
    d = d.withColumn("url", F.concat(F.when(F.col("c_custkey") % 2 == 1, "https://example.com").otherwise(""), F.lit("/c/"), F.col("c_custkey").cast("string")))
    return labelled_text(d, "c_custkey", "c_name", "url", ["nation", "segment", "photos"], header={"Section": "c_mktsegment"}, excluded={"BUILDING": ("nation",)}, scope="c_mktsegment")


@query(None, "part", "pages")
def a1_rendered_records(d, p):
    d = d.join(p.select(F.col("page_id").alias("p_partkey"), "url"), "p_partkey", "left")
    return rendered_text(d, p, "p_partkey", "p_name", "url", ["p_brand", "p_type"], header={"Section": "p_type"})


@query(None, "documents")
def b9_chunk_text(d):
    return chunk_text(d.select("doc_id", "text"))


@query(None, "documents")
def b11_embed_chunks(d):
    return embed_chunks(chunk_text(d.select("doc_id", "text")).repartition("doc_id", "position"))


@query("""SELECT page_id, regexp_extract(url,'^([a-z]+)://',1)||'://'||regexp_extract(url,'^[a-z]+://([^/?#:]+)',1)||rtrim(regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1),'/')||regexp_extract(url,'^[^?#]*(\\?[^#]+)',1) AS url FROM pages""", "pages")
def e19_normalize_url(p):
    return p.select("page_id", normalize_url(F.col("url")).alias("url"))


@query("""+l AS (SELECT page_id AS message_id, url, regexp_extract(url,'^[a-z]+://([^/?#:]+)',1) AS host FROM pages)
SELECT message_id, url, CASE WHEN host NOT IN (SELECT regexp_extract(url,'^[a-z]+://([^/?#:]+)',1) FROM pages WHERE contains(url, '.com')) THEN 'offsite' WHEN message_id%2=0 THEN 'ok' ELSE 'denied' END AS verdict FROM l""", "pages")
def e20_audit_links(p):
    hosts = p.where(F.contains("url", F.lit(".com"))).select(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host")).distinct()
    replies = p.select(F.col("page_id").alias("message_id"), F.concat(F.lit("See "), "url", F.lit(" there.")).alias("reply"))
    allowed = p.where("page_id % 2 = 0").select(F.col("page_id").alias("message_id"), "url")
    return audit_links(replies, allowed, hosts)


@query(None, "submissions")
def e22_validate_submissions(s):
    spark = s.sparkSession
    fields = spark.createDataFrame([(f"form{i}", "k", kind, True, None, None) for i, kind in enumerate(("number", "email", "text"))], "form_name string, name string, type string, required boolean, options array<string>, value string")
    return validate_submissions(s, fields).select("id", F.to_json("values").alias("values"), "missing", "invalid")


def w1_corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents to clean, overlapping chunks with their place in front."""
    pages = page_text(view(spark, sf_dir, "pages"), region=True).select(F.col("url").alias("source"), "title", "text")
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("").alias("title"), T.normalize_text(F.col("text")).alias("text"))
    return contextualize(chunk_text(pages.unionByName(docs)))


core_queries.QUERIES["w1_corpus_build"] = w1_corpus_build
