"""Queries of the filter audit, the quality classifier and the clustering of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm.common import table


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.filter_audit import audit_table

    return audit_table(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


_RUN = "[\\x20\\x09-\\x0D]+"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_RUN}'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS bad
  FROM w LEFT JOIN l USING (doc_id)
),
f AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) AS v(i, c)),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS ord
  FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
s AS (SELECT filter_order, ord, unnest([1, 2, 3, 4, 5]) AS step FROM o),
k AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, bad),
x AS (
  SELECT part, filter_order, step, ord[step] AS filter, n, good, toxic, bad[ord[step]] AS fails,
    len(list_filter(ord[1:step - 1], lambda i: bad[i])) > 0 AS earlier, len(list_filter(bad, lambda b: b)) AS fails_of
  FROM k, s
),
g AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (fails AND fails_of = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM g
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.byte_cnn import predict, train

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    network = train(docs.where(~held_out), labels.where(~held_out))
    return predict(docs, network).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.centroids import lloyd

    return lloyd(table(spark, sf_dir, "embeddings"))


def _rounds(n: int) -> str:
    """Lloyd's rounds as one chain of tables: a0, c1, a1, ... of assignments and centroids."""
    nearest = """a{r} AS MATERIALIZED (SELECT id, vec_id, x, c AS cluster, dist FROM (
  SELECT v.*, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM v, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, c) = 1)"""
    moved = """c{s} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT cluster, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(x) AS y FROM a{r}) GROUP BY cluster, i)
  GROUP BY cluster) m ON m.cluster = c.c)"""
    return ",\n".join(x for r in range(n) for x in (nearest.format(r=r), moved.format(r=r, s=r + 1))) + ",\n" + nearest.format(r=n)


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda y: CAST(floor(1024 * y) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND NOT isnan(y) AND NOT isinf(y))) = 64
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS c, x FROM (SELECT *, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v) ORDER BY h, vec_id LIMIT 8),
{_rounds(10)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON c10.c = cluster
"""

QUERIES = {f.__name__: f for f in (op11_filter_audit, op12_quality_classifier, op13_centroids)}
ORACLES = {"op11_filter_audit": OP11_SQL, "op13_centroids": OP13_SQL}
