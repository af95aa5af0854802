"""Hybrid retrieval of many queries over many chunks.

Vectors are never shuffled: the query side is broadcast as a matrix in blocks of a fixed size and each
partition of chunks gives its best rows only.  The lexical side is an inverted index (``postings``) with a threshold stop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.functions.tables import stored
from deskmill.functions.text import stems
from deskmill.functions.urls import normalize_url
from deskmill.operators.postings import LexicalIndex, lexical_index, search
from deskmill.operators.records import absolute_url


def cosine(a: Column, b: Column) -> Column:
    """Dot over the shared dimensions; the norm of b over those only; 0 if a norm is 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    n = F.least(F.size(a), F.size(b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    cut_a, cut_b = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(total(F.transform(a, lambda v: v * v))) * F.sqrt(total(F.transform(cut_b, lambda v: v * v)))
    return F.when(norm > 0, total(F.zip_with(cut_a, cut_b, lambda x, y: x * y)) / norm).otherwise(0.0)


def vector_topk(queries: DataFrame, chunks: DataFrame, pool: int = 100, min_score: float = 0.0, site_filter: bool = True, block: int = 2048) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact best chunks by cosine; a null site fits every site."""
    q = queries.where(F.size("vector") > 0).select("query_id", "site_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-q.count() // block))
    parts = [_topk_block(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect(), chunks, pool, min_score, site_filter) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)


def _topk_block(rows: list, chunks: DataFrame, pool: int, min_score: float, site_filter: bool) -> DataFrame:
    width = max([1, *(len(r["vector"]) for r in rows)])
    matrix = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        matrix[i, : len(r["vector"])] = r["vector"]
    norms, widths = np.sqrt((matrix**2).sum(axis=1)), np.array([len(r["vector"]) for r in rows], np.int64)
    anywhere = np.array([r["site_id"] is None for r in rows], bool)
    sites = np.array([r["site_id"] or 0 for r in rows])
    shared = chunks.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], matrix, norms, widths, anywhere, sites))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, norms, widths, anywhere, sites = shared.value
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            v = np.zeros((len(batch), matrix.shape[1]))
            for i, x in enumerate(batch["embedding"]):
                if x is not None:
                    v[i, : min(len(x), v.shape[1])] = x[: v.shape[1]]
            # A chunk's norm is over the dimensions of the query.
            norm = norms[:, None] * np.sqrt(np.cumsum(v**2, axis=1)[:, widths - 1].T)
            score = np.divide(matrix @ v.T, norm, out=np.zeros_like(norm), where=norm > 0)
            shared_chunk = batch["site_id"].isna().to_numpy()
            site = batch["site_id"].fillna(0).to_numpy()
            ok = (score >= min_score) & (norms > 0)[:, None] & np.array([x is not None and len(x) > 0 for x in batch["embedding"]])
            if site_filter:
                ok &= anywhere[:, None] | shared_chunk | (site == sites[:, None])
            qi, ci = np.nonzero(ok)
            kept.append(pd.DataFrame({"q": qi, "chunk_id": batch["id"].to_numpy()[ci], "score": score[qi, ci]}))
            if sum(map(len, kept)) > 4 * pool * len(ids):
                kept = [_best_rows(pd.concat(kept), pool)]
        if kept:
            out = _best_rows(pd.concat(kept), pool)
            yield pd.DataFrame({"query_id": np.array(ids)[out["q"]], "chunk_id": out["chunk_id"].to_numpy(), "score": out["score"].to_numpy()})

    return chunks.select("id", "site_id", "embedding").mapInPandas(best, "query_id long, chunk_id long, score double")


def _best_rows(rows: pd.DataFrame, pool: int) -> pd.DataFrame:
    rows = rows.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return rows[rows.groupby("q").cumcount() < pool]


def corpus_stats(chunks: DataFrame, site_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Document frequencies (stem, df) and totals (docs, total_length) over chunks with a vector in a site's scope."""
    c = chunks.where("embedding IS NOT NULL")
    if site_id is not None:
        c = c.where(F.col("site_id").isNull() | (F.col("site_id") == site_id))
    s = c.select("id", stems(F.col("content")).alias("stems"))
    df = s.select(F.explode(F.array_distinct("stems")).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))
    return df, s.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("stems")), F.lit(0)).alias("total_length"))


def lexical_candidates(queries: DataFrame, chunks: DataFrame | LexicalIndex, pool: int = 100, site_filter: bool = True) -> DataFrame:
    """(query_id, chunk_id, stem, tf, length) of the chunks that share most with a query, by matched stems plus relative frequency."""
    return search(queries, _indexed(chunks, queries), pool, site_filter)


def _indexed(chunks: DataFrame | LexicalIndex, queries: DataFrame) -> LexicalIndex:
    return chunks if isinstance(chunks, LexicalIndex) else lexical_index(chunks, queries)


def bm25(candidates: DataFrame, df: DataFrame, totals: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, bm25)."""
    t = totals.select("docs", F.greatest(F.lit(1e-9), F.when(F.col("docs") > 0, F.col("total_length") / F.col("docs")).otherwise(1.0)).alias("average"))
    c = candidates.join(df, "stem", "left").na.fill(0, ["df"]).crossJoin(F.broadcast(t))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return c.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def scoped_bm25(candidates: DataFrame, queries: DataFrame, chunks: DataFrame | LexicalIndex, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, bm25) with the word statistics of each query's own scope: its site's chunks and those of no site, or all.

    Statistics are counted once by stem and site; a scope is the sum of two of them.
    """
    index = _indexed(chunks, queries)
    by_site = index.frequencies()
    none = F.col("site_id").isNull()
    by_stem = by_site.groupBy("stem").agg(F.sum("df").alias("df_all"), F.coalesce(F.sum(F.when(none, F.col("df"))), F.lit(0)).alias("df_none"))
    own = by_site.where("site_id IS NOT NULL").select("stem", F.col("site_id").alias("scope"), "df")
    sizes = index.sizes
    totals = sizes.agg(*(F.coalesce(F.sum(F.when(only, F.col(c))), F.lit(0)).alias(f"{c}_{name}") for c in ("docs", "words") for name, only in (("all", F.lit(True)), ("none", none))))
    site_totals = sizes.where("site_id IS NOT NULL").select(F.col("site_id").alias("scope"), F.col("docs").alias("docs_own"), F.col("words").alias("words_own"))
    scopes = queries.select("query_id", F.col("site_id").alias("scope")).join(site_totals, "scope", "left").crossJoin(totals)

    def scoped(name: str) -> Column:
        return F.when(F.col("scope").isNull(), F.col(f"{name}_all")).otherwise(F.coalesce(f"{name}_own", F.lit(0)) + F.col(f"{name}_none"))

    scopes = scopes.select("query_id", "scope", scoped("docs").alias("docs"), scoped("words").alias("words"))
    c = candidates.join(scopes, "query_id").join(by_stem, "stem", "left").join(own.withColumnRenamed("df", "df_own"), ["stem", "scope"], "left").na.fill(0, ["df_all", "df_none"])
    df, average = scoped("df"), F.greatest(F.lit(1e-9), F.when(F.col("docs") > 0, F.col("words") / F.col("docs")).otherwise(1.0))
    part = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    return c.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def rrf_fuse(cosine_pool: DataFrame, lexical: DataFrame, rrf_k: int = 60, k: int = 30) -> DataFrame:
    """(query_id, chunk_id, score, fused, rank): reciprocal ranks of both orders summed.

    ``lexical`` has (query_id, chunk_id, bm25, score).  The cosine rank is over the union of both pools; a query without cosine rows
    has no result, one without lexical rows keeps the cosine order.
    """
    live = cosine_pool.select("query_id").distinct()
    a = cosine_pool.select("query_id", "chunk_id", "score")
    l = lexical.join(live, "query_id", "left_semi").select("query_id", "chunk_id", "bm25", F.col("score").alias("l_score"))  # noqa: E741
    u = a.join(l, ["query_id", "chunk_id"], "full").withColumn("score", F.coalesce("score", "l_score"))
    # Rounded, so that the order of a sum's terms doesn't decide between equal chunks.
    by_cosine = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    by_words = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("bm25", 9)), "chunk_id")
    u = u.withColumn("rc", F.row_number().over(by_cosine)).withColumn("rl", F.when(F.col("bm25").isNotNull(), F.row_number().over(by_words)))
    u = u.withColumn("fused", 1 / (rrf_k + F.col("rc")) + F.coalesce(1 / (rrf_k + F.col("rl")), F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), "chunk_id")
    return u.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "fused", "rank")


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 30, min_score: float = 0.0, hybrid: bool = True, site_filter: bool = True, min_pool: int = 100) -> DataFrame:
    """Best chunks of every query by cosine and BM25, fused; word statistics are those of the query's scope."""
    pool = max(k, min_pool)
    # Results are short (queries x pool): stored, they are made once, and joins with chunks broadcast them by their measured size.
    near = stored(vector_topk(queries, chunks, pool, min_score, site_filter), "nearest")
    if not hybrid:
        return near.where(F.col("rank") <= k).select("query_id", "chunk_id", "score", F.lit(None).cast("double").alias("fused"), "rank")
    index = lexical_index(chunks, queries)
    found = lexical_candidates(queries, index, pool, site_filter)
    words = stored(scoped_bm25(found, queries, index) if site_filter else bm25(found, *corpus_stats(chunks)), "bm25")
    # Only the pool's chunks carry their vectors along.
    words = words.join(chunks.select(F.col("id").alias("chunk_id"), "embedding"), "chunk_id").join(queries.select("query_id", "vector"), "query_id")
    words = words.select("query_id", "chunk_id", "bm25", cosine(F.col("vector"), F.col("embedding")).alias("score"))
    return stored(rrf_fuse(near, words, k=k), "hits")


def mmr_rerank(candidates: DataFrame, limit: int = 5, lam: float = 0.7) -> DataFrame:
    """(query_id, chunk_id, score, pick) by maximal marginal relevance over (query_id, chunk_id, score, rank, embedding); pools are short by construction."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        chosen: list[int] = list(range(len(rows))) if len(rows) <= limit else []
        if not chosen:
            width = max([1, *(len(v) for v in rows["embedding"] if v is not None)])
            m = np.zeros((len(rows), width))
            for i, v in enumerate(rows["embedding"]):
                if v is not None:
                    m[i, : len(v)] = v
            norm = np.sqrt((m**2).sum(axis=1))
            unit = np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)
            closest = np.zeros(len(rows))
            open_ = np.ones(len(rows), bool)
            while len(chosen) < limit:
                value = np.where(open_, lam * rows["score"].to_numpy() - (1 - lam) * closest, -np.inf)
                best = int(value.argmax())
                chosen.append(best)
                open_[best] = False
                closest = np.maximum(closest, unit @ unit[best])
        out = rows.loc[chosen[:limit], ["query_id", "chunk_id", "score"]]
        return out.assign(pick=range(1, len(out) + 1))

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id long, score double, pick int")


def score_gate(hits: DataFrame, queries: DataFrame, min_similarity: float = 0.35, relative_floor: float = 0.7) -> DataFrame:
    """Per query: confidence (best cosine) and how many hits reach the floor; queries without hits stay."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("confidence"))
    h = hits.join(top, "query_id").where(F.col("score") >= F.greatest(F.lit(min_similarity), F.col("confidence") * relative_floor))
    n = h.groupBy("query_id").agg(F.count("*").alias("context_chunks"))
    return queries.select("query_id").join(top, "query_id", "left").join(n, "query_id", "left").select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("context_chunks", F.lit(0)).alias("context_chunks"))


def source_urls(hits: DataFrame, tracked: DataFrame, elements: DataFrame, urls: DataFrame) -> DataFrame:
    """``hits`` (with source_type, source_id) and the ``url`` of each source that has a public page, else null.

    Entries and categories go by ``tracked`` (source_type, id, element_id, site_id) to the live element (id, site_id, status, date_deleted,
    url) of that site, if its URL is absolute; url sources by ``urls`` (id, url); other kinds have none.
    """
    e = elements.where("status = 'live' AND date_deleted IS NULL").select(F.col("id").alias("element_id"), "site_id", absolute_url(F.col("url")).alias("url"))
    pages = tracked.where(F.col("source_type").isin("entry", "category")).join(e, ["element_id", "site_id"])
    own = urls.select(F.lit("url").alias("source_type"), "id", "url")
    places = pages.select("source_type", "id", "url").unionByName(own).where("url <> ''").withColumnRenamed("id", "source_id")
    return hits.drop("url").join(places, ["source_type", "source_id"], "left")


def assemble_context(hits: DataFrame) -> DataFrame:
    """(query_id, context, allowed_urls) of (query_id, rank, source_type, content, url): numbered blocks in rank order, and normalized URLs."""
    w = Window.partitionBy("query_id").orderBy("rank")
    h = hits.withColumn("i", F.row_number().over(w))
    head = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] ("), "source_type", F.lit(")"), F.coalesce(F.concat(F.lit(" URL: "), "url"), F.lit("")))
    h = h.withColumn("block", F.concat(head, F.lit("\n"), "content"))
    g = h.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "block"))).alias("b"), F.sort_array(F.collect_set(normalize_url(F.col("url")))).alias("allowed_urls"))
    return g.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"), "allowed_urls")


def retrieval_report(hits: DataFrame, chunks: DataFrame, floor: float = 0.35) -> DataFrame:
    """A line per hit: rank, cosine, whether it is below the floor, source and a snippet."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.concat("source_type", F.lit("#"), F.col("source_id").cast("string")).alias("source"), F.substring(F.btrim(F.regexp_replace("content", r"[ \t\n\r\f\x0b]+", " ")), 1, 160).alias("snippet"))
    return hits.join(c, "chunk_id").select("query_id", "rank", F.round("score", 4).alias("cosine"), (F.col("score") < floor).alias("below_floor"), "source", "snippet")
