"""An impact-ordered inverted index of chunks, and an exact search of it that stops at a threshold.

The score of a chunk is the number of a query's stems in it plus their share of its words.  A chunk with ``width``
distinct stems can't match more than those, so the width is the impact that orders postings: they lie in blocks by
stem, site and band of width, and the header of a stem has for each of its blocks the largest width and the largest share.

A search has three steps.  (1) A pilot: the widest postings of a query's most frequent stems are scored in full, and
the pool-th best of them is a threshold that no chunk of the answer is below.  (2) Stems are taken from the rarest on
only until the rest together can't reach the threshold, of their blocks only those whose maxima can reach it, and of
the chunks found only those with enough matches among these stems.  (3) What is left is scored in full.  Every bound is
an upper one, so the answer is that of a full scan; a query whose pilot finds less than a pool reads all its postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.functions.tables import stored
from deskmill.functions.text import stems

#: Widths of one band differ by less than this factor.
_BAND = 1.2
#: Chunks beyond which a block is cut by the hash of its chunks.
_CUT = 1 << 16
#: Stems that are read beyond the needed ones: each asks one match more of a chunk, so fewer chunks are scored in full.
EXTRA = 4
#: Sums of shares are rounded to nine places before they are compared.
_SLACK = 1e-8


@dataclass
class LexicalIndex:
    """postings (stem, band, cut, chunk_id, site_id, tf, length, width), headers (stem, blocks), sizes (site_id, docs, words)."""

    postings: DataFrame
    headers: DataFrame
    sizes: DataFrame

    def frequencies(self) -> DataFrame:
        """(stem, site_id, df)."""
        return self.postings.groupBy("stem", "site_id").agg(F.count("*").alias("df"))


def _band(width: Column) -> Column:
    return F.floor(F.log(width) / F.log(F.lit(_BAND))).cast("int")


def _terms(stems: Column) -> Column:
    """(stem, tf) of each distinct stem, within the row: runs of the sorted stems, so that no word is shuffled to be counted."""
    runs = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    counted = lambda x: F.transform(x["at"], lambda p, k: F.struct(F.get(x["s"], p).alias("stem"), (F.coalesce(F.get(x["at"], k + 1), F.size(x["s"])) - p).cast("long").alias("tf")))
    # Sorted stems and the starts of their runs as one value each, so that they are made once.
    both = F.transform(F.array(F.sort_array(stems)), lambda s: F.struct(s.alias("s"), F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<int>")).alias("at")))
    return F.transform(both, counted)[0]


def query_stems(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("site_id").alias("q_site"), F.explode(F.array_distinct(stems(F.col("text")))).alias("stem"))


def lexical_index(chunks: DataFrame, queries: DataFrame | None = None, text: str = "content") -> LexicalIndex:
    """The index of chunks that have a vector; with ``queries`` only of the stems that occur in them."""
    words = chunks.where("embedding IS NOT NULL").select(F.col("id").alias("chunk_id"), "site_id", stems(F.col(text)).alias("stems"))
    words = stored(words.select("*", F.size(F.array_distinct("stems")).alias("width")), "stems")
    sizes = words.groupBy("site_id").agg(F.count("*").alias("docs"), F.sum(F.size("stems")).alias("words"))
    cuts = F.lit(1 + words.count() // _CUT)
    postings = words.select("chunk_id", "site_id", F.greatest(F.lit(1), F.size("stems")).alias("length"), "width", F.explode(_terms(F.col("stems"))).alias("t")).select("*", "t.stem", "t.tf")
    if queries is not None:
        # Stored, so that Spark broadcasts it by its measured size; else every stem of every chunk would be shuffled.
        vocabulary = stored(query_stems(queries).select("stem").distinct(), "vocabulary")
        postings = postings.join(vocabulary, "stem", "left_semi")
    postings = stored(postings.select("stem", _band(F.col("width")).alias("band"), F.pmod(F.xxhash64("chunk_id"), cuts).alias("cut"), "chunk_id", "site_id", "tf", "length", "width"), "postings")
    blocks = postings.groupBy("stem", "site_id", "band", "cut").agg(F.count("*").alias("n"), F.max("width").alias("width"), F.max(F.col("tf") / F.col("length")).alias("share"))
    block = F.struct("width", "band", "cut", "site_id", "share", "n")  # in this order: the widest first
    headers = stored(blocks.groupBy("stem").agg(F.sort_array(F.collect_list(block), asc=False).alias("blocks")), "headers")
    return LexicalIndex(postings, headers, stored(sizes, "sizes"))


def _words(queries: DataFrame, index: LexicalIndex, site_filter: bool) -> DataFrame:
    """(query_id, stem, blocks, df, share): the stems of each query that the index has, with their blocks in its scope."""
    w = query_stems(queries).join(index.headers.select("stem", "blocks"), "stem")
    if site_filter:
        w = w.withColumn("blocks", F.filter("blocks", lambda b: F.col("q_site").isNull() | b["site_id"].isNull() | (b["site_id"] == F.col("q_site"))))
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    return w.select("query_id", "stem", "blocks", total.alias("df"), F.array_max(F.transform("blocks", lambda b: b["share"])).alias("share")).where("df > 0")


def _read(wanted: DataFrame, index: LexicalIndex) -> DataFrame:
    """Postings of the wanted blocks ``b`` of (query_id, stem, b, ...)."""
    others = [c for c in wanted.columns if c not in ("stem", "b")]
    w = wanted.select(*others, "stem", "b.band", "b.cut", F.col("b.site_id").alias("site"))
    p = index.postings.withColumnRenamed("stem", "word").withColumnRenamed("band", "in_band").withColumnRenamed("cut", "in_cut")
    same = (F.col("word") == F.col("stem")) & (F.col("in_band") == F.col("band")) & (F.col("in_cut") == F.col("cut")) & F.col("site_id").eqNullSafe(F.col("site"))
    return w.join(p, same).select(*others, "stem", "chunk_id", "width")


def _scored(pairs: DataFrame, words: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, chunk_id, proxy, terms) of pairs (query_id, chunk_id): all matches of each.

    Pairs meet all postings of their chunk, and those stay that the query has too, by a broadcast of the queries' stems:
    so a pair is shuffled as one row, not once for each stem of its query, and its matches are summed where they are found.
    """
    p = index.postings.select("chunk_id", "stem", "tf", "length")
    found = pairs.join(p, "chunk_id").join(F.broadcast(words.select("query_id", "stem")), ["query_id", "stem"], "left_semi")
    return found.groupBy("query_id", "chunk_id").agg(_proxy().alias("proxy"), F.collect_list(F.struct("stem", "tf", "length")).alias("terms"))


def _proxy() -> Column:
    return F.round(F.count("*") + F.sum(F.col("tf") / F.col("length")), 9)


def _pilot(words: DataFrame, index: LexicalIndex, pool: int, frequent: int = 4) -> DataFrame:
    """(query_id, chunk_id): chunks that a query probably ranks high.  Any choice gives a right threshold."""
    by_df = Window.partitionBy("query_id").orderBy(F.desc("df"), "stem")
    often = words.withColumn("r", F.row_number().over(by_df)).where(F.col("r") <= frequent)
    # The widest blocks of a stem, until they hold twice a pool.
    before = lambda i: F.aggregate(F.slice("blocks", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b["n"])
    often = often.select("query_id", "stem", F.explode(F.filter("blocks", lambda b, i: before(i) < 2 * pool)).alias("b"))
    hits = _read(often, index).groupBy("query_id", "chunk_id", "width").agg(F.count("*").alias("m"))
    best = Window.partitionBy("query_id").orderBy(F.desc("m"), F.desc("width"), "chunk_id")
    return hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= pool + pool // 2).select("query_id", "chunk_id")


def thresholds(words: DataFrame, index: LexicalIndex, pool: int) -> DataFrame:
    """(query_id, floor): no chunk of the query's best ``pool`` has a smaller score; 0 where the pilot found too few."""
    found = _scored(_pilot(words, index, pool), words, index).groupBy("query_id").agg(F.sort_array(F.collect_list("proxy"), asc=False).alias("best"))
    return found.select("query_id", F.coalesce(F.get("best", F.lit(pool - 1)), F.lit(0.0)).alias("floor"))


def essential(words: DataFrame, floor: DataFrame, extra: int = EXTRA) -> DataFrame:
    """(query_id, stem, blocks, least, floor): the rarest stems of a query without which no chunk reaches its floor, ``extra``
    more, and the matches among all these that a chunk needs at least."""
    rarest = Window.partitionBy("query_id").orderBy("df", "stem")
    rest = rarest.rowsBetween(0, Window.unboundedFollowing)
    w = words.join(floor, "query_id", "left").na.fill(0.0, ["floor"])
    w = w.withColumn("left", F.count("*").over(rest)).withColumn("reach", F.col("left") + F.least(F.lit(1.0), F.sum("share").over(rest)))
    # A stem and those after it (rarest first) reach the floor together: a chunk may have no other.
    needed = F.min(F.when(F.col("reach") >= F.col("floor") - _SLACK, F.col("left"))).over(Window.partitionBy("query_id"))
    others = F.greatest(F.lit(0), needed - 1 - extra)
    w = w.withColumn("others", others).where(F.col("left") > F.col("others"))
    return w.select("query_id", "stem", "blocks", F.greatest(F.lit(1), F.ceil(F.col("floor") - _SLACK - 1 - F.col("others"))).alias("least"), "floor")


def survivors(words: DataFrame, index: LexicalIndex, floor: DataFrame, extra: int = EXTRA) -> DataFrame:
    """(query_id, chunk_id) of chunks that may reach the floor of a query."""
    # A chunk matches at most its width, and its shares are at most 1 together.
    e = essential(words, floor, extra)
    e = e.select("query_id", "stem", "least", "floor", F.explode("blocks").alias("b")).where(F.col("b.width") + 1 >= F.col("floor") - _SLACK)
    hits = _read(e, index).where(F.col("width") + 1 >= F.col("floor") - _SLACK)
    return hits.groupBy("query_id", "chunk_id").agg(F.count("*").alias("m"), F.first("least").alias("least")).where("m >= least").select("query_id", "chunk_id")


def search(queries: DataFrame, index: LexicalIndex, pool: int, site_filter: bool = True) -> DataFrame:
    """(query_id, chunk_id, stem, tf, length) of the ``pool`` chunks with the best score, the smaller id first among equals."""
    words = stored(_words(queries, index, site_filter), "query-stems")
    floor = stored(thresholds(words, index, pool), "floors")
    found = _scored(survivors(words, index, floor), words, index)
    best = Window.partitionBy("query_id").orderBy(F.desc("proxy"), "chunk_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= pool)
    return found.select("query_id", "chunk_id", F.explode("terms").alias("t")).select("query_id", "chunk_id", "t.*")
