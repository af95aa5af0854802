"""Quality rules by cross-document line frequency, with DataFrame functions only.

Lines are normalised (case, digits, white space) and hashed, and for every host the documents that have a line are
counted.  A line goes from its host's documents when it is in more than ``max_share`` of them, in more than
``min_documents``, and in as many different texts (so copies of one text don't condemn its lines: they are
duplicates).  A document that keeps less than ``min_kept`` of its words is rejected, as is one that fails the base rules.

Line rows are small (two hashes, a position and a count), counts are combined before the shuffle,
and the join back to lines is one that Spark splits where a line is frequent.

Cases: a null or blank text has no words and fails the base rules; a null host is a host of its own;
repeated rows are documents of their own and get the same result each; a very long text is one row, whose lines
are rows of their own; an empty table gives no rows; columns of the input keep their values, whatever their
names, for the result is one struct column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import SPACE_CLASS, free_name

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def base_metrics(docs: DataFrame, text: str, min_words: int, max_repeat_percent: int) -> DataFrame:
    """``docs`` with the per-document base metrics; working columns start with ``_``."""
    d = docs.withColumn("_words", words_of(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("_windows", F.expr("CASE WHEN n_words < 3 THEN array() ELSE transform(sequence(0, int(n_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"))
    # Only texts in which a window comes again are sorted.
    d = d.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h, i))) ELSE array() END"))
    d = d.withColumn("_again", F.expr("sort_array(transform(filter(_sorted, (x, j) -> x.h <=> get(_sorted, j - 1).h OR x.h <=> get(_sorted, j + 1).h), x -> x.i))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(_again, struct(-3 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n)"))
    lines = F.filter(F.split(F.col(text).cast("string"), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    d = d.withColumn("_lines", F.coalesce(lines, F.array().cast("array<string>")))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return d.drop("_words", "_windows", "_sorted", "_again", "_lines")


def removed_lines(docs: DataFrame, max_share: float, min_documents: int) -> DataFrame:
    """Per document (key) of ``docs`` (key, host, text): words and positions of the lines that are too frequent on its host."""
    lines = docs.select("key", "host", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("key", "host", "pos", F.size(words_of(F.col("line"))).alias("n"), F.xxhash64(normalised("line")).alias("hash")).where("n > 0")
    # A document's own repeats of a line count once.
    own = docs.select("host", F.col("key.text_hash").alias("text_hash"), F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.size(words_of(x)) > 0), lambda x: F.xxhash64(normalised(x))))).alias("hash"))
    counts = own.groupBy("host", "hash", "text_hash").agg(F.count("*").alias("n")).groupBy(F.col("host").alias("h"), F.col("hash").alias("l")).agg(F.sum("n").alias("documents"), F.count("*").alias("texts"))
    hosts = docs.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("all"))
    many = (F.col("documents") > min_documents) & (F.col("texts") > min_documents)
    frequent = counts.where(many).join(hosts, F.col("h").eqNullSafe(F.col("of"))).where(F.col("documents") > max_share * F.col("all")).select("h", "l")
    gone = lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("hash") == F.col("l")), "left_semi")
    # A set, so that repeated rows of one document do not add up; it is as long as the document has lines.
    gone = gone.groupBy("key").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    return gone.select("key", F.expr("aggregate(gone, 0L, (a, x) -> a + x.n)").alias("removed_words"), F.expr("transform(gone, x -> x.pos)").alias("positions"))


def normalised(line: str | Column) -> Column:
    x = F.regexp_replace(F.lower(F.btrim(F.col(line) if isinstance(line, str) else line, F.lit(" \t\n\x0b\f\r"))), SPACE_CLASS + "+", " ")
    return F.regexp_replace(x, "[0-9]", "0")


def line_frequency_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_share: float = 0.05, min_documents: int = 5, min_kept: float = 0.8, min_words: int = 50, max_repeat_percent: int = 50, into: str | None = None) -> DataFrame:
    """``docs`` and a struct column ``into`` (by default ``quality``): METRICS, removed_words, kept, and text_kept without the removed lines."""
    into = into or free_name(docs, "quality")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    d = docs.select(row, F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    d = d.withColumn("key", F.struct("id", F.xxhash64("text").alias("text_hash"))).drop("id")
    gone = removed_lines(d.drop("row"), max_share, min_documents)
    # Small rows per text; the aggregate also keeps filters on the verdict from being pushed into the metrics' expressions.
    base = base_metrics(d.select("key", "text"), "text", min_words, max_repeat_percent)
    base = base.groupBy("key").agg(*(F.first(c).alias(c) for c in METRICS))
    verdict = base.join(gone.withColumnRenamed("key", "gone_key"), same("key", "gone_key"), "left").drop("gone_key")
    verdict = verdict.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    verdict = verdict.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_kept * F.col("n_words")))
    both = d.join(verdict.withColumnRenamed("key", "found"), same("key", "found"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("positions", i)), "\n")
    text_kept = F.when(F.col("positions").isNull(), F.col("text")).otherwise(kept).alias("text_kept")
    return both.select("row.*", F.struct(*METRICS, "removed_words", "kept", text_kept).alias(into))


def same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}.text_hash").eqNullSafe(F.col(f"{b}.text_hash"))
