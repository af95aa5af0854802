"""URL filters by association rules, with DataFrame functions and Spark's FP-growth.

URLs become sets of tokens (host, its labels cut at hyphens, path words, file ending, query keys).  Spark FP-growth mines
the sets that are frequent among URLs with a bad label; each set's count among all labelled URLs, by an inverted
index, gives its confidence.  A set is a rule by support, confidence, lift and significance: with m
candidate sets, the chance that unrelated labels give as many bad rows, bounded by Chernoff, times m is
``max_false_rules`` at most.  A rule goes when a part of it is as confident.  Matching is an inverted index too:
every rule is listed under each of its tokens, a URL's tokens are joined to it, and a rule fits when all its tokens were met.

Only tokens that some rule may hold are mined: those in as many bad rows as a rule needs, and of tokens that are
in the same rows one, which stands for all.  There are at most (tokens of a URL) / ``min_support`` of them at any size of the table.

Listed rules come first: (host, path) rules fit the host, its subdomains and paths that start with
theirs; the longest wins.  They are looked up through the host's suffixes, so lists of any size work.

Cases: a null URL, or one without ``://``, has an empty host and path, no tokens and is allowed; null labels are not
bad; repeated rows are judged each; without labelled rows, or where bad rows are too many for the lift, there are no mined rules;
a URL of very many dots has as many suffixes as the longest listed host has labels; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm.common import checkpoint


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: what may tell good hosts and paths from bad ones; numbers are one token."""
    host, path = host_of(url), path_of(url)
    parts = F.transform(F.filter(F.split(host, r"[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("part="), x))
    words = F.filter(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), "[/._-]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.concat(F.lit("path="), x))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)="), F.lit(1))
    query = F.transform(query, lambda x: F.concat(F.lit("query="), x))
    tokens = F.array_distinct(F.concat(F.array(F.concat(F.lit("host="), host)), parts, words, query))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tokens)


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 2.0, max_tokens: int = 3, max_false_rules: float = 1.0) -> DataFrame:
    """Rules (rule_id, tokens, support, confidence) from ``labelled`` (url, bad boolean)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, support double, confidence double")
    rows = labelled.select(url_tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")).where(F.size("tokens") > 0)
    total = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    if not total["bad"] or min_lift * total["bad"] > total["n"]:
        return empty
    base = total["bad"] / total["n"]
    rows = checkpoint(rows.repartition(1 + total["n"] // 20_000).withColumn("id", F.monotonically_increasing_id()))
    each = rows.select("id", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("k"), F.bit_xor(F.xxhash64("id")).alias("where"))
    frequent = checkpoint(each.where(F.col("k") >= min_support * total["n"]).groupBy("n", "k", "where").agg(F.min("token").alias("token"), F.collect_set("token").alias("same")))
    # A rule of k bad rows has a chance of base ** k at least, and the tokens are some of the candidates.
    least = max(1, math.ceil(min_support * total["n"]), math.ceil(math.log(max(1, frequent.count()) / max_false_rules) / -math.log(base)))
    frequent = frequent.where(F.col("k") >= least)
    items = rows.where("bad").select("id", F.explode("tokens").alias("token")).join(frequent.select("token"), "token").groupBy("id").agg(F.collect_list("token").alias("items"))
    items = checkpoint(items.select("items"))
    n_items = items.count()
    if not n_items:
        return empty
    # Half a row less, so that rounding keeps sets of just ``least`` rows.
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_items).fit(items).freqItemsets
    sets = checkpoint(sets.where(F.size("items") <= max_tokens).select(F.sort_array("items").alias("tokens"), F.col("freq").alias("k")))
    # Every set is looked for where its rarest token is.
    rarest = sets.withColumn("token", F.explode("tokens")).join(frequent.select("token", "n"), "token").groupBy("tokens", "k").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    met = rows.select(F.col("tokens").alias("all"), F.explode("tokens").alias("token")).join(rarest, "token").where(F.size(F.array_except("tokens", "all")) == 0)
    counted = met.groupBy("tokens", "k").agg(F.count("*").alias("n"))
    share = F.col("k") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    chance = F.exp(-F.col("n") * (share * F.log(share / base) + rest))
    rules = counted.where((share >= max(min_confidence, min_lift * base)) & (chance * sets.count() <= max_false_rules))
    rules = checkpoint(rules.select("tokens", (F.col("k") / total["n"]).alias("support"), share.alias("confidence")))
    # A rule goes when a part of it is as confident; parts share a token, so they meet in an index.
    index = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("less"), F.col("confidence").alias("c"))
    beaten = rules.withColumn("token", F.explode("tokens")).join(index, "token").where((F.size("less") < F.size("tokens")) & (F.size(F.array_except("less", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))).select("tokens").distinct()
    rules = rules.join(beaten, "tokens", "left_anti")
    # What holds for a token holds for those in the same rows: each makes a rule of its own.
    same = rules.select("tokens", F.explode("tokens").alias("token")).join(frequent.select("token", "same"), "token").groupBy("tokens").agg(F.collect_list("same").alias("same"))
    rules = rules.join(same, "tokens")
    for i in range(max_tokens):
        rules = rules.withColumn(f"t{i}", F.explode_outer(F.get("same", F.lit(i))))
    tokens = F.sort_array(F.array_compact(F.array(*(f"t{i}" for i in range(max_tokens)))))
    return rules.select(tokens.alias("tokens"), "support", "confidence").select(F.xxhash64("tokens").alias("rule_id"), "tokens", "support", "confidence")


def match_rules(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Keys of the pages whose tokens hold all tokens of some rule."""
    index = rules.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("wanted"))
    tokens = pages.select(key, F.explode(url_tokens(F.col("url"))).alias("token"))
    met = tokens.join(index, "token").groupBy(key, "rule_id", "wanted").agg(F.countDistinct("token").alias("n"))
    return met.where("n = wanted").select(key).distinct()


def listed_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A frame of (host, path, verdict) rules; paths begin with ``/``."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def judge_urls(pages: DataFrame, listed: DataFrame, mined: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule (``host + path`` of the listed rule) and verdict."""
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # One lookup per distinct host and path: a host's suffixes are its possible rule hosts.
    places = p.select("host", "path").distinct()
    longest_rule = listed.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    labels = F.split("host", r"\.")
    n = F.least(F.size(labels), F.lit(longest_rule))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    fits = places.select("host", "path", F.explode(suffixes).alias("suffix")).join(listed, F.col("suffix") == F.col("rule_host")).where(F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    longest = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("length"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    longest = longest.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best.rule", F.col("best.verdict").alias("_verdict"))
    urls = match_rules(p.select("url").where("url IS NOT NULL").distinct(), mined, "url").select(F.col("url").alias("_url"))
    out = p.join(longest, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").join(urls, F.col("url") == F.col("_url"), "left")
    verdict = F.coalesce("_verdict", F.when(F.col("_url").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
