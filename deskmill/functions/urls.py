"""URLs in replies and pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URL = r"https?://[^\s<>()\[\]\"']+"


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, path without its last slash, query kept; port and fragment go."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    return F.when(host == "", F.rtrim(url, F.lit("/"))).otherwise(F.concat(scheme, F.lit("://"), host, path, query))


def og_meta(page: Column) -> Column:
    """Map of a page's meta properties; the first value of a key wins."""

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        import html

        def one(text: str | None) -> dict | None:
            found: dict[str, str] = {}
            for tag in re.findall(r"(?is)<meta\b[^>]*>", text or ""):
                a = {k.lower(): (x or y or z) for k, x, y, z in re.findall(r"""(?is)([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag)}
                key = (a.get("property") or a.get("name") or "").lower().strip()
                if key and "content" in a:
                    found.setdefault(key, html.unescape(a["content"]).strip())
            return found

        return s.map(one)

    return run(page)


def og_image(page: Column, url: Column) -> Column:
    """The page's image, made absolute against the page's origin."""
    m = og_meta(page)
    raw = F.coalesce(*(F.when(m[k] != "", m[k]) for k in ("og:image", "og:image:url", "og:image:secure_url")))
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.when(F.startswith(raw, F.lit("//")), F.concat(scheme, F.lit(":"), raw)).when(F.rlike(raw, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), raw).when(F.startswith(raw, F.lit("/")), F.concat(origin, raw)).otherwise(F.concat(origin, F.lit("/"), raw))


def audit_links(replies: DataFrame, allowed: DataFrame, hosts: DataFrame | list[str]) -> DataFrame:
    """(message_id, url, verdict) of each link of replies (message_id, reply) against allowed (message_id, url): ok, denied or offsite.

    ``hosts``, the site's own, is a list or a frame (host).
    """
    if not isinstance(hosts, DataFrame):
        hosts = replies.sparkSession.createDataFrame([(h,) for h in hosts], "host string")
    links = replies.select("message_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("reply", F.lit(_URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))).alias("url"))
    links = links.withColumn("key", normalize_url(F.col("url"))).withColumn("host", F.regexp_extract("key", "://([^/?]+)", 1))
    ok = allowed.select("message_id", normalize_url(F.col("url")).alias("key")).distinct().withColumn("hit", F.lit(True))
    own = hosts.select(F.lower("host").alias("host")).distinct().withColumn("own", F.lit(True))
    out = links.join(ok, ["message_id", "key"], "left").join(own, "host", "left")
    return out.select("message_id", "url", F.when(F.col("own").isNull(), "offsite").when(F.col("hit"), "ok").otherwise("denied").alias("verdict"))


def strip_links(replies: DataFrame, audited: DataFrame) -> DataFrame:
    """(message_id, reply) without denied links: Markdown links keep their text, bare URLs go."""
    denied = audited.where("verdict = 'denied'").groupBy("message_id").agg(F.collect_set("url").alias("denied"))

    @F.pandas_udf("string")
    def strip(reply: pd.Series, denied: pd.Series) -> pd.Series:
        def one(text: str | None, urls) -> str | None:
            if text is None or urls is None:
                return text
            for url in sorted(urls, key=len, reverse=True):
                text = re.sub(rf"\[([^\]]*)\]\({re.escape(url)}\)", r"\1", text)
                text = re.sub(rf"{re.escape(url)}(?![\w/#?=&%-])", "", text)
            return text

        return pd.Series([one(t, u) for t, u in zip(reply, denied, strict=True)])

    return replies.join(denied, "message_id", "left").select("message_id", strip(F.col("reply"), F.col("denied")).alias("reply"))
