"""Moderation: gibberish and message filters, rate limits and bans."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_gibberish(text: Column) -> Column:
    """Whether a message is noise; other scripts, symbols, short texts and code-like tokens are let through."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\0\x0b"))
    plain = F.rlike(t, F.lit(r"(?U)^[\p{IsLatin}\s\p{P}\p{N}]+$"))
    bare = F.transform(F.split(t, r"(?U)\s+"), lambda x: F.regexp_replace(x, r"^\p{P}+|\p{P}+$", ""))
    prose = F.filter(bare, lambda x: (x != "") & ~F.rlike(x, F.lit(r"\p{N}")) & ~((F.length(x) <= 5) & (x == F.upper(x))))
    letters = F.lower(F.regexp_replace(F.array_join(prose, " "), r"[^\p{L}]+", ""))
    n, vowels = F.length(letters), F.regexp_count(letters, F.lit("[aeiouy]"))
    kinds = F.size(F.array_distinct(F.split(letters, "")))
    odd = (
        ((n >= 6) & ((vowels < 0.15 * n) | (vowels > 0.85 * n)))
        | F.rlike(letters, F.lit("[bcdfghjklmnpqrstvwxz]{7,}"))
        | F.rlike(letters, F.lit(r"(.)\1{5,}"))
        | ((n >= 12) & ((kinds <= 3) | (kinds < 0.2 * n)))
        | ((F.length(t) >= 40) & ~F.rlike(t, F.lit(r"\s")))
    )
    return F.when(t == "", True).when(F.length(t) < 4, False).when(~plain, False).when(~F.rlike(t, F.lit(r"[\p{L}\p{N}]")), True).when(n == 0, False).otherwise(odd)


def filter_messages(messages: DataFrame, text: str = "content", min_length: int = 2, max_length: int = 2000, blocked_words: tuple[str, ...] = (), enabled: bool = True) -> DataFrame:
    """``messages`` with ok and the first reason against each; blocked words are settings and few."""
    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\r\0\x0b"))
    low = F.lower(t)
    ascii_low = [w.translate({c: c + 32 for c in range(65, 91)}).strip() for w in blocked_words]
    blocked = F.lit(False)
    for w in filter(None, ascii_low):
        blocked = blocked | F.contains(low, F.lit(w))
    reason = F.when(F.length(t) < min_length, "too_short").when(F.length(t) > max_length, "too_long").when(blocked, "blocked_word").when(is_gibberish(t), "gibberish")
    out = messages.withColumn("reason", reason if enabled else F.lit(None).cast("string"))
    return out.withColumn("ok", F.col("reason").isNull())


def rate_attempts(messages: DataFrame, key: str, window: int = 60) -> DataFrame:
    """Other messages of the same key in the trailing window (start included); equal stamps count each other."""
    us = F.unix_micros(F.to_timestamp_ltz("ts"))
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-window * 1_000_000, 0)
    return messages.withColumn("us", us).withColumn("attempts", F.count("*").over(w) - 1).drop("us")


def accept(stamps: deque, now: int, window_us: int, limit: int) -> bool:
    """Whether one more message fits; forgets what left the window."""
    while stamps and stamps[0] < now - window_us:
        stamps.popleft()
    return len(stamps) < limit


def rate_limit(messages: DataFrame, window: int = 60, limit: int = 12, ip_factor: int = 3) -> DataFrame:
    """(id, accepted): at most ``limit`` accepted messages per session and ``ip_factor`` times as many per ip in any trailing window.

    Rejected messages don't count, so each ip is one sequence; its state is bounded by the limits.  Rows of an ip are
    sorted by Spark and streamed through in batches, so a hot ip needs no memory of its size.
    """
    us = F.unix_micros(F.to_timestamp_ltz("ts"))
    rows = messages.select("id", "session", "ip", us.alias("us")).repartition("ip").sortWithinPartitions("ip", "us", "id")
    window_us = window * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, by_ip, by_session = object(), deque(), {}
        for batch in batches:
            verdicts = []
            for session, at_ip, now in zip(batch["session"], batch["ip"], batch["us"], strict=True):
                if at_ip != ip:
                    ip, by_ip, by_session = at_ip, deque(), {}
                if len(by_session) > 4 * limit * ip_factor:
                    by_session = {k: v for k, v in by_session.items() if v and v[-1] >= now - window_us}
                mine = by_session.setdefault(session, deque())
                ok = accept(mine, now, window_us, limit) and accept(by_ip, now, window_us, limit * ip_factor)
                if ok:
                    mine.append(now)
                    by_ip.append(now)
                verdicts.append(ok)
            yield pd.DataFrame({"id": batch["id"], "accepted": verdicts})

    return rows.mapInPandas(fold, "id long, accepted boolean")


def filter_and_limit(messages: DataFrame, window: int = 60, limit: int = 12, ip_factor: int = 3, **settings) -> DataFrame:
    """``filter_messages`` of (id, session, ip, ts, ...), and ``rate_limit`` as the last reason.

    A message that another reason rejects isn't sent, so it doesn't count against the limit; a window or limit of 0, or
    a switched-off filter, sets none.
    """
    judged = filter_messages(messages, **settings)
    if window <= 0 or limit <= 0 or not settings.get("enabled", True):
        return judged
    fast = rate_limit(judged.where("reason IS NULL").select("id", "session", "ip", "ts"), window, limit, ip_factor).where("NOT accepted").select("id", F.lit("rate_limit").alias("_fast"))
    out = judged.join(fast, "id", "left").withColumn("reason", F.coalesce("reason", "_fast")).drop("_fast")
    return out.withColumn("ok", F.col("reason").isNull())


def parse_duration(token: Column) -> Column:
    """Seconds of 1h, 7d, 2w, 90; null for ever; 0 for nothing or nonsense."""
    t = F.lower(F.btrim(F.coalesce(token, F.lit("")), F.lit(" \t\n\r\0\x0b")))
    number = F.regexp_extract(t, r"^([0-9]+)\s*[smhdw]?$", 1)
    unit = F.regexp_extract(t, r"^[0-9]+\s*([smhdw]?)$", 1)
    scale = F.when(unit == "w", 604800).when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    seconds = F.when(number == "", F.lit(0).cast("long")).otherwise(F.try_to_number(F.when(number != "", number).otherwise("0"), F.lit("9" * 18)).cast("long") * scale)
    return F.when(t.isin("forever", "permanent", "perm"), F.lit(None).cast("long")).otherwise(seconds)


def apply_bans(bans: DataFrame, new: DataFrame) -> DataFrame:
    """One ban per ip: the newest, and of ``new`` before old ones; the ips of new ones are trimmed, blank ones ban nobody."""
    new = new.withColumn("ip", F.btrim("ip", F.lit(" \t\n\r\0\x0b"))).where("ip <> ''")
    both = bans.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy("ip").agg(F.max_by(F.struct("expires_at", "date_created"), F.struct("_new", "date_created", F.coalesce("expires_at", F.expr("TIMESTAMP_NTZ'9999-12-31 00:00:00'")))).alias("b"))
    return best.select("ip", "b.expires_at", "b.date_created")


def active_bans(bans: DataFrame, now: Column) -> DataFrame:
    return bans.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def purge_expired(bans: DataFrame, now: Column) -> DataFrame:
    """What stays of the bans when those that ended before now go."""
    return bans.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def banned_filter(df: DataFrame, bans: DataFrame, now: Column) -> DataFrame:
    """Rows whose ip is not banned."""
    return df.join(active_bans(bans, now).select("ip"), "ip", "left_anti")
