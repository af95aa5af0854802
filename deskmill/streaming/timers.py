"""Stateful streams whose state expires: rate limit, low-confidence streak and the sweep of inactive hand-offs.

Each is a processor for ``transformWithStateInPandas`` with one value per key and an event-time timer that clears it,
so that the state holds the keys of the last window only.  Times are microseconds; timers and watermarks are whole
milliseconds, and a timer that is a fraction too early waits for the next one.  Rows later than ``lateness`` are dropped.
A micro-batch is worked in the order of time and id; its size bounds what one key brings at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from deskmill.functions.tables import shared_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _us(ts: Column) -> Column:
    return F.unix_micros(F.to_timestamp_ltz(ts))


def _timed(rows: DataFrame, ts: str, lateness: str) -> DataFrame:
    """``rows`` with an event time from the column ``us``; streams with timers need a store of named states."""
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    return rows.withColumn(ts, F.timestamp_micros("us")).withWatermark(ts, lateness)


class _Expiring(StatefulProcessor):
    """One value per key, and one timer."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("value", self.schema)

    def at(self, us: int) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(us // 1000)

    def forget(self) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class _RateLimit(_Expiring):
    schema = "sessions array<bigint>, stamps array<bigint>"

    def __init__(self, window_us: int, limit: int, ip_factor: int) -> None:
        self.window_us, self.limit, self.ip_factor = window_us, limit, ip_factor

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sessions, stamps = (list(x) for x in self.state.get()) if self.state.exists() else ([], [])
        new = pd.concat(list(rows)).sort_values(["us", "id"])
        verdicts = []
        for session, now in zip(new["session"].tolist(), new["us"].tolist(), strict=True):
            live = [i for i, t in enumerate(stamps) if t >= now - self.window_us]
            sessions, stamps = [sessions[i] for i in live], [stamps[i] for i in live]
            ok = sessions.count(session) < self.limit and len(stamps) < self.limit * self.ip_factor
            if ok:
                sessions.append(session)
                stamps.append(now)
            verdicts.append(ok)
        if stamps:
            self.state.update((sessions, stamps))
            self.at(max(stamps) + self.window_us + 1000)
        yield pd.DataFrame({"id": new["id"].to_numpy(), "accepted": verdicts})


def stream_rate_limit(messages: DataFrame, window: int = 60, limit: int = 12, ip_factor: int = 3, lateness: str = "10 minutes") -> DataFrame:
    """(id, accepted) by ip of (id, session, ip, ts); the state is the accepted stamps of the window, 36 per ip at most by default."""
    rows = _timed(messages.select("id", "session", "ip", _us(F.col("ts")).alias("us")), "event_time", lateness)
    return rows.groupBy("ip").transformWithStateInPandas(_RateLimit(window * 1_000_000, limit, ip_factor), "id long, accepted boolean", "Append", "EventTime")


class _Streak(_Expiring):
    schema = "streak bigint"

    def __init__(self, floor: float, threshold: int, keep_us: int) -> None:
        self.floor, self.threshold, self.keep_us = floor, threshold, keep_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (streak,) = self.state.get() if self.state.exists() else (0,)
        new = pd.concat(list(rows)).sort_values("id")
        out = []
        for id_, judged, ended, confidence in zip(new["id"].tolist(), new["judged"].tolist(), new["ended"].tolist(), new["confidence"].tolist(), strict=True):
            streak = 0 if ended else streak
            if judged:
                streak = 0 if confidence >= self.floor else streak + 1  # a missing confidence is low
                out.append((id_, streak, streak >= self.threshold))
        if streak:
            self.state.update((streak,))
            self.at(int(new["us"].max()) + self.keep_us + 1000)
        else:
            self.forget()
        yield pd.DataFrame(out, columns=["message_id", "streak", "offer_human"])


def stream_streak(messages: DataFrame, floor: float = 0.35, threshold: int = 2, ended: Column | None = None, keep: int = 30 * 86400, lateness: str = "1 hour") -> DataFrame:
    """(message_id, streak, offer_human) by session; the state is one number, and none where the streak is 0.

    Messages marked ``ended`` start anew, and so does a session that is silent for ``keep`` seconds.
    """
    judged = (F.col("role") == "bot") & F.col("context_chunks").isNotNull()
    end = F.lit(False) if ended is None else F.coalesce(ended, F.lit(False))
    rows = messages.select("session_id", "id", judged.alias("judged"), end.alias("ended"), F.col("confidence").cast("double").alias("confidence"), _us(F.col("date_created")).alias("us")).where("judged OR ended")
    processor = _Streak(floor, threshold, keep * 1_000_000)
    return _timed(rows, "event_time", lateness).groupBy("session_id").transformWithStateInPandas(processor, "message_id long, streak long, offer_human boolean", "Append", "EventTime")


OPEN = ("requested", "active")
_MARKS = ("handoff_requested_at", "handoff_started_at", "admin_last_read_at", "user_last_read_at")


def activity_events(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, ts, kind): every message is ``activity``; a version of a session is ``open`` or ``close`` at its latest mark.

    Sessions without any mark have no event of their own.
    """
    opened = F.col("handoff_status").isin(*OPEN) & F.col("chat_ended_at").isNull()
    s = sessions.select(F.col("id").alias("session_id"), F.greatest(*_MARKS, "chat_ended_at").alias("ts"), F.when(opened, "open").otherwise("close").alias("kind")).where("ts IS NOT NULL")
    return s.unionByName(messages.select("session_id", F.col("date_created").alias("ts"), F.lit("activity").alias("kind")))


class _Sweep(_Expiring):
    schema = "last bigint, opened bigint, closed bigint"

    def __init__(self, after_us: int) -> None:
        self.after_us = after_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, opened, closed = self.state.get() if self.state.exists() else (-1, -1, -1)
        for new in rows:
            last = max([last, *new["us"][new["kind"] != "close"].tolist()])
            opened = max([opened, *new["us"][new["kind"] == "open"].tolist()])
            closed = max([closed, *new["us"][new["kind"] == "close"].tolist()])
        if max(last, closed) >= 0:
            self.state.update((last, opened, closed))
            self.at(max(last, closed) + self.after_us)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, opened, closed = self.state.get()
        due = max(last, closed) + self.after_us
        if due >= timerValues.getCurrentWatermarkInMs() * 1000:
            self.at(due + 1000)
            return
        self.state.clear()
        if opened > closed:
            yield pd.DataFrame({"session_id": [int(key[0])], "last_us": [last]})


def stream_sweep(events: DataFrame, minutes: int = 15, lateness: str = "1 hour", now: Column | None = None) -> DataFrame:
    """(session_id, last_activity) of open hand-offs once their last activity of any kind is more than some minutes before the watermark.

    ``events`` are (session_id, ts, kind): ``activity``, ``open``, ``close``, or ``tick``, which only moves the clock on; events
    without a session are ignored.
    A session's state goes when its timer fires, whether it was open or not; an ``open`` counts as activity, so a session
    that is opened later starts with that.  With ``now`` an event that is later counts as of then: it keeps its session
    open and doesn't move the clock on.
    """
    if minutes <= 0:
        return events.where("false").select("session_id", F.to_timestamp_ltz("ts").alias("last_activity"))
    us = _us(F.col("ts")) if now is None else F.when(F.col("ts").isNotNull(), F.least(_us(F.col("ts")), _us(now)))
    rows = _timed(events.select("session_id", us.alias("us"), "kind"), "event_time", lateness)
    # Ticks end here; the condition names the event time, so that it isn't moved in front of the watermark.
    rows = rows.where("session_id IS NOT NULL AND kind <> 'tick' OR event_time IS NULL")
    closed = rows.groupBy("session_id").transformWithStateInPandas(_Sweep(minutes * 60_000_000), "session_id long, last_us long", "Append", "EventTime")
    return closed.select("session_id", F.timestamp_micros("last_us").alias("last_activity"))


def run_available(spark: SparkSession, rows: DataFrame, job, files: int = 4) -> DataFrame:
    """Result of a streaming ``job`` over all ``rows``, which are kept as a table of ``files`` files and streamed from there."""
    folder = shared_path(spark, "stream")
    rows.repartition(files).write.parquet(f"{folder}/in")
    stream = job(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    schema = stream.schema
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
