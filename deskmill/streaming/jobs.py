"""Structured Streaming twins of the batch operators; on finite input each equals its batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.operators.moderation import banned_filter


def stream_activity(messages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Messages per day in append mode; rows later than ``lateness`` are dropped."""
    m = messages.withColumn("ts", F.to_timestamp_ltz("date_created")).withWatermark("ts", lateness)
    return m.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("messages")).select(F.to_date("window.start").alias("date"), "messages")


def stream_sessions(messages: DataFrame, gap: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Closed conversations: runs of messages of a session without a gap of some minutes."""
    m = messages.withColumn("ts", F.to_timestamp_ltz("date_created")).withWatermark("ts", lateness)
    return m.groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("messages")).select("session_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("closed"), "messages")


def stream_suggestions(clicks: DataFrame) -> DataFrame:
    """Running clicks per suggestion, for update or complete mode."""
    return clicks.groupBy("suggestion").agg(F.count("*").alias("clicks"), F.max("ts").alias("last_clicked_at"))


def stream_bans(messages: DataFrame, load_bans: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint_path: str):
    """Messages of ips that are not banned: every micro-batch loads the bans anew, compares them with its own time and is given to ``write``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(banned_filter(batch, load_bans(), F.current_timestamp()), batch_id)

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
