"""Queries of streams over the tables; on finite input each equals a batch query, whose SQL it shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.plans.chat_queries import NOW
from deskmill.plans.chat_queries import ORACLES as BATCH
from deskmill.plans.core_queries import ORACLES, QUERIES
from deskmill.plans.views import view
from deskmill.streaming import timers


def streamed(batch: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if batch:
            ORACLES[f.__name__] = BATCH[batch]
        return f

    return add


@streamed(None)
def g2_stream_rate_limit(spark, sf_dir):
    rows = view(spark, sf_dir, "attempts").withColumnRenamed("session_id", "session")
    return timers.run_available(spark, rows, lambda s: timers.stream_rate_limit(s, 86400, 3))


@streamed("e15_sweep_inactive")
def g3_stream_sweep(spark, sf_dir):
    events = timers.activity_events(view(spark, sf_dir, "sessions"), view(spark, sf_dir, "messages"))
    tick = spark.range(1).select(F.lit(None).cast("long").alias("session_id"), NOW().alias("ts"), F.lit("tick").alias("kind"))
    closed = timers.run_available(spark, events.unionByName(tick), lambda s: timers.stream_sweep(s, 15, "0 seconds", NOW()))
    return closed.withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))


@streamed("e7_low_confidence_streak")
def g4_stream_streak(spark, sf_dir):
    return timers.run_available(spark, view(spark, sf_dir, "messages"), timers.stream_streak)
