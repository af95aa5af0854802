import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deskmill.operators import conversations as C
from deskmill.operators import moderation as M
from deskmill.plans.registry import QUERIES
from deskmill.plans.views import view
from deskmill.streaming import timers

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def at(minutes, us=0):
    return T0 + timedelta(minutes=minutes, microseconds=us)


def stream(spark, folder, schema, batches, job):
    """Rows of ``job`` over one file per micro-batch, and the state rows after each progress."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    name = "t" + str(abs(hash(folder)))
    q = s.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    return spark.table(name).collect(), states


EVENT = "session_id long, ts timestamp, kind string"


def sweep(spark, folder, batches, now, minutes=15):
    rows, states = stream(spark, folder, EVENT, [*batches, [(None, now, "tick")]], lambda s: timers.stream_sweep(s, minutes, "0 seconds"))
    return sorted((r.session_id, r.last_activity) for r in rows), states


@pytest.mark.parametrize("late_us, closed", [(0, False), (1000, True), (-1000, False)])
def test_sweep_is_strict_at_the_boundary(spark, tmp_path, late_us, closed):
    got, _ = sweep(spark, str(tmp_path), [[(1, at(10), "open"), (1, at(20), "activity")]], at(35, late_us))
    assert got == ([(1, at(20))] if closed else [])


def test_fractions_of_a_millisecond(spark, tmp_path):
    got, _ = sweep(spark, str(tmp_path), [[(1, at(20, 400), "open"), (2, at(20, 1400), "open"), (3, at(19), "open")]], at(35, 1000))
    assert got == [(1, at(20, 400)), (3, at(19))]


def test_sweep_equals_batch_over_several_batches(spark, tmp_path):
    rng = random.Random(2)
    events = []
    for s in range(40):
        t = rng.randrange(0, 60)
        if rng.random() < 0.8:
            events.append((s, at(t), "open"))
        events += [(s, at(t + rng.randrange(0, 14), rng.randrange(10**6)), "activity") for _ in range(rng.randrange(4))]
        if rng.random() < 0.3:
            events.append((s, at(t + 14), "close"))
    events.sort(key=lambda e: e[1])
    now = at(80)
    got, states = sweep(spark, str(tmp_path), [events[i : i + 40] for i in range(0, len(events), 40)], now)
    want = []
    for s in range(40):
        mine = [e for e in events if e[0] == s]
        opened, closed = [max((t for _, t, k in mine if k == kind), default=None) for kind in ("open", "close")]
        last = max((t for _, t, k in mine if k != "close"), default=None)
        if opened and not (closed and closed >= opened) and last < now - timedelta(minutes=15):
            want.append((s, last))
    assert got == want and want and states[-1] <= 3 * sum(1 for e in {e[0] for e in events} if max(t for s, t, _ in events if s == e) >= now - timedelta(minutes=15))


def test_sweep_of_tables_and_no_minutes(spark):
    got = QUERIES["g3_stream_sweep"](spark, SF)
    want = C.sweep_inactive(view(spark, SF, "sessions"), view(spark, SF, "messages"), F.expr("TIMESTAMP_NTZ'2024-01-09 08:00:00'"), 15)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    events = spark.createDataFrame([(1, at(0), "open")], EVENT)
    assert timers.stream_sweep(events, 0).count() == 0


def test_events_after_now_keep_their_session_open(spark, tmp_path):
    events = [(1, at(10), "open"), (2, at(10), "open"), (2, at(200), "activity"), (3, at(100), "open"), (4, at(19), "open"), (5, at(10), "open"), (5, at(90), "close")]
    rows = spark.createDataFrame([*events, (None, at(35), "tick")], EVENT)
    got = timers.run_available(spark, rows, lambda s: timers.stream_sweep(s, 15, "0 seconds", F.lit(at(35))))
    assert sorted(map(tuple, got.collect())) == [(1, at(10)), (4, at(19))]


def test_rate_limit_equals_batch_and_forgets(spark, tmp_path):
    got = QUERIES["g2_stream_rate_limit"](spark, SF)
    a = view(spark, SF, "attempts").withColumnRenamed("session_id", "session")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.rate_limit(a, 86400, 3).collect()))
    rng = random.Random(4)
    rows = sorted((at(rng.randrange(30), rng.randrange(10**6)) for _ in range(300)))
    rows = [(i, rng.randrange(6), rng.choice("ab"), t) for i, t in enumerate(rows)]
    schema = "id long, session long, ip string, ts timestamp"
    end = [(1000, 9, "z", at(100)), (1001, 9, "z", at(100))]
    got, states = stream(spark, str(tmp_path), schema, [rows[:150], rows[150:], end], lambda s: timers.stream_rate_limit(s, 60, 2, 2, "0 seconds"))
    want = M.rate_limit(spark.createDataFrame(rows + end, schema), 60, 2, 2)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    # The keys a and b are gone; what is left is one key's value and timers.
    assert max(states[:-1]) > states[-1]


def test_streak_equals_batch_resets_and_forgets(spark, tmp_path):
    m = view(spark, SF, "messages")
    got = QUERIES["g4_stream_streak"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.low_confidence_streak(m).collect()))
    rng = random.Random(6)
    schema = "id long, session_id long, role string, confidence double, context_chunks int, over boolean, date_created timestamp"
    rows = [(i, rng.randrange(5), rng.choice(["bot", "bot", "user"]), rng.choice([0.1, 0.9, None]), rng.choice([3, 3, None]), rng.random() < 0.1, at(i)) for i in range(200)]
    job = lambda s: timers.stream_streak(s, ended=F.col("over"), keep=3600, lateness="0 seconds")
    end = [(900, 99, "bot", 0.9, 1, False, at(5000))]
    got, states = stream(spark, str(tmp_path), schema, [rows[:70], rows[70:140], rows[140:], end], job)
    want = C.low_confidence_streak(spark.createDataFrame(rows + end, schema), ended=F.col("over"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert states[-1] == 0 and max(states) > 0
