import random

from pyspark.sql import functions as F

from deskmill.operators.changes import apply_changes, closing_changes

FORMAT = "`table` string, key long, seq long, operation string, values map<string,string>"


def brute(rows, changes):
    """The changes one by one, in the order of seq (no two of a key are equal here)."""
    rows = {r["id"]: dict(r) for r in rows}
    for table, key, _, operation, values in sorted(changes, key=lambda c: c[2]):
        if table != "t" or key is None:
            continue
        if operation == "delete":
            rows.pop(key, None)
        elif key in rows or operation == "insert":
            row = rows.setdefault(key, {"id": key, "n": None, "seq": None})
            row.update({k: v if v is None or k == "seq" else int(v) for k, v in values.items() if k in row})
    return rows


def test_changes_against_one_by_one(spark):
    rng = random.Random(7)
    rows = [{"id": i, "n": i * 10, "seq": "old"} for i in range(60)]
    changes = []
    for seq in range(300):
        operation = rng.choice(["update", "update", "update", "insert", "delete"])
        values = {k: v for k, v in (("n", rng.choice(["1", "2", None])), ("seq", f"s{seq}"), ("other", "x")) if rng.random() < 0.6}
        changes.append((rng.choice(["t", "t", "t", "u"]), rng.choice([None, *range(90)]), seq, operation, values))
    # An update of a row that isn't there is lost, whatever comes later: keep the two readings apart from each other.
    seen, order = {r["id"] for r in rows}, []
    for c in changes:
        if c[0] == "t" and c[3] == "update" and c[1] not in seen:
            continue
        if c[0] == "t" and c[3] == "insert":
            seen.add(c[1])
        if c[0] == "t" and c[3] == "delete":
            seen.discard(c[1])
        order.append(c)
    df = spark.createDataFrame([(r["id"], r["n"], r["seq"]) for r in rows], "id long, n int, seq string")
    made = spark.createDataFrame(rng.sample(order, len(order)), FORMAT)
    got = apply_changes(df, made, "t")
    assert got.columns == df.columns and got.schema["n"].dataType == df.schema["n"].dataType
    want = brute(rows, order)
    assert {r.id: r.asDict() for r in got.collect()} == want
    assert {r.id: r.asDict() for r in apply_changes(got, made.where("operation <> 'delete' AND false"), "t").collect()} == want


def test_closing_twice_changes_nothing(spark):
    s = spark.sql("SELECT 1 AS id, 'active' AS handoff_status, 3 AS low_conf_streak, TIMESTAMP'2024-01-01 10:00:00' AS handoff_started_at, CAST(NULL AS TIMESTAMP) AS handoff_requested_at, CAST(NULL AS TIMESTAMP) AS admin_last_read_at, CAST(NULL AS TIMESTAMP) AS user_last_read_at, CAST(NULL AS TIMESTAMP) AS chat_ended_at, CAST(NULL AS TIMESTAMP) AS handoff_ended_at UNION ALL SELECT 2, 'active', 1, TIMESTAMP'2024-01-01 11:59:00', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 3, 'ended', 1, TIMESTAMP'2024-01-01 01:00:00', NULL, NULL, NULL, TIMESTAMP'2024-01-01 02:00:00', NULL")
    m = spark.sql("SELECT 7L AS id, 1 AS session_id, 'user' AS role, 'x' AS content, TIMESTAMP'2024-01-01 10:30:00' AS date_created")
    now = F.expr("TIMESTAMP'2024-01-01 12:00:00'")
    changes = closing_changes(s, m, now, 15).cache()
    s1, m1 = apply_changes(s, changes, "sessions"), apply_changes(m, changes, "messages")
    assert [(r.id, r.handoff_status, r.low_conf_streak, r.chat_ended_at is not None, r.handoff_ended_at is not None) for r in s1.orderBy("id").collect()] == [(1, "ended", 0, True, True), (2, "active", 1, False, False), (3, "ended", 1, True, False)]
    said = m1.orderBy("id").collect()
    assert [(r.id, r.session_id, r.role) for r in said] == [(7, 1, "user"), (8, 1, "system")] and "15 minutes" in said[1].content
    assert sorted(apply_changes(m1, changes, "messages").collect()) == said
    assert closing_changes(s1, m1, now, 15).count() == closing_changes(s, m, now, 0).count() == 0
