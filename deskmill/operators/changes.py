"""Change sets: what a job wants to write, as one frame, and the tables with it applied.

A change is (table, key, seq, operation, values): ``insert``, ``update`` or ``delete`` of the row with that key, with the
new values as text that casts to the columns' types.  A later ``seq`` wins column by column; of equal ones the greater
value.  New rows get their keys when the changes are made, so applying a set twice gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.operators.conversations import previous_question, ranked, sweep_inactive

_BLANK = " \t\n\r\0\x0b"


def _changes(rows: DataFrame, table: str, key: Column, operation: str, seq: Column, values: dict[str, Column]) -> DataFrame:
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]
    return rows.select(F.lit(table).alias("table"), key.cast("long").alias("key"), seq.cast("long").alias("seq"), F.lit(operation).alias("operation"), F.create_map(*pairs).alias("values"))


def apply_changes(rows: DataFrame, changes: DataFrame, table: str, key: str = "id") -> DataFrame:
    """``rows`` of ``table`` after the changes to it.

    Updates of a key that neither the table nor an insert has, null keys, values of columns that the table lacks and
    changes to other tables are left out; an insert of a key that is there works as an update, as replays need it; what
    comes before a delete of the key is void, and an update before the insert of its key counts.  An insert leaves columns
    without a value null.
    """
    mine = changes.where((F.col("table") == table) & F.col("key").isNotNull())
    columns = [c for c in rows.columns if c != key]
    names = [f"_v{i}" for i in range(len(columns))]
    newest = [F.max(F.when(F.map_contains_key("values", F.lit(c)) & (F.col("operation") != "delete"), F.struct("seq", F.element_at("values", F.lit(c)).alias("value")))).alias(n) for c, n in zip(columns, names)]
    last = mine.groupBy(F.col("key").alias("_key")).agg(F.max(F.when(F.col("operation") == "delete", F.col("seq"))).alias("_gone"), F.max(F.when(F.col("operation") == "insert", F.col("seq"))).alias("_made"), *newest)
    void, born = F.col("_gone").isNotNull(), F.col("_made").isNotNull() & (F.col("_gone").isNull() | (F.col("_made") > F.col("_gone")))

    def after(column: str, name: str, old: Column) -> Column:
        given = F.col(name).isNotNull() & (F.col("_gone").isNull() | (F.col(f"{name}.seq") > F.col("_gone")))
        return F.when(given, F.col(f"{name}.value").cast(rows.schema[column].dataType)).otherwise(old).alias(column)

    null = {c: F.lit(None).cast(rows.schema[c].dataType) for c in columns}
    there = rows.join(last, F.col(f"`{key}`") == F.col("_key"), "left").where(~void | born)
    there = there.select(F.col(f"`{key}`"), *(after(c, n, F.when(~void, F.col(f"`{c}`"))) for c, n in zip(columns, names)))
    new = last.where(born).join(rows.select(F.col(f"`{key}`").alias("_old")), F.col("_key") == F.col("_old"), "left_anti")
    new = new.select(F.col("_key").cast(rows.schema[key].dataType).alias(key), *(after(c, n, null[c]) for c, n in zip(columns, names)))
    return there.unionByName(new).select(*(F.col(f"`{c}`") for c in rows.columns))


def _numbered(rows: DataFrame, order: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``new_id``, counted on from the greatest id of ``table`` by ``order``, which has no ties."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return ranked(rows.withColumn("_all", F.lit(1)), "_all", F.col(order).asc()).withColumn("new_id", F.col("position") + F.lit(top).cast("long")).drop("_all", "position")


def closing_changes(sessions: DataFrame, messages: DataFrame, now: Column, minutes: int = 15, text: str = "Conversation auto-closed after {minutes} minutes of inactivity.") -> DataFrame:
    """The changes that end inactive hand-offs: the session's status and times, its streak back to 0, a system message.

    0 minutes or less close nothing.
    """
    swept = sweep_inactive(sessions, messages, now, minutes)
    swept = _numbered((swept if minutes > 0 else swept.where("false")).select("session_id"), "session_id", messages)
    seq = F.unix_micros(F.to_timestamp_ltz(now))
    ended = _changes(swept, "sessions", F.col("session_id"), "update", seq, {"handoff_status": F.lit("ended"), "handoff_ended_at": now, "chat_ended_at": now, "low_conf_streak": F.lit(0)})
    said = _changes(swept, "messages", F.col("new_id"), "insert", seq, {"session_id": F.col("session_id"), "role": F.lit("system"), "content": F.lit(text.replace("{minutes}", str(minutes))), "date_created": now})
    return ended.unionByName(said)


def promotion_changes(messages: DataFrame, qa: DataFrame, picked: DataFrame, now: Column) -> DataFrame:
    """The changes that answer gaps for good: a QA row of each picked message, and the message marked used and resolved.

    ``picked`` has message_id (each once), question and answer (null: the user's message before, and the bot's own), site_id
    (0: null) and translate, which counts only without a site.  A pick with a blank question or answer changes nothing.
    """
    asked = messages.withColumn("_asked", previous_question()).where("role = 'bot'").select(F.col("id").alias("message_id"), "_asked", F.col("content").alias("_said"))
    p = picked.join(asked, "message_id", "left")
    p = p.withColumns({"question": F.btrim(F.coalesce("question", "_asked"), F.lit(_BLANK)), "answer": F.btrim(F.coalesce("answer", "_said"), F.lit(_BLANK)), "site_id": F.expr("nullif(site_id, 0)")})
    p = _numbered(p.where("question <> '' AND answer <> ''").select("message_id", "question", "answer", "site_id", "translate"), "message_id", qa)
    seq = F.unix_micros(F.to_timestamp_ltz(now))
    pairs = _changes(p, "qa", F.col("new_id"), "insert", seq, {
        "question": F.col("question"), "answer": F.col("answer"), "source": F.lit("chat"), "source_message_id": F.col("message_id"), "active": F.lit(True),
        "site_id": F.col("site_id"), "translate": F.col("site_id").isNull() & F.coalesce("translate", F.lit(False))})
    marks = _changes(p, "messages", F.col("message_id"), "update", seq, {"used_as_qa": F.lit(True), "gap_resolved": F.lit(True), "gap_resolved_at": now})
    return pairs.unionByName(marks)
