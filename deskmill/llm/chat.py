"""Event-sourced conversations: fold event logs into final messages and render them.

Events are rows (conv_id, seq, message, kind, role, text).  ``kind`` is

message      a message's first text (also replaces what there is)
delta        a streamed part, appended in the order of seq
edit         replaces the message's text
regenerate   drops the text streamed so far; its own text, if any, starts the new one

``message`` names the message an event belongs to; an event without one is a whole message.  A
message stands where its first event stands.  All work is DataFrame functions: deltas are folded
per message, so a long conversation is spread over tasks until its turns are put in order; a
rendered conversation is one row, and must fit one.

Template: ``[INST] user text [/INST]``, ``<s>assistant text</s>``, any other role
``<<SYS>>role<<SYS>>text<</SYS>>``.  In texts and roles a backslash is doubled, and one is put after
the first character of each control string; ``unescape`` takes both back.

Cases: null text and null role are empty strings; null conv_id is one conversation; null seq stands
first; events of one message with equal seq are ordered by kind, then text, and messages with equal seq by role,
then text; a null turn of a log's source stands first; repeated rows without ``message`` are repeated turns; a very
long text, or a text in very many deltas, is one message and must fit a row; empty tables give no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template, as a Java pattern that matches their first character.
_CONTROL = r"\\|<(?=/?s>|</?SYS>>)|\[(?=/?INST\])"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<<SYS>>.*?<</SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of an event log."""
    e = events.select("conv_id", "seq", "message", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = e.where(F.col("message").isNull()).select("conv_id", "seq", "role", "text")
    logs = e.where(F.col("message").isNotNull()).groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("log"))
    last = F.greatest(F.lit(1), F.array_max(F.transform("log", lambda x, i: F.when(F.coalesce(x["kind"], F.lit("message")) != "delta", i + 1).otherwise(0))))
    logs = logs.select("conv_id", "log", last.alias("last"))
    parts = F.slice("log", F.col("last"), F.size("log") - F.col("last") + 1)
    folded = logs.select("conv_id", F.col("log")[0]["seq"].alias("seq"), F.array_max(F.transform("log", lambda x: x["role"])).alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(folded)


def render_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted text, and the loss mask as (start, length) spans over assistant texts, in code points."""
    m = messages.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("body", escape(F.col("text")))
    turn = (
        F.when(F.col("role") == "user", F.concat(F.lit("[INST] "), "body", F.lit(" [/INST]")))
        .when(F.col("role") == "assistant", F.concat(F.lit("<s>"), "body", F.lit("</s>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), escape(F.col("role")), F.lit("<<SYS>>"), "body", F.lit("<</SYS>>")))
    )
    m = m.withColumn("turn", turn).withColumn("size", F.length("turn"))
    before = Window.partitionBy("conv_id").orderBy("seq", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    turns = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "turn", "role", F.length("body").alias("length")))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["at"] + 3).alias("start"), t["length"].alias("length")))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold an event log and render its conversations."""
    return render_conversations(fold_events(events))


def parse_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""

    def one(turn: Column) -> Column:
        n = F.length(turn)
        rest = F.substring(turn, F.lit(8), n - 15)
        cut = F.instr(rest, "<<SYS>>")
        return (
            F.when(F.startswith(turn, F.lit("[INST]")), F.struct(F.lit("user").alias("role"), unescape(F.substring(turn, F.lit(8), n - 15)).alias("text")))
            .when(F.startswith(turn, F.lit("<s>")), F.struct(F.lit("assistant").alias("role"), unescape(F.substring(turn, F.lit(4), n - 7)).alias("text")))
            .otherwise(F.struct(unescape(F.substring(rest, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(rest, cut + 7, n)).alias("text")))
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"]))), "")
