"""Conversation analytics over sessions and messages.

Per-session logic is windows over (session_id, id), so one shuffle by session serves several of them;
dashboards are aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.functions.tables import stored

TALK = ("user", "bot", "admin")


def _seconds(ts: str | Column) -> Column:
    return F.unix_micros(F.to_timestamp_ltz(F.col(ts) if isinstance(ts, str) else ts)) / F.lit(1_000_000)


def _minus(now: Column, minutes: float) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(minutes * 60)))


def active_now(sessions: DataFrame, messages: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Sessions not ended that have a message in the last minutes."""
    recent = messages.where(F.col("date_created") >= _minus(now, minutes)).select(F.col("session_id").alias("id"))
    return sessions.where(F.col("chat_ended_at").isNull()).join(recent, "id", "left_semi").select(F.col("id").alias("session_id"))


def stats_summary(sessions: DataFrame, messages: DataFrame, start: Column, end: Column, now: Column) -> DataFrame:
    """One row of counts, ratings and averages over an inclusive range."""
    s = sessions.where(F.col("date_created").between(start, end)).agg(F.count("*").alias("sessions"), F.count_if(F.col("chat_rating") == 1).alias("sp"), F.count_if(F.col("chat_rating") == -1).alias("sn"))
    m = messages.where(F.col("date_created").between(start, end)).agg(
        F.count("*").alias("messages"), F.round(F.coalesce(F.avg(F.when(F.col("role") == "bot", F.col("response_time"))), F.lit(0.0)), 3).alias("avg_response_time"),
        F.count_if(F.col("rating") == 1).alias("mp"), F.count_if(F.col("rating") == -1).alias("mn"))
    live = active_now(sessions, messages, now).agg(F.count("*").alias("active_now"))
    days = F.greatest(F.lit(1), F.floor((_seconds(end) - _seconds(start)) / 86400))
    out = s.crossJoin(m).crossJoin(live)
    return out.select("sessions", "messages", "avg_response_time", (F.col("mp") + F.col("sp")).alias("positive"), (F.col("mn") + F.col("sn")).alias("negative"), F.round(F.col("sessions") / days, 2).alias("per_day"), "active_now")


def activity(sessions: DataFrame, messages: DataFrame, start: Column, end: Column) -> DataFrame:
    """Conversations and messages per day, with days of none; the spine steps a day from start while not after end."""
    def daily(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("date_created").between(start, end)).groupBy(F.to_date("date_created").alias("date")).agg(F.count("*").alias(name))

    spine = sessions.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias("at")).select(F.to_date("at").alias("date"))
    out = spine.join(daily(sessions, "conversations"), "date", "left").join(daily(messages, "messages"), "date", "left")
    return out.na.fill(0, ["conversations", "messages"])


def suggestion_stats(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("suggestion").agg(F.count("*").alias("clicks"), F.max("ts").alias("last_clicked_at"))


def session_rollup(messages: DataFrame) -> DataFrame:
    bot = F.col("role") == "bot"
    return messages.groupBy("session_id").agg(
        F.count_if(F.col("role").isin(*TALK)).alias("message_count"), F.count_if(bot & (F.col("rating") == 1)).alias("rating_positive"), F.count_if(bot & (F.col("rating") == -1)).alias("rating_negative"),
        F.max(F.when(bot, F.col("confidence"))).alias("max_confidence"), F.max("date_created").alias("last_message_at"))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "none").when(confidence >= 0.8, "high").when(confidence >= 0.6, "mid").otherwise("low")


def search_sessions(sessions: DataFrame, messages: DataFrame, now: Column, q: str = "", rating: str | None = None, confidence: str | None = None, starred: bool = False, active: bool = False, page: int = 1, per_page: int = 25) -> DataFrame:
    """A page of sessions by short id, id or text, with rating, confidence, star and activity filters, newest first."""
    import re

    out = sessions.join(session_rollup(messages).withColumnRenamed("session_id", "id"), "id", "left")
    q = q.strip().lower()
    if m := re.fullmatch(r"(\d+)-([0-9a-z]+)", q):
        out = out.where((F.col("id") == int(m[1])) & F.startswith(F.lower("session_token"), F.lit(m[2])))
    elif q.isdigit():
        out = out.where(F.col("id") == int(q))
    elif q:
        found = messages.where(F.contains(F.lower("content"), F.lit(q))).select(F.col("session_id").alias("id")).distinct().withColumn("said", F.lit(True))
        out = out.join(found, "id", "left").where(F.coalesce("said", F.lit(False)) | F.contains(F.lower("session_token"), F.lit(q)) | F.coalesce(F.contains(F.lower("admin_notes"), F.lit(q)), F.lit(False)))
    if rating:
        value, name = (1, "rating_positive") if rating == "positive" else (-1, "rating_negative")
        out = out.where((F.coalesce(F.col(name), F.lit(0)) > 0) | F.coalesce(F.col("chat_rating") == value, F.lit(False)))
    if starred:
        out = out.where("starred")
    if active:
        out = out.join(active_now(sessions, messages, now).withColumnRenamed("session_id", "id"), "id", "left_semi")
    out = out.withColumn("band", confidence_band(F.col("max_confidence")))
    if confidence:
        out = out.where(F.col("band") == confidence)
    return out.orderBy(F.desc("date_created"), F.desc("id")).offset((page - 1) * per_page).limit(per_page).select("id", short_id(F.col("id"), F.col("session_token")).alias("short_id"), F.coalesce("message_count", F.lit(0)).alias("message_count"), "band", "date_created")


def low_confidence_streak(messages: DataFrame, floor: float = 0.35, threshold: int = 2, ended: Column | None = None) -> DataFrame:
    """Running count of low-confidence bot turns per session; a confident turn, or a message marked ``ended``, starts anew."""
    judged = (F.col("role") == "bot") & F.col("context_chunks").isNotNull()
    low = judged & (F.coalesce("confidence", F.lit(0.0)) < floor)
    reset = ((judged & ~low) | (F.lit(False) if ended is None else ended)).cast("int")
    w = Window.partitionBy("session_id").orderBy("id")
    m = messages.withColumn("island", F.sum(reset).over(w))
    m = m.withColumn("streak", F.sum(low.cast("int")).over(Window.partitionBy("session_id", "island").orderBy("id")))
    return m.where(judged).select(F.col("id").alias("message_id"), "streak", (F.col("streak") >= threshold).alias("offer_human"))


#: What a model puts into a reply to offer a person (fixed value).
HANDOFF_TOKEN = "[[HANDOFF_OFFER]]"


def offers(replies: DataFrame, out_of_scope: Column | None = None, channels: bool = True, **streak: float) -> DataFrame:
    """(message_id, reply, streak, offer_human) of bot replies as the model gave them, the token taken out.

    A person is offered after a streak of low confidence (of turns that searched; ``streak`` goes to it) or by the token;
    not for requests that are out of scope, and never without a ``channels`` to offer.
    """
    said = F.contains("content", F.lit(HANDOFF_TOKEN))
    clean = F.btrim(F.regexp_replace("content", r"(?U)\s*\[\[HANDOFF_OFFER\]\]\s*", ""), F.lit(" \t\n\r\0\x0b"))
    barred = F.lit(not channels) if out_of_scope is None else F.lit(not channels) | F.coalesce(out_of_scope, F.lit(False))
    bot = replies.where("role = 'bot'").select(F.col("id").alias("message_id"), F.when(said, clean).otherwise(F.col("content")).alias("reply"), F.coalesce(said, F.lit(False)).alias("_said"), barred.alias("_barred"))
    out = bot.join(low_confidence_streak(replies, **streak), "message_id", "left")
    return out.select("message_id", "reply", "streak", (~F.col("_barred") & (F.col("_said") | F.coalesce("offer_human", F.lit(False)))).alias("offer_human"))


def previous_question() -> Column:
    w = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w)


def gap_list(messages: DataFrame, floor: float = 0.35, include_resolved: bool = False) -> DataFrame:
    """Bot turns that left a question open, with the latest user message before and the reason."""
    m = messages.withColumn("question", previous_question())
    weak = (F.col("context_chunks") == 0) | F.coalesce(F.col("rating") == -1, F.lit(False)) | F.col("offer_human") | F.coalesce(F.col("confidence") < floor, F.lit(False))
    m = m.where((F.col("role") == "bot") & F.col("context_chunks").isNotNull() & weak)
    if not include_resolved:
        m = m.where(~F.col("gap_resolved"))
    reason = F.when(F.col("context_chunks") == 0, "no_context").when(F.col("rating") == -1, "rated_down").when(F.coalesce("confidence", F.lit(0.0)) < floor, "low_confidence").otherwise("offered_human")
    return m.select("id", "session_id", "question", F.col("content").alias("answer"), reason.alias("reason"), "date_created")


def common_gap_questions(gaps: DataFrame, limit: int = 10, drop_redacted: bool = False) -> DataFrame:
    """The most frequent open questions, whatever their marks and case, in their first spelling."""
    if drop_redacted:
        gaps = gaps.where(F.col("question") != "[redacted]")
    key = F.regexp_replace(F.btrim(F.lower(F.regexp_replace("question", r"[^\p{L}\p{N}\s]", "")), F.lit(" \t\n\r")), r"\s+", " ")
    g = gaps.withColumn("key", key).where("key <> ''")
    return g.groupBy("key").agg(F.min_by("question", "id").alias("question"), F.count("*").alias("hits")).orderBy(F.desc("hits"), "key").limit(limit).select("question", "hits")


def promote_to_qa(messages: DataFrame, picked: DataFrame) -> DataFrame:
    """QA rows of the picked bot messages (message_id, answer; null: the message) and the question before each."""
    m = messages.withColumn("question", previous_question()).where("role = 'bot'")
    out = m.join(picked, F.col("id") == F.col("message_id")).where("question IS NOT NULL")
    return out.select("question", F.coalesce("answer", "content").alias("answer"), F.lit("chat").alias("source"), F.col("id").alias("source_message_id"))


def recent_history(messages: DataFrame, n: int = 12) -> DataFrame:
    """For each message the last n of the talk before it, oldest first."""
    m = messages.where(F.col("role").isin(*TALK))
    w = Window.partitionBy("session_id").orderBy("id").rowsBetween(-n, -1)
    return m.select(F.col("id").alias("message_id"), F.collect_list(F.struct("id", "role", "content")).over(w).alias("history"))


def unanswered_turns(sessions: DataFrame, messages: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """Sessions without an agent whose last word is the user's: in flight, or dead after some seconds."""
    last = messages.where(F.col("role").isin(*TALK)).groupBy("session_id").agg(F.max_by(F.struct("role", "date_created"), "id").alias("m"))
    free = sessions.where(~F.col("handoff_status").isin("requested", "active")).select(F.col("id").alias("session_id"))
    age = _seconds(now) - _seconds("m.date_created")
    return last.join(free, "session_id", "left_semi").where("m.role = 'user'").select("session_id", F.when(age < seconds, "in_flight").otherwise("dead").alias("state"))


def unread_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """User messages after the agent's last reading, for every waiting or active session."""
    s = sessions.where(F.col("handoff_status").isin("requested", "active")).select(F.col("id").alias("session_id"), "admin_last_read_at")
    u = messages.where("role = 'user'").select("session_id", "date_created")
    new = F.col("admin_last_read_at").isNull() | (F.col("date_created") > F.col("admin_last_read_at"))
    return s.join(u, "session_id", "left").groupBy("session_id").agg(F.count_if(F.col("date_created").isNotNull() & new).alias("unread"))


def ranked(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """``df`` with ``position`` from 1 in each ``group`` by ``order``, which must leave no ties; no task sees a whole group.

    Rows are dealt out by ranges of (group, order) and sorted there; a row's position is its place in its range plus the rows
    of its group in the ranges before, of which there is one count per range and group.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    dealt = stored(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = dealt.join(F.broadcast(counts), [group, "_range"])  # a row per range and group
    return out.withColumn("position", (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_range", "_at", "_first", "_before")


def handoff_queue(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Waiting and active sessions in the order agents see them, with the last message and unread count."""
    last = messages.groupBy("session_id").agg(F.substring(F.max_by("content", "id"), 1, 80).alias("last_message"))
    s = sessions.withColumn("queue", F.when(F.col("handoff_status") == "requested", "waiting").when((F.col("handoff_status") == "active") & F.col("chat_ended_at").isNull(), "active")).where("queue IS NOT NULL")
    waiting, active = F.col("queue") == "waiting", F.col("queue") == "active"
    s = s.select("queue", F.col("id").alias("session_id"), "starred", F.when(waiting, F.col("handoff_requested_at")).alias("_asked"), F.when(active, F.col("handoff_started_at")).alias("_begun"), F.when(active, -F.col("id")).otherwise(F.col("id")).alias("_id"))
    s = ranked(s, "queue", F.col("starred").desc(), F.col("_asked").asc_nulls_first(), F.col("_begun").desc_nulls_last(), F.col("_id").asc()).select("queue", "position", "session_id")
    return s.join(last, "session_id", "left").join(unread_counts(sessions, messages), "session_id", "left").select("queue", "position", "session_id", "last_message", F.coalesce("unread", F.lit(0)).alias("unread_count"))


def badge_counts(sessions: DataFrame, messages: DataFrame, contacts: DataFrame, submissions: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Per agent (of ``agents``, or those of any session): waiting, own active and unread sessions, and new leads."""
    waiting = sessions.agg(F.count_if(F.col("handoff_status") == "requested").alias("waiting"))
    leads = contacts.agg(F.count_if(F.col("status") == "new").alias("c")).crossJoin(submissions.agg(F.count_if(F.col("read_at").isNull()).alias("u"))).select((F.col("c") + F.col("u")).alias("leads"))
    mine = sessions.where("handoff_status = 'active' AND chat_ended_at IS NULL AND handoff_admin_id IS NOT NULL").select(F.col("id").alias("session_id"), F.col("handoff_admin_id").alias("admin_id"))
    agents = sessions.where("handoff_admin_id IS NOT NULL").select(F.col("handoff_admin_id").alias("admin_id")).distinct() if agents is None else agents.select("admin_id").distinct()
    per = mine.join(unread_counts(sessions, messages), "session_id", "left").groupBy("admin_id").agg(F.count("*").alias("active"), F.sum("unread").alias("unread"))
    per = agents.join(per, "admin_id", "left").na.fill(0, ["active", "unread"])
    return per.crossJoin(waiting).crossJoin(leads).select("admin_id", "waiting", "active", "unread", (F.col("waiting") + F.col("active")).alias("total"), "leads")


def sweep_inactive(sessions: DataFrame, messages: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Waiting and active sessions whose last activity of any kind is older than the cutoff."""
    last = messages.groupBy(F.col("session_id").alias("id")).agg(F.max("date_created").alias("m"))
    s = sessions.where(F.col("handoff_status").isin("requested", "active") & F.col("chat_ended_at").isNull()).join(last, "id", "left")
    at = F.greatest("m", "admin_last_read_at", "user_last_read_at", "handoff_started_at", "handoff_requested_at")
    return s.select(F.col("id").alias("session_id"), at.alias("last_activity")).where(F.col("last_activity") < _minus(now, minutes))


def contact_prompts(sessions: DataFrame, contacts: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Waiting sessions to be asked for contact details."""
    s = sessions.where("handoff_status = 'requested' AND handoff_requested_at IS NOT NULL").join(contacts.select(F.col("session_id").alias("id")), "id", "left_anti")
    if minutes <= 0:
        return s.where("false").select(F.col("id").alias("session_id"))
    return s.where(F.col("contact_prompted_at").isNotNull() | (F.col("handoff_requested_at") <= _minus(now, minutes))).select(F.col("id").alias("session_id"))


SOURCES = ("ai_unanswered", "handoff_timeout", "manual")
EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$"


def contact_capture(requests: DataFrame) -> DataFrame:
    """Lead requests with blanks as null, a known source, and whether they are accepted."""
    def clean(c: str) -> Column:
        x = F.btrim(F.col(c), F.lit(" \t\n\r\0\x0b"))
        return F.when(x != "", x)

    r = requests.withColumns({c: clean(c) for c in ("email", "phone")}).withColumn("source", F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise("ai_unanswered"))
    reason = F.when(F.col("email").isNull() & F.col("phone").isNull(), "no_contact").when(F.col("email").isNotNull() & ~F.rlike("email", F.lit(EMAIL)), "bad_email")
    return r.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def contact_list(contacts: DataFrame, sessions: DataFrame, status: str = "", page: int = 1, per_page: int = 25) -> DataFrame:
    """A page of leads with the session's token; without a status all but deleted ones."""
    c = contacts.where(F.col("status") == status if status else F.col("status") != "deleted")
    out = c.join(sessions.select(F.col("id").alias("session_id"), "session_token"), "session_id", "left")
    return out.orderBy("status", F.desc("id")).offset((page - 1) * per_page).limit(per_page).select("id", "session_id", "session_token", "email", "phone", "source", "status")


def resolve_site(df: DataFrame, url_col: str, sites: DataFrame) -> DataFrame:
    """``df`` with the site whose base URL is the longest prefix of the page URL, the smaller id of equal ones; blank bases fit nothing.

    Every URL is cut at the lengths that base URLs have (settings, few), so that prefixes meet bases by an equi-join.
    """
    bases = sites.select("site_id", F.rtrim(F.col("base_url"), F.lit("/")).alias("_base")).where("_base <> ''").groupBy("_base").agg(F.min("site_id").alias("site_id"))
    lengths = [r["n"] for r in bases.select(F.length("_base").alias("n")).distinct().collect()]
    cuts = F.array(*(F.substring("_url", 1, n) for n in lengths)).cast("array<string>")
    urls = df.select(F.col(url_col).alias("_url")).distinct().select("_url", F.explode(F.array_distinct(cuts)).alias("_base"))
    found = urls.join(bases, "_base").groupBy("_url").agg(F.max_by("site_id", F.length("_base")).alias("site_id"))
    return df.join(found, F.col(url_col) == F.col("_url"), "left").drop("_url")


def submission_list(submissions: DataFrame, form: str = "", status: str = "", page: int = 1, per_page: int = 25) -> DataFrame:
    s = submissions.where(F.col("form_name") == form) if form else submissions
    s = s.where(F.col("status") == status) if status else s
    return s.orderBy(F.desc("id")).offset((page - 1) * per_page).limit(per_page)


def submission_counts(submissions: DataFrame) -> DataFrame:
    return submissions.agg(F.count_if(F.col("read_at").isNull()).alias("unread"), F.count_if(F.col("status").isin("pending", "failed")).alias("undelivered"))


def purge_logs(sessions: DataFrame, messages: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """What stays of sessions and messages when sessions older than some days go; 0 keeps all."""
    if days <= 0:
        return sessions, messages
    old = sessions.where(F.col("date_created") < _minus(now, days * 1440)).select(F.col("id").alias("session_id"))
    return sessions.join(old, sessions["id"] == old["session_id"], "left_anti"), messages.join(old, "session_id", "left_anti")


def messages_after(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages of each session after its cursor (session_id, after_id)."""
    return messages.join(cursors, "session_id").where("id > after_id").select("session_id", "id", "role", "content")


def short_id(id: Column, token: Column) -> Column:
    return F.concat(F.lpad(id.cast("string"), F.greatest(F.lit(5), F.length(id.cast("string"))), F.lit("0")), F.lit("-"), F.upper(F.substring(token, 1, 4)))


def local_time(ts: Column, tz: str, fmt: str = "HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), fmt)
