"""Queries over conversations and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.operators import changes as G
from deskmill.operators import conversations as C
from deskmill.plans.views import ctes, view

QUERIES, ORACLES = {}, {}


def query(sql: str, *names: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))
        QUERIES[f.__name__].__doc__ = f.__doc__
        ORACLES[f.__name__] = ctes(*names) + (", " if sql.startswith("+") else " ") + sql.lstrip("+")
        return f

    return add


#: The clock of the queries: fixed, so that both sides read the same.
NOW, START, END = (lambda t=t: F.expr(f"TIMESTAMP_NTZ'{t}'") for t in ("2024-01-09 08:00:00", "2024-01-02 06:00:00", "2024-01-07 05:00:00"))
_NOW, _START, _END = "TIMESTAMP '2024-01-09 08:00:00'", "TIMESTAMP '2024-01-02 06:00:00'", "TIMESTAMP '2024-01-07 05:00:00'"
_TALK = "('user','bot','admin')"
_ROLL = f"""rollup_ AS (SELECT session_id, count(*) FILTER (role IN {_TALK}) AS message_count, count(*) FILTER (role='bot' AND rating=1) AS rating_positive, count(*) FILTER (role='bot' AND rating=-1) AS rating_negative,
 max(confidence) FILTER (role='bot') AS max_confidence, max(date_created) AS last_message_at FROM messages GROUP BY session_id)"""
_UNREAD = "unread_ AS (SELECT s.id AS session_id, count(m.id) AS unread FROM sessions s LEFT JOIN messages m ON m.session_id=s.id AND m.role='user' AND (s.admin_last_read_at IS NULL OR m.date_created>s.admin_last_read_at) WHERE s.handoff_status IN ('requested','active') GROUP BY s.id)"
_PREV = "prev_ AS (SELECT *, last_value(CASE WHEN role='user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM messages)"
_GAPS = _PREV + """, gaps_ AS (SELECT id, session_id, question, content AS answer, CASE WHEN context_chunks=0 THEN 'no_context' WHEN rating=-1 THEN 'rated_down' WHEN coalesce(confidence,0)<0.35 THEN 'low_confidence' ELSE 'offered_human' END AS reason, date_created
 FROM prev_ WHERE role='bot' AND context_chunks IS NOT NULL AND NOT gap_resolved AND (context_chunks=0 OR coalesce(rating=-1,false) OR offer_human OR coalesce(confidence<0.35,false)))"""
_BAND = "CASE WHEN max_confidence IS NULL THEN 'none' WHEN max_confidence>=0.8 THEN 'high' WHEN max_confidence>=0.6 THEN 'mid' ELSE 'low' END"
_SHORT = "concat(lpad(CAST(id AS VARCHAR), CAST(greatest(5, length(CAST(id AS VARCHAR))) AS INTEGER), '0'), '-', upper(substring(session_token,1,4)))"


@query(f"""SELECT s.n AS sessions, m.n AS messages, m.art AS avg_response_time, m.p+s.p AS positive, m.ng+s.ng AS negative, round(s.n/4.0::DOUBLE,2) AS per_day, a.n AS active_now
 FROM (SELECT count(*) n, count(*) FILTER (chat_rating=1) p, count(*) FILTER (chat_rating=-1) ng FROM sessions WHERE date_created BETWEEN {_START} AND {_END}) s,
 (SELECT count(*) n, round(coalesce(avg(response_time) FILTER (role='bot'),0),3) art, count(*) FILTER (rating=1) p, count(*) FILTER (rating=-1) ng FROM messages WHERE date_created BETWEEN {_START} AND {_END}) m,
 (SELECT count(*) n FROM sessions s WHERE chat_ended_at IS NULL AND EXISTS (SELECT 1 FROM messages m WHERE m.session_id=s.id AND m.date_created>={_NOW}-INTERVAL 15 MINUTE)) a""", "sessions", "messages")
def e1_stats_summary(s, m):
    return C.stats_summary(s, m, START(), END(), NOW())


@query(f"""SELECT CAST(d AS DATE) AS date, (SELECT count(*) FROM sessions WHERE date_created BETWEEN {_START} AND {_END} AND CAST(date_created AS DATE)=CAST(d AS DATE)) AS conversations,
 (SELECT count(*) FROM messages WHERE date_created BETWEEN {_START} AND {_END} AND CAST(date_created AS DATE)=CAST(d AS DATE)) AS messages FROM (SELECT unnest(generate_series({_START},{_END},INTERVAL 1 DAY)) AS d)""", "sessions", "messages")
def e2_activity(s, m):
    return C.activity(s, m, START(), END())


@query(f"SELECT id AS session_id FROM sessions s WHERE chat_ended_at IS NULL AND EXISTS (SELECT 1 FROM messages m WHERE m.session_id=s.id AND m.date_created>={_NOW}-INTERVAL 240 MINUTE)", "sessions", "messages")
def e3_active_now(s, m):
    return C.active_now(s, m, NOW(), 240)


@query("SELECT suggestion, count(*) AS clicks, max(ts) AS last_clicked_at FROM clicks GROUP BY suggestion", "clicks")
def e4_suggestion_stats(clicks):
    return C.suggestion_stats(clicks)


@query(f"+{_ROLL} SELECT * FROM rollup_", "messages")
def e5_session_rollup(m):
    return C.session_rollup(m)


@query(f"+{_ROLL} SELECT id, {_SHORT} AS short_id, coalesce(message_count,0) AS message_count, {_BAND} AS band, date_created FROM sessions LEFT JOIN rollup_ ON id=session_id WHERE (contains(lower(session_token),'the') OR coalesce(contains(lower(admin_notes),'the'),false) OR EXISTS (SELECT 1 FROM messages m WHERE m.session_id=sessions.id AND contains(lower(m.content),'the'))) AND ({_BAND})='high' ORDER BY date_created DESC, id DESC LIMIT 25", "sessions", "messages")
def e6_search_sessions(s, m):
    return C.search_sessions(s, m, NOW(), "The", confidence="high")


@query("""+t_ AS (SELECT *, role='bot' AND context_chunks IS NOT NULL AS judged FROM messages), u_ AS (SELECT *, judged AND coalesce(confidence,0)<0.35 AS low FROM t_),
 i_ AS (SELECT *, sum(CASE WHEN judged AND NOT low THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id) AS island FROM u_),
 s_ AS (SELECT id AS message_id, judged, CAST(sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY id) AS BIGINT) AS streak FROM i_) SELECT message_id, streak, streak>=2 AS offer_human FROM s_ WHERE judged""", "messages")
def e7_low_confidence_streak(m):
    return C.low_confidence_streak(m)


@query("""+t_ AS (SELECT *, role='bot' AND context_chunks IS NOT NULL AS judged FROM messages), u_ AS (SELECT *, judged AND coalesce(confidence,0)<0.35 AS low FROM t_),
 i_ AS (SELECT *, sum(CASE WHEN judged AND NOT low THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id) AS island FROM u_),
 s_ AS (SELECT *, CASE WHEN judged THEN CAST(sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY id) AS BIGINT) END AS streak FROM i_)
 SELECT id AS message_id, CASE WHEN id%7=0 THEN trim(content, ' '||chr(9)||chr(10)||chr(11)||chr(13))||'Bye' ELSE content END AS reply, streak, id%17<>0 AND (id%7=0 OR coalesce(streak>=2,false)) AS offer_human FROM s_ WHERE role='bot'""", "messages")
def e7_offers(m):
    """Every seventh reply has the token in its last line; requests are out of scope by a rule on ids."""
    m = m.withColumn("content", F.expr("CASE WHEN id % 7 = 0 THEN concat(trim(BOTH ' \\t\\n\\u000B\\r' FROM content), ' \\n[[HANDOFF_OFFER]] Bye') ELSE content END"))
    return C.offers(m, out_of_scope=F.col("id") % 17 == 0)


@query(f"+{_GAPS} SELECT * FROM gaps_", "messages")
def e8_gap_list(m):
    return C.gap_list(m)


@query(f"""+{_GAPS}, k_ AS (SELECT *, regexp_replace(trim(lower(regexp_replace(question,'[^\\p{{L}}\\p{{N}}\\s]','','g')), ' ' || chr(9) || chr(10) || chr(13)),'\\s+',' ','g') AS key FROM gaps_ WHERE question IS NOT NULL)
 SELECT arg_min(question,id) AS question, count(*) AS hits FROM k_ WHERE key<>'' GROUP BY key ORDER BY hits DESC, key LIMIT 10""", "messages")
def e9_common_gap_questions(m):
    return C.common_gap_questions(C.gap_list(m))


@query(f"+{_PREV} SELECT question, content AS answer, 'chat' AS source, id AS source_message_id FROM prev_ WHERE role='bot' AND rating=-1 AND question IS NOT NULL", "messages")
def e10_promote_to_qa(m):
    return C.promote_to_qa(m, m.where("rating = -1").select(F.col("id").alias("message_id"), F.lit(None).cast("string").alias("answer")))


@query(f"SELECT id AS message_id, (SELECT string_agg(CAST(h.id AS VARCHAR) || h.role, ',' ORDER BY h.id) FROM (SELECT * FROM messages b WHERE b.session_id=a.session_id AND b.id<a.id AND b.role IN {_TALK} ORDER BY b.id DESC LIMIT 3) h) AS history FROM messages a WHERE role IN {_TALK}", "messages")
def e11_recent_history(m):
    h = C.recent_history(m, 3)
    joined = F.array_join(F.transform("history", lambda x: F.concat(x["id"].cast("string"), x["role"])), ",")
    return h.select("message_id", F.when(F.size("history") > 0, joined).alias("history"))


@query(f"""+l_ AS (SELECT session_id, arg_max(role,id) AS role, arg_max(date_created,id) AS at_ FROM messages WHERE role IN {_TALK} GROUP BY session_id)
 SELECT session_id, CASE WHEN date_diff('second', at_, {_NOW})<180 THEN 'in_flight' ELSE 'dead' END AS state FROM l_ JOIN sessions ON id=session_id WHERE role='user' AND handoff_status NOT IN ('requested','active')""", "sessions", "messages")
def e12_unanswered_turns(s, m):
    return C.unanswered_turns(s, m, NOW())


@query(f"""+{_UNREAD}, l_ AS (SELECT session_id, substring(arg_max(content,id),1,80) AS last_message FROM messages GROUP BY session_id),
 q_ AS (SELECT *, CASE WHEN handoff_status='requested' THEN 'waiting' ELSE 'active' END AS queue FROM sessions WHERE handoff_status='requested' OR (handoff_status='active' AND chat_ended_at IS NULL))
 SELECT queue, CAST(row_number() OVER (PARTITION BY queue ORDER BY starred DESC, CASE WHEN queue='waiting' THEN handoff_requested_at END, CASE WHEN queue='active' THEN handoff_started_at END DESC, CASE WHEN queue='active' THEN -id ELSE id END) AS INTEGER) AS position, id AS session_id, last_message, coalesce(unread,0) AS unread_count
 FROM q_ LEFT JOIN l_ ON l_.session_id=id LEFT JOIN unread_ u ON u.session_id=id""", "sessions", "messages")
def e13_handoff_queue(s, m):
    return C.handoff_queue(s, m)


@query(f"+{_UNREAD} SELECT * FROM unread_", "sessions", "messages")
def e14_unread_counts(s, m):
    return C.unread_counts(s, m)


@query(f"""+{_UNREAD}, w_ AS (SELECT count(*) AS waiting FROM sessions WHERE handoff_status='requested'), n_ AS (SELECT (SELECT count(*) FROM contacts WHERE status='new')+(SELECT count(*) FROM submissions WHERE read_at IS NULL) AS leads),
 a_ AS (SELECT handoff_admin_id AS admin_id, count(*) AS active, CAST(sum(unread) AS BIGINT) AS unread FROM sessions JOIN unread_ ON id=session_id WHERE handoff_status='active' AND chat_ended_at IS NULL GROUP BY 1),
 g_ AS (SELECT DISTINCT handoff_admin_id AS admin_id FROM sessions WHERE handoff_admin_id IS NOT NULL)
 SELECT admin_id, waiting, coalesce(active,0) AS active, coalesce(unread,0) AS unread, waiting+coalesce(active,0) AS total, leads FROM g_ LEFT JOIN a_ USING (admin_id), w_, n_""", "sessions", "messages", "contacts", "submissions")
def e14_badge_counts(s, m, c, f):
    return C.badge_counts(s, m, c, f)


@query(f"""+l_ AS (SELECT session_id, max(date_created) AS m FROM messages GROUP BY session_id), s_ AS (SELECT id AS session_id, greatest(m, admin_last_read_at, user_last_read_at, handoff_started_at, handoff_requested_at) AS last_activity FROM sessions LEFT JOIN l_ ON session_id=id WHERE handoff_status IN ('requested','active') AND chat_ended_at IS NULL)
 SELECT * FROM s_ WHERE last_activity < {_NOW} - INTERVAL 15 MINUTE""", "sessions", "messages")
def e15_sweep_inactive(s, m):
    return C.sweep_inactive(s, m, NOW(), 15)


@query(f"SELECT id AS session_id FROM sessions s WHERE handoff_status='requested' AND handoff_requested_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM contacts c WHERE c.session_id=s.id) AND (contact_prompted_at IS NOT NULL OR handoff_requested_at <= {_NOW} - INTERVAL 5 MINUTE)", "sessions", "contacts")
def e16_contact_prompts(s, c):
    return C.contact_prompts(s, c.where("id % 3 = 0"), NOW())


ORACLES["e16_contact_prompts"] = ORACLES["e16_contact_prompts"].replace("FROM contacts c WHERE", "FROM contacts c WHERE c.id%3=0 AND")


@query("SELECT id, email, phone, CASE WHEN source IN ('ai_unanswered','handoff_timeout','manual') THEN source ELSE 'ai_unanswered' END AS source, (email IS NOT NULL OR phone IS NOT NULL) AS accepted, CASE WHEN email IS NULL AND phone IS NULL THEN 'no_contact' END AS reject_reason FROM contacts", "contacts")
def e17_contact_capture(c):
    return C.contact_capture(c).select("id", "email", "phone", "source", "accepted", "reject_reason")


@query("SELECT c.id, c.session_id, s.session_token, email, phone, source, status FROM contacts c LEFT JOIN sessions s ON s.id=c.session_id WHERE status<>'deleted' ORDER BY status, c.id DESC LIMIT 25", "contacts", "sessions")
def e17_contact_list(c, s):
    return C.contact_list(c, s)


@query("SELECT id, page_url, (SELECT arg_max(site_id, length(base_url)) FROM sites WHERE starts_with(page_url, rtrim(base_url,'/'))) AS site_id FROM sessions", "sessions", "sites")
def e18_resolve_site(s, sites):
    return C.resolve_site(s.select("id", "page_url"), "page_url", sites).select("id", "page_url", "site_id")


@query("SELECT * FROM submissions WHERE form_name='form1' AND status='sent' ORDER BY id DESC LIMIT 25", "submissions")
def e21_submission_list(s):
    return C.submission_list(s, "form1", "sent")


@query("SELECT count(*) FILTER (read_at IS NULL) AS unread, count(*) FILTER (status IN ('pending','failed')) AS undelivered FROM submissions", "submissions")
def e21_submission_counts(s):
    return C.submission_counts(s)


@query(f"SELECT id, session_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.id=m.session_id AND s.date_created < {_NOW} - INTERVAL 5 DAY)", "sessions", "messages")
def e23_purge_logs(s, m):
    return C.purge_logs(s, m, NOW(), 5)[1].select("id", "session_id")


@query("SELECT m.session_id, m.id, m.role, m.content FROM messages m JOIN sessions s ON s.id=m.session_id WHERE m.id > s.id*1000+2", "sessions", "messages")
def e24_messages_after(s, m):
    return C.messages_after(m, s.select(F.col("id").alias("session_id"), (F.col("id") * 1000 + 2).alias("after_id")))


@query(f"SELECT id, {_SHORT} AS short_id, strftime(date_created AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo', '%H:%M') AS local_time FROM sessions", "sessions")
def e25_short_id_local_time(s):
    return s.select("id", C.short_id(F.col("id"), F.col("session_token")).alias("short_id"), C.local_time(F.col("date_created"), "Asia/Tokyo").alias("local_time"))


_SWEPT = f"""l_ AS (SELECT session_id, max(date_created) AS m FROM messages GROUP BY session_id),
 x_ AS (SELECT id AS sid FROM sessions LEFT JOIN l_ ON session_id=id WHERE handoff_status IN ('requested','active') AND chat_ended_at IS NULL AND greatest(m, admin_last_read_at, user_last_read_at, handoff_started_at, handoff_requested_at) < {_NOW} - INTERVAL 15 MINUTE)"""


@query(f"""+{_SWEPT} SELECT id, CASE WHEN sid IS NULL THEN handoff_status ELSE 'ended' END AS handoff_status, CASE WHEN sid IS NOT NULL THEN {_NOW} END AS handoff_ended_at,
 CASE WHEN sid IS NULL THEN chat_ended_at ELSE {_NOW} END AS chat_ended_at, CASE WHEN sid IS NULL THEN CAST(id%4 AS INTEGER) ELSE 0 END AS low_conf_streak, session_token FROM sessions LEFT JOIN x_ ON sid=id""", "sessions", "messages")
def e15_sessions_after_sweep(s, m):
    s = s.withColumns({"handoff_ended_at": F.expr("CAST(NULL AS TIMESTAMP_NTZ)"), "low_conf_streak": (F.col("id") % 4).cast("int")})
    return G.apply_changes(s, G.closing_changes(s, m, NOW()), "sessions").select("id", "handoff_status", "handoff_ended_at", "chat_ended_at", "low_conf_streak", "session_token")


@query(f"""+{_SWEPT} SELECT id, session_id, role, content, confidence, date_created FROM messages UNION ALL
 SELECT (SELECT max(id) FROM messages) + row_number() OVER (ORDER BY sid), sid, 'system', 'Conversation auto-closed after 15 minutes of inactivity.', NULL, {_NOW} FROM x_""", "sessions", "messages")
def e15_messages_after_sweep(s, m):
    return G.apply_changes(m, G.closing_changes(s, m, NOW()), "messages").select("id", "session_id", "role", "content", "confidence", "date_created")


def _picked(m: DataFrame) -> DataFrame:
    """Answers to the gaps of all messages rated down; some are blank, and change nothing."""
    return C.gap_list(m).where("reason = 'rated_down'").selectExpr("id AS message_id", "CAST(NULL AS string) AS question", "CASE WHEN id % 5 = 0 THEN '  ' WHEN id % 5 = 1 THEN concat(' See ', id) END AS answer", "session_id % 3 AS site_id", "id % 2 = 0 AS translate")


_PICKED = _GAPS + f""", w_ AS (SELECT chr(9)||chr(10)||chr(11)||chr(13)||' ' AS ws), p_ AS (SELECT id AS mid, trim(question, ws) AS q, trim(CASE WHEN id%5=0 THEN '  ' WHEN id%5=1 THEN concat(' See ', id) ELSE answer END, ws) AS a, nullif(session_id%3,0) AS site, id%2=0 AS tr FROM gaps_, w_ WHERE reason='rated_down'),
 y_ AS (SELECT * FROM p_ WHERE q<>'' AND a<>'')"""


@query(f"""+{_PICKED} SELECT id, question, answer, NULL AS source, NULL AS source_message_id, active, site_id, translate FROM qa UNION ALL
 SELECT (SELECT max(id) FROM qa) + row_number() OVER (ORDER BY mid), q, a, 'chat', mid, true, site, site IS NULL AND tr FROM y_""", "messages", "qa")
def e10_qa_after_promotion(m, qa):
    qa = qa.withColumns({"source": F.lit(None).cast("string"), "source_message_id": F.lit(None).cast("long")})
    return G.apply_changes(qa, G.promotion_changes(m, qa, _picked(m), NOW()), "qa").select("id", "question", "answer", "source", "source_message_id", "active", "site_id", "translate")


@query(f"""+{_PICKED} SELECT id, content, mid IS NOT NULL AS used_as_qa, gap_resolved OR mid IS NOT NULL AS gap_resolved, CASE WHEN mid IS NOT NULL THEN {_NOW} END AS gap_resolved_at FROM messages LEFT JOIN y_ ON mid=id""", "messages", "qa")
def e10_messages_after_promotion(m, qa):
    m = m.withColumns({"used_as_qa": F.lit(False), "gap_resolved_at": F.expr("CAST(NULL AS TIMESTAMP_NTZ)")})
    return G.apply_changes(m, G.promotion_changes(m, qa, _picked(m), NOW()), "messages").select("id", "content", "used_as_qa", "gap_resolved", "gap_resolved_at")
