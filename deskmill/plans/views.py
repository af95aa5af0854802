"""Tables of the data model, derived from the plain tables by integer arithmetic, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VIEWS = {
    "sites": "SELECT * FROM (VALUES (1,'en','en','http://example.com'),(2,'fr','fr','http://example.com/fr'),(3,'de','de','http://example.com/de'),(4,'es','es','http://example.org')) AS t(site_id, handle, language, base_url)",
    "messages": """SELECT conv_id*1000+turn AS id, conv_id AS session_id,
  CASE WHEN role='assistant' AND conv_id%10=7 AND turn>=4 THEN 'admin' WHEN role='assistant' THEN 'bot' ELSE role END AS role, text AS content,
  CASE WHEN role='assistant' THEN CAST((conv_id*7+turn*13)%100 AS DOUBLE)/100 END AS confidence,
  CASE WHEN role='assistant' AND (conv_id+turn)%11<>0 THEN (conv_id*3+turn)%6 END AS context_chunks,
  CASE WHEN role='assistant' THEN CAST((conv_id*17+turn*5)%4000 AS DOUBLE)/1000 END AS response_time,
  CASE WHEN role='assistant' AND (conv_id+turn*5)%10=0 THEN 1 WHEN role='assistant' AND (conv_id+turn*5)%10=1 THEN -1 END AS rating,
  (role='assistant' AND (conv_id*5+turn)%9=0) AS offer_human, (conv_id%13=0) AS gap_resolved, {TS:conv_id*7200+turn*40} AS date_created FROM {conversations}""",
    "sessions": """SELECT conv_id AS id, md5(CAST(conv_id AS {STR})) AS session_token, concat('10.0.', CAST(conv_id%7 AS {STR}), '.', CAST(conv_id%5 AS {STR})) AS ip,
  CASE conv_id%4 WHEN 0 THEN 'http://example.com/fr/a' WHEN 1 THEN 'http://example.com/b' WHEN 2 THEN 'http://example.org/c' ELSE 'http://other.net/d' END AS page_url,
  CASE conv_id%5 WHEN 0 THEN 'requested' WHEN 1 THEN 'active' WHEN 2 THEN 'ended' ELSE 'none' END AS handoff_status,
  CASE WHEN conv_id%5 IN (1,2) THEN 100+conv_id%3 END AS handoff_admin_id, CASE WHEN conv_id%5<3 THEN {TS:conv_id*7200+60} END AS handoff_requested_at,
  CASE WHEN conv_id%5 IN (1,2) THEN {TS:conv_id*7200+90} END AS handoff_started_at, CASE WHEN conv_id%5=2 THEN {TS:conv_id*7200+3000} END AS chat_ended_at,
  CASE WHEN conv_id%3=0 THEN {TS:conv_id*7200+100} END AS admin_last_read_at, CASE WHEN conv_id%4=0 THEN {TS:conv_id*7200+200} END AS user_last_read_at,
  CASE WHEN conv_id%10=5 THEN {TS:conv_id*7200+400} END AS contact_prompted_at, CASE conv_id%6 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS chat_rating,
  (conv_id%8=0) AS starred, CASE WHEN conv_id%9=0 THEN 'call back' END AS admin_notes, {TS:conv_id*7200} AS date_created FROM (SELECT DISTINCT conv_id FROM {conversations}) c""",
    "contacts": """SELECT conv_id AS id, conv_id AS session_id, CASE WHEN conv_id%2=0 THEN concat('u',CAST(conv_id AS {STR}),'@example.com') END AS email,
  CASE WHEN conv_id%3=0 THEN '555-0100' END AS phone, CASE conv_id%3 WHEN 0 THEN 'ai_unanswered' WHEN 1 THEN 'handoff_timeout' ELSE 'manual' END AS source,
  CASE conv_id%4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'deleted' ELSE 'new' END AS status, {TS:conv_id*7200+500} AS date_created FROM (SELECT DISTINCT conv_id FROM {conversations}) c WHERE conv_id%5 IN (0,3)""",
    "bans": """SELECT DISTINCT concat('10.0.', CAST(user_id%7 AS {STR}), '.', CAST(user_id%5 AS {STR})) AS ip, CASE WHEN user_id%7=0 THEN NULL ELSE {TS:(user_id%5)*259200} END AS expires_at FROM {events} WHERE user_id%7 IN (0,3)""",
    "chunks": """SELECT d.doc_id AS id, CASE d.doc_id%3 WHEN 0 THEN 'file' WHEN 1 THEN 'url' ELSE 'entry' END AS source_type, d.doc_id AS source_id,
  CASE WHEN d.doc_id%5=0 THEN NULL WHEN d.lang='en' THEN 1 WHEN d.lang='fr' THEN 2 WHEN d.lang='de' THEN 3 ELSE 4 END AS site_id,
  d.lang AS language, 0 AS position, d.text AS content, e.embedding AS embedding FROM (SELECT *, doc_id%(SELECT count(*) FROM {embeddings}) AS v FROM {documents}) d JOIN {embeddings} e ON e.vec_id=d.v""",
    "queries": """SELECT b.item_id AS query_id, b.text AS text, CASE WHEN b.item_id%5=0 THEN NULL ELSE b.item_id%5 END AS site_id, e.embedding AS vector FROM (SELECT *, (item_id*7+3)%(SELECT count(*) FROM {embeddings}) AS v FROM {benchmark}) b JOIN {embeddings} e ON e.vec_id=b.v""",
    "elements": """SELECT p_partkey AS id, p_name AS title, p_brand AS section, 1+p_partkey%4 AS site_id, CASE WHEN p_partkey%11=0 THEN 'disabled' ELSE 'live' END AS status,
  {TS:(p_partkey*37%1000)*3600} AS date_updated, CASE WHEN p_partkey%97=0 THEN {TS:3600000} END AS date_deleted FROM {part}""",
    "tracked": """SELECT p_partkey+500000 AS id, CASE WHEN p_partkey%101=0 THEN -p_partkey ELSE p_partkey END AS element_id, 1+p_partkey%4 AS site_id,
  CASE WHEN p_partkey%23=0 THEN 'error' WHEN p_partkey%29=0 THEN 'skipped' ELSE 'indexed' END AS status, CASE WHEN p_partkey%29=0 OR p_partkey%31=0 THEN 0 ELSE 1+p_partkey%7 END AS chunk_count,
  CASE WHEN p_partkey%41<>0 THEN {TS:(p_partkey*53%1000)*3600} END AS last_trained_at FROM {part} WHERE p_partkey%10<>0""",
    "clicks": "SELECT concat('suggestion ', CAST(user_id%25 AS {STR})) AS suggestion, ts FROM {events} WHERE event_type='click'",
    "attempts": "SELECT event_id AS id, user_id AS session_id, user_id%20 AS ip, ts FROM {events} WHERE event_type IN ('click','view')",
    "submissions": """SELECT event_id AS id, concat('form', CAST(user_id%3 AS {STR})) AS form_name, props AS payload, CASE user_id%4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'sent' END AS status,
  CASE WHEN event_id%3<>0 THEN ts END AS read_at, ts AS date_created FROM {events} WHERE event_type='signup'""",
    "qa": "SELECT item_id AS id, CASE WHEN item_id%3=0 THEN 1+item_id%4 END AS site_id, (item_id%3=1) AS translate, substring(text,1,60) AS question, substring(text,61,200) AS answer, (item_id%7<>0) AS active FROM {benchmark}",
}
_BASE = {"messages": ["conversations"], "sessions": ["conversations"], "contacts": ["conversations"], "bans": ["events"], "chunks": ["documents", "embeddings"], "queries": ["benchmark", "embeddings"], "elements": ["part"], "tracked": ["part"], "clicks": ["events"], "attempts": ["events"], "submissions": ["events"], "qa": ["benchmark"], "sites": []}


def _sql(name: str, duck: bool) -> str:
    import re

    text = _VIEWS[name].replace("{STR}", "VARCHAR" if duck else "STRING")
    stamp = r"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(\1))" if duck else r"(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0,0,0,\1))"
    return re.sub(r"\{TS:([^}]*)\}", stamp, text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data model, or a plain table, as a frame."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_sql(name, False), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _BASE[name]})


def ctes(*names: str) -> str:
    """The same tables as the beginning of a DuckDB query."""
    out = []
    for name in names:
        text = _sql(name, True)
        for t in _BASE[name]:
            text = text.replace("{" + t + "}", t)
        out.append(f"{name} AS ({text})")
    return "WITH " + ", ".join(out)
