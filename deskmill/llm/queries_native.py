"""Queries of the operators made of DataFrame functions: chat formatting and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskmill.llm.common import table


def conversation_events(rows: DataFrame) -> DataFrame:
    """An event log that folds to ``rows`` (conv_id, turn, role, text): by turn, a turn is one message, a draft that is
    dropped and streamed anew in two deltas, or a draft that is edited."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.floor(F.length("text") / 2).cast("int")

    def events(*log: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(log)))

    draft = F.lit("draft </s>")
    streamed = events(("delta", draft), ("regenerate", F.lit(None).cast("string")), ("delta", F.substring("text", F.lit(1), half)), ("delta", F.substring("text", half + 1, F.length("text"))))
    way = F.pmod("turn", F.lit(3))
    log = F.when(way == 1, streamed).when(way == 2, events(("message", draft), ("edit", F.col("text")))).otherwise(events(("message", F.col("text"))))
    rows = rows.withColumn("message", number.cast("long"))
    e = rows.select("conv_id", "turn", "role", "message", F.explode(log).alias("e"))
    return e.select("conv_id", (F.col("turn") * 4 + F.col("e.i")).cast("long").alias("seq"), "message", "e.kind", "role", "e.text")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.chat import format_conversations, loss_text, parse_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    events = conversation_events(rows.unionByName(control))
    done = format_conversations(events)
    done = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'),
    '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>')) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 22 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.llm.line_frequency import line_frequency_rules

    judged = line_frequency_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
    return judged.select("doc_id", *(f"quality.{c}" for c in names))


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, ws[i:i + 2] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
raw AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM w),
l AS (SELECT *, len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n,
  regexp_replace(regexp_replace(lower(trim(line, {_SPACES})), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]', '0', 'g') AS norm FROM raw),
lw AS (SELECT * FROM l WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
hosts AS (SELECT source, count(*) AS every FROM d GROUP BY source),
freq AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT r) AS ds, count(DISTINCT t) AS ts FROM lw GROUP BY source, norm) c
  WHERE ds > 5 AND ts > 5 AND ds > 0.05 * (SELECT every FROM hosts h WHERE h.source IS NOT DISTINCT FROM c.source)),
gone AS (SELECT r, sum(n) AS n FROM lw WHERE EXISTS (SELECT 1 FROM freq f WHERE f.source IS NOT DISTINCT FROM lw.source AND f.norm = lw.norm) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.8 * n_words AS kept, CAST(gone AS BIGINT) AS removed_words
FROM m
"""

QUERIES = {f.__name__: f for f in (op4_chat_formatting, op5_line_frequency)}
ORACLES = {"op4_chat_formatting": OP4_SQL, "op5_line_frequency": OP5_SQL}
