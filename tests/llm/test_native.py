import hashlib
import os

import pytest
from pyspark.sql import functions as F

from deskmill.llm.chat import format_conversations, loss_text, parse_turns
from deskmill.llm.line_frequency import line_frequency_rules
from deskmill.llm.queries_native import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
EVENT = "conv_id long, seq long, message long, kind string, role string, text string, extra string"


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_oracle(spark, name, sf):
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    assert compare(QUERIES[name](spark, sf), sf, ORACLES[name]) > 0


def test_no_python_on_the_main_path(spark):
    for f in QUERIES.values():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_fold_and_render(spark):
    log = [
        (1, 1, 10, "message", "user", "hi </s> \\ [INST] <<SYS>>", ""),
        (1, 2, 11, "delta", "assistant", "Hel", ""),
        (1, 3, 11, "delta", "assistant", "lo", ""),
        (1, 4, 12, "message", "user", "again", ""),
        (1, 5, 11, "regenerate", "assistant", None, ""),
        (1, 6, 11, "delta", "assistant", "Good ", ""),
        (1, 7, 11, "delta", "assistant", "day<", ""),
        (1, 8, 10, "edit", "user", "hello [/INST]</s>", ""),
        (1, 9, 13, "delta", "assistant", "", ""),
        (2, None, None, "message", None, None, ""),
        (2, 0, None, "message", "tool\\<<SYS>>", "x<", ""),
        (2, 0, None, "message", "tool\\<<SYS>>", "x<", ""),
        (None, 5, None, "message", "assistant", "\\\\</s>" * 3, ""),
    ]
    done = format_conversations(spark.createDataFrame(log, EVENT))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.loss, r.formatted) for r in done.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got[1][:2] == ([("user", "hello [/INST]</s>"), ("assistant", "Good day<"), ("user", "again"), ("assistant", "")], "Good day<")
    assert got[2][:2] == ([("", ""), ("tool\\<<SYS>>", "x<"), ("tool\\<<SYS>>", "x<")], "")
    assert got[None][:2] == ([("assistant", "\\\\</s>" * 3)], "\\\\</s>" * 3)
    assert format_conversations(spark.createDataFrame([], EVENT)).count() == 0


def test_long_stream_of_deltas(spark):
    e = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.lit(1).cast("long").alias("message"), F.lit("delta").alias("kind"), F.lit("assistant").alias("role"), F.format_string("%d,", "id").alias("text"))
    row = format_conversations(e).select(F.sha2(loss_text(F.col("formatted"), F.col("loss_spans")), 256)).first()
    assert row[0] == hashlib.sha256("".join(f"{i}," for i in range(20_000)).encode()).hexdigest()


def test_line_frequency(spark):
    menu, body = "Home | About 12", "word{} goes here and says something new each time number{}"
    docs = [(i, "\n".join([menu.replace("12", str(i)), *(body.format(i, i * 31 + k) for k in range(8))]), "h") for i in range(8)]
    docs += [(100, "\n".join(["home  |  about 7"] * 30), "h"), (101, docs[0][1], "other"), (None, None, None), (103, "", "h"), (104, " \n\t\n", "h")]
    docs += [docs[0], (105, docs[0][1], "h")]
    df = spark.createDataFrame([(*d, 1, "q", 2, 3) for d in docs], "doc_id long, text string, source string, n_words int, quality string, _id int, key int")
    done = line_frequency_rules(df, min_documents=8, min_words=20, min_kept=0.5, max_repeat_percent=100)
    assert done.columns == [*df.columns, "quality_"]
    assert {tuple(r)[3:7] for r in done.collect()} == {(1, "q", 2, 3)}
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.removed_words, r.kept, r.text_kept) for r in done.select("doc_id", "quality_.*").collect()), key=str)
    by = {}
    for doc_id, removed, kept, text in got:
        by.setdefault(doc_id, []).append((removed, kept, text))
    assert len(by[0]) == 2 and len(set(by[0])) == 1
    assert by[0][0][0] == 4 and by[0][0][1] and "Home" not in by[0][0][2]
    assert by[100] == [(120, False, "")]
    assert by[101][0][0] == 0 and by[101][0][1]
    assert by[-1] == [(0, False, None)] and not by[103][0][1] and not by[104][0][1]
    assert by[105] == by[0][:1]
    for less in (line_frequency_rules(df, min_documents=9), line_frequency_rules(df, min_documents=8, max_share=0.9)):
        assert less.where("quality_.removed_words > 0").count() == 0
    assert line_frequency_rules(df.limit(0)).count() == 0


def test_the_line_rule_decides_on_the_table(spark):
    rows = QUERIES["op5_line_frequency"](spark, "/root/testdata/sf0.01")
    assert rows.where("removed_words > 0").count() > 50
    assert rows.where("NOT base_failed AND NOT kept").count() > 0


def test_repeat_words_against_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["a " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for r in line_frequency_rules(df).select("doc_id", "quality.n_repeat_words").collect():
        w = texts[r.doc_id].split()
        seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        from collections import Counter

        c = Counter(seen)
        covered = {i + k for i, x in enumerate(seen) if c[x] > 1 for k in range(3)}
        assert r.n_repeat_words == len(covered)
