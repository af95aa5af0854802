import random
import re

import pytest

from deskmill.operators import postings as P
from deskmill.operators import retrieval as R
from deskmill.plans.registry import QUERIES
from deskmill.plans.views import view


def full_scan(queries, chunks, pool, site_filter):
    """{(query, chunk)} with the best scores, by comparing every query with every chunk."""
    out = set()
    for q, site, text in queries:
        mine = list(dict.fromkeys(w[:5] for w in (text or "").split()))
        found = []
        for c, c_site, content, vector in chunks:
            if vector is None or site_filter and site is not None and c_site is not None and site != c_site:
                continue
            words = [w[:5] for w in (content or "").split()]
            hit = [s for s in mine if s in words]
            if hit:
                found.append((-round(len(hit) + sum(words.count(s) / len(words) for s in hit), 9), c))
        out |= {(q, c) for _, c in sorted(found)[:pool]}
    return out


@pytest.mark.parametrize("pool", [1, 7, 60])
@pytest.mark.parametrize("site_filter", [True, False])
def test_search_equals_a_full_scan(spark, pool, site_filter):
    rng = random.Random(pool)
    vocabulary = [a + b for a in "bdfglm" for b in ("ab", "ef", "ijk", "opqrst")] + ["hot"] * 8
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    chunks = [(i, rng.choice([None, 1, 2]), rng.choice([text(rng.randrange(1, 8)), text(rng.randrange(1, 90)), "", "zz zz"]), rng.choice([[1.0], [0.5], None])) for i in range(300)]
    chunks += [(300 + i, 1, "hot", [1.0]) for i in range(200)]  # a stem of very many equal chunks
    queries = [(i, rng.choice([None, 1, 2, 3]), text(rng.randrange(1, 25))) for i in range(12)] + [(90, None, "unknown words"), (91, 1, None), (92, 2, "")]
    c = spark.createDataFrame(chunks, "id long, site_id int, content string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, site_id int, text string")
    rows = P.search(q, P.lexical_index(c, q), pool, site_filter).collect()
    assert {(r.query_id, r.chunk_id) for r in rows} == full_scan(queries, chunks, pool, site_filter)
    texts = {i: [w[:5] for w in t.split()] for i, _, t, _ in chunks}
    assert all(r.tf == texts[r.chunk_id].count(r.stem) > 0 and r.length == len(texts[r.chunk_id]) for r in rows)


def test_fewer_chunks_are_scored_than_share_a_stem(spark):
    rng = random.Random(1)
    words = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"]
    weights = [1 / (i + 1) for i in range(len(words))]
    chunks = [(i, None, " ".join(rng.choices(words, weights, k=rng.randrange(5, 120))), [1.0]) for i in range(600)]
    queries = [(i, None, " ".join(rng.choices(words, weights, k=30))) for i in range(10)]
    c = spark.createDataFrame(chunks, "id long, site_id int, content string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, site_id int, text string")
    index = P.lexical_index(c, q)
    known = P._words(q, index, True)
    every = P._read(known.selectExpr("query_id", "stem", "explode(blocks) AS b"), index).select("query_id", "chunk_id").distinct().count()
    left = P.survivors(known, index, P.thresholds(known, index, 20)).count()
    assert 200 <= left < every / 2


def test_empty_tables(spark):
    c = spark.createDataFrame([(1, 1, "word", [1.0])], "id long, site_id int, content string, embedding array<float>")
    q = spark.createDataFrame([(1, 1, "word")], "query_id long, site_id int, text string")
    for queries, chunks, n in ((q, c, 1), (q.limit(0), c, 0), (q, c.limit(0), 0)):
        assert P.search(queries, P.lexical_index(chunks, queries), 5).count() == n


def test_a_pair_is_shuffled_once(spark):
    c = spark.createDataFrame([(i, 1, f"word hot w{i}", [1.0]) for i in range(20)], "id long, site_id int, content string, embedding array<float>")
    q = spark.createDataFrame([(1, 1, "word hot other w3")], "query_id long, site_id int, text string")
    index = P.lexical_index(c, q)
    words = P._words(q, index, True)
    pairs = c.selectExpr("1L AS query_id", "id AS chunk_id").repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = P._scored(pairs, words.localCheckpoint(), index)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert not any("stem" in keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan))
        assert {r.chunk_id: len(r.terms) for r in scored.collect()} == {i: 3 if i == 3 else 2 for i in range(20)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_index_and_stored_hits(spark, monkeypatch):
    built = []
    make = P.lexical_index
    for module in (P, R):
        monkeypatch.setattr(module, "lexical_index", lambda *a: built.append(1) or make(*a))
    assert QUERIES["d5_bm25"](spark, "/root/testdata/sf0.001").count() and len(built) == 1
    q, c = (view(spark, "/root/testdata/sf0.001", n) for n in ("queries", "chunks"))
    hits = R.hybrid_search(q, c, k=3)
    assert len(built) == 2 and "Window" not in hits._jdf.queryExecution().executedPlan().toString()
