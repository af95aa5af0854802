import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskmill.llm.byte_cnn import CHUNK, Network, chunk_places, cut_chunks, document_score, fit, predict, train
from deskmill.llm.centroids import lloyd
from deskmill.llm.filter_audit import audit_table
from deskmill.llm.queries_audit import ORACLES, QUERIES, op12_quality_classifier
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(QUERIES[name](spark, SF), SF, ORACLES[name])


# The audit


def brute_audit(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)} by filtering lists."""
    flags = {}
    for i, q, t in labels:
        g = flags.setdefault(i, [0, 0])
        g[0], g[1] = max(g[0], q == 1), max(g[1], t == 1)
    rows = []
    for id_, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        if len(w) < 200:
            bad.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            bad.add("C")
        if any(c in "#$%&*|" for c in t):
            bad.add("D")
        if id_ is not None and any(o is not None and o < id_ and (x or "") == t for o, x, _ in docs):
            bad.add("E")
        rows.append((lang or "", bad, flags.get(id_, [0, 0]) if id_ is not None else [0, 0]))
    out = {}
    for part in {p for p, _, _ in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(kept), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2][0] for r in gone), sum(r[2][1] for r in gone)]
                shapley[f] += len(gone)
                left = kept
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


def audit(spark, folder, files, labels, batches):
    schema = "doc_id long, text string, lang string, mask string, part string, flags string"
    for i, rows in enumerate(files):
        spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/docs.parquet")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit("?"))
    rows = audit_table(spark, f"{folder}/docs.parquet", table, batches, texts_per_bucket=4).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_retracts_when_smaller_ids_arrive(spark, tmp_path):
    rng = random.Random(3)
    words = ["wort", "mot", "word", "WORD", "palabra", "a|b", "x"]
    texts = [None, "", " \t\n ", "A", "wort " * 300, "B" * 40] + [" ".join(rng.choice(words) + str(rng.randrange(k)) for _ in range(n)) for n, k in ((250, 400), (250, 400), (199, 900), (200, 60), (400, 5))]
    texts += [t.lower().replace("|", "") for t in texts[6:]]
    docs = [(i if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["de", "fr", None, ""])) for i in range(120)]
    docs += docs[5:15] + [(docs[3][0], docs[4][1], "de")]
    labels = [(rng.randrange(130), rng.randrange(2), rng.randrange(2)) for _ in range(90)] + [(None, 1, 1), (4, None, None)]
    backwards = sorted(docs, key=lambda d: -(d[0] or 0))
    files = [backwards[i::6] if i % 2 else backwards[i : len(backwards) : 6][::-1] for i in range(6)]
    got = audit(spark, str(tmp_path), files, labels, batches=6)
    assert got == brute_audit(docs, labels)


def test_audit_of_nothing_and_of_one_hot_text(spark, tmp_path):
    assert audit(spark, f"{tmp_path}/none", [[]], [], 4) == {}
    docs = [(i, "same text", "de") for i in range(500, 0, -1)]
    got = audit(spark, f"{tmp_path}/hot", [docs[:250], docs[250:]], [], 2)
    assert got["de", "EABCD", 1] == (1, 499, 0, 0, 0, 0, 499 * 60) and got["de", "AEBCD", 1][1] == 500


# The classifier


def test_network_finds_planted_bytes_and_is_a_probability():
    rng = np.random.default_rng(1)
    chunks = rng.integers(97, 123, (400, CHUNK)).astype(np.uint8)
    label = np.arange(400) % 2
    for c in chunks[label == 0]:
        at = rng.integers(0, CHUNK - 4)
        c[at : at + 4] = np.frombuffer(b"%$#!", np.uint8)
    net = fit(chunks, np.full(400, CHUNK), np.arange(400), label, np.ones(400), steps=150)
    scores = np.array([document_score(net, c) for c in chunks])
    assert ((scores > 0.5) == label).mean() > 0.97 and (0 <= scores).all() and (scores <= 1).all()


def test_score_against_a_plain_loop():
    rng = np.random.default_rng(2)
    net = Network(rng.normal(0, 1, (6, 256, 3)).astype(np.float32), rng.normal(0, 1, 3), rng.normal(0, 1, 3), 0.1)
    for size in (0, 1, 5, 6, 255, 256, 257, 496, 497, 3000):
        data = rng.integers(0, 256, size).astype(np.uint8)
        pooled = []
        for at in chunk_places(size):
            chunk = np.concatenate([data[at : at + CHUNK], np.zeros(CHUNK, np.uint8)])
            n = len(data[at : at + CHUNK])
            best = [max(sum(net.tables[i][chunk[p + i]][f] for i in range(6)) for p in range(max(0, n - 6) + 1)) for f in range(3)]
            pooled.append(np.maximum(np.array(best) + net.bias, 0))
        want = 1 / (1 + math.exp(-(np.mean(pooled, axis=0) @ net.weight + 0.1)))
        assert abs(document_score(net, data) - want) < 1e-4
        covered = np.zeros(size, bool)
        for at in chunk_places(size):
            covered[at : at + CHUNK] = True
        assert covered.all()
        assert cut_chunks(data, chunk_places(size))[1].sum() >= size


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = op12_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.3)).all()
    held = rows[rows["held_out"]]
    rank, good = held["score"].rank(), held["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert len(held) > 500 and auc > 0.98 and (held["predicted"] == held["quality"]).mean() > 0.95
    assert held[good]["predicted"].mean() > 0.97


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, "good words here", "a"), (2, "%%% ### %%%", "b"), (3, None, "c"), (4, "", "d"), (None, "x", "e"), (5, "words " * 100_000, "f"), (1, "good words here", "a"), (6, "한글 \U0001f600", "g")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, None), (5, 7), (None, 1)], "doc_id long, quality int")
    got = predict(docs, train(docs, labels)).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    one = train(docs, labels.where("quality = 1"))
    assert all(r.score > 0.99 for r in predict(docs, one).collect())
    assert all(r.score == 0.5 for r in predict(docs, train(docs, labels.limit(0))).collect())
    assert predict(docs.limit(0), one).count() == 0
    absent = spark.createDataFrame([(77, 0), (78, 1)], "doc_id long, quality int")
    assert all(r.score == 0.5 for r in predict(docs, train(docs, absent)).collect())


# Centroids


def brute_lloyd(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, mine) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    each = {n: sum(d for _, d, m in last if m == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i if i is not None else -1, n, d, each[n], sum(each.values()), digest[n]) for i, d, n in last)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x"))


def told(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_lloyd_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(c % 3 - 1, 0.4) for c in range(7)]) for i in range(300)]
    rows += [(i, [0.25] * 7) for i in range(300, 400)]  # ties and a hot group
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, [0.1] * 7), (400, None), (401, [0.0] * 6), (402, [0.0] * 6 + [None]), (403, [0.0] * 6 + [float("nan")]), (404, [float("-inf")] + [0.0] * 6), (405, [])]
    for k, shards in ((5, 3), (8, 1), (8, 7)):
        assert told(lloyd(vectors(spark, rows).repartition(5), k=k, rounds=4, dimensions=7, shards=shards)) == brute_lloyd(rows, k, 4, 7)


def test_lloyd_cases(spark):
    assert lloyd(vectors(spark, [(1, [1.0])]).limit(0), dimensions=1).count() == 0
    assert lloyd(vectors(spark, [(1, [1.0])]), dimensions=2).count() == 0
    few = [(1, [1.0, -2.0]), (2, [1.0, -2.0]), (3, [5.0, 5.0])]
    assert told(lloyd(vectors(spark, few), dimensions=2, shards=2)) == brute_lloyd(few, 8, 10, 2)
    far = lloyd(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0])]), k=1, dimensions=2, shards=2).collect()
    assert {r.cluster for r in far} == {0} and all(0 < r.distance <= (1 << 57) for r in far)


def test_empty_clusters_stay(spark):
    same = [(i, [0.5, 0.5]) for i in range(20)]
    got = lloyd(vectors(spark, same), k=3, rounds=2, dimensions=2, shards=2).collect()
    assert {r.cluster for r in got} == {0} and {r.inertia for r in got} == {0}


