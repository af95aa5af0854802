"""The pipeline against brute-force versions of its stages, each on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from deskmill.llm.common import checkpoint, table
from deskmill.llm.tokens import vocab_path
from tests.llm.test_matching import brute_sw, words_of
from tests.llm.test_substring_dedup import brute as brute_passages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        found = checkpoint(stage(spark, docs, SF))
        out.append((name, docs, found))
        docs = found
    return out


def shingles(text, n=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_columns(steps):
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.count() > 0


def test_quality(steps):
    _, before, after = steps[0]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        w = r.text.encode().split()
        seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = Counter(seen)
        covered = {i + k for i, x in enumerate(seen) if again[x] > 1 for k in range(3)}
        # No line of this small table is in over 100 documents.
        assert (r.doc_id in kept) == (len(w) >= 50 and 100 * len(covered) <= 50 * len(w))


def test_near_duplicates(steps):
    _, before, after = steps[1]
    rows = sorted((r.doc_id, shingles(r.text)) for r in before.collect())
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(rows[i][1] & rows[j][1]) >= 0.8 * len(rows[i][1] | rows[j][1])]
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert sorted(r.doc_id for r in after.collect()) == sorted({rows[x][0] for x in label})


def test_passages(steps):
    _, before, after = steps[2]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    want = {}
    for (doc_id, text), (n, gone, kept) in zip(rows, brute_passages([t for _, t in rows], 20)):
        if gone < n or not n:
            want[doc_id] = kept if gone else text
    assert {r.doc_id: r.text for r in after.collect()} == want


def test_leaks(spark, steps):
    _, before, after = steps[3]
    kept = {r.doc_id for r in after.collect()}
    items = [words_of(r.text) for r in table(spark, SF, "benchmark").collect()]
    for r in before.collect():
        w = words_of(r.text)
        if r.doc_id not in kept:
            text = w[:1500]
            assert len(w) > 1500 or any(len(set(a) & set(text)) > len(a) // 2 and brute_sw(a, text) >= 0.5 * 2 * len(a) for a in items)
        elif len(w) < 90:
            assert not any(brute_sw(a, w) >= 0.75 * 2 * len(a) for a in items)
        else:
            text = " ".join(w)
            assert not any(" ".join(a) in text for a in items)


def test_packing(steps):
    _, before, after = steps[4]
    tokenizer = Tokenizer.from_file(vocab_path())
    texts = {r.doc_id: r.text for r in before.collect()}
    pieces = {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        assert np.frombuffer(b"".join(x for _, x in sorted(found)), "<u4").tolist() == [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0]
    fill = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n & r.n - 1 == 0 for r in fill) == len(fill)


def test_run_is_the_stages(spark, steps):
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.start, r.length) for r in steps[-1][2].collect())
