import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from deskmill.llm.simhash import fingerprints, hamming_components, keep_first_of_group, near_duplicates, posting_edges
from deskmill.llm.words import split_words, window_hashes, whole_windows


def brute_print(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    n = max(1, len(words) - size + 1) if words else 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def brute_components(ids, prints, bits=2):
    label = list(range(len(prints)))
    for _ in prints:
        new = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= bits) for i in range(len(prints))]
        if new == label:
            break
        label = new
    groups = {}
    for i, x in zip(ids, label):
        groups.setdefault(x, []).append(i)
    known = {x: [i for i in g if i is not None] for x, g in groups.items()}
    return [min(known[x], default=None) for x in label]


def test_words_against_bytes_split():
    texts = ["a  b\tc\n", None, "", "  ", "É x\x0by", "long " * 300, "x\x85y\xa0z  w"]
    w = split_words(pa.array(texts))
    data = w.data.tobytes()
    for i, t in enumerate(texts):
        got = [data[w.start[k] : w.end[k]] for k in range(w.first[i], w.first[i + 1])]
        assert got == (t or "").encode().split()
    seen = {}
    for k in range(len(w.start)):
        word = data[w.start[k] : w.end[k]]
        assert seen.setdefault(word, w.hash[k]) == w.hash[k]
    assert len(set(seen.values())) == len(seen)
    assert whole_windows(w.first, len(w.start), 3).sum() == sum(max(0, len((t or "").split()) - 2) for t in ["a b c", "", "", "", "É x y", "l " * 300, "x\x85y\xa0z w".replace("\x85", "").replace("\xa0", "")])
    assert len(window_hashes(w.hash, 10**6)) == 0


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "B"]
    texts = [None, "", " \n ", "one", "One", "one two", "x" * 70 + " y " * 3]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        texts.append("  ".join(base))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append("\n".join(base))
    ids = [None, *range(500, 500 - len(texts) + 1, -1)]
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)] + [(7, "one", 2), (7, "one", 2)], "doc_id long, text string, fingerprint int")
    got = sorted(map(tuple, hamming_components(fingerprints(df)).collect()), key=str)
    ids, texts = [*ids, 7, 7], [*texts, "one", "one"]
    prints = [brute_print(t) for t in texts]
    want = sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(ids, prints))), key=str)
    assert got == want
    assert hamming_components(fingerprints(df.limit(0))).count() == 0


def test_large_posting_is_exact():
    rng = np.random.default_rng(2)
    base = np.uint64(0xABCDEF0123456789)
    members = np.unique(base ^ (rng.integers(0, 1 << 16, 900).astype(np.uint64) << np.uint64(8)))
    a, b = posting_edges(members, (1, 2), 2)
    label = {int(m): int(m) for m in members}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        label[root(max(x, y))] = root(min(x, y))
    want = brute_components([int(m) for m in members], [int(m) for m in members])
    assert [root(int(m)) for m in members] == [int(x) for x in want] or len({(root(int(m)), int(w)) for m, w in zip(members, want)}) == len(set(want))


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    docs, groups = [], []
    for g in range(40):
        words = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 300, 900]))]
        first = len(docs)
        docs.append(" ".join(words))
        members = [first]
        for k in range(g % 4):
            copy = list(words)
            if k and len(words) > 50:
                copy[rng.randrange(len(copy))] = "edited"
            members.append(len(docs))
            docs.append(" ".join(copy))
        groups.append(members)
    rows = [(i, t) for i, t in enumerate(docs)] + [(None, docs[0]), (1000, None), (1001, ""), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x"))
    kept = keep_first_of_group(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == sorted([m[0] for m in groups] + [1000])
    assert keep_first_of_group(df.limit(0)).count() == 0


def test_near_copies_that_differ_from_each_other(spark):
    rng = random.Random(21)
    texts, shingles = [], []

    def add(words):
        texts.append(" ".join(words))
        shingles.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(10, len(words) - 10, 10), n):
            words[at] = f"e{rng.randrange(10**9)}"
        return words

    # 120 copies of an original; 40 without it; and a row of copies of copies.
    for copies, with_original in ((120, True), (40, False)):
        original = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        if with_original:
            add(original)
        for _ in range(copies):
            add(edited(original, 5))
    words = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    for _ in range(40):
        add(words)
        words = edited(words, 5)
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    assert sum(120 >= i > 0 and 120 >= j > 0 for i, j in pairs) < 120 * 119 / 2 / 10  # most copies of the first original are below 0.8 to each other
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for r in near_duplicates(df).collect():
        groups.setdefault(r.component, set()).add(r.first_id)
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
