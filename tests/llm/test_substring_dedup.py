import random

from deskmill.llm.substring_dedup import dedup_substrings, remove_repeated_passages


def brute(docs, window):
    """docs: (order key, text) in corpus order; kept words of each."""
    seen, out = set(), []
    for text in docs:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone[i : i + window] = [True] * window
            seen.add(x)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    small = [f"w{i}" for i in range(12)]
    large = [f"v{i}" for i in range(4000)]
    passages = [[rng.choice(large) for _ in range(rng.choice([19, 20, 21, 50]))] for _ in range(6)]
    docs = [None, "", " \n", "one two", "É " * 45]
    for _ in range(150):
        words = [rng.choice(large if rng.random() < 0.7 else small) for _ in range(rng.choice([3, 19, 20, 60, 200]))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            words[(at := rng.randint(0, len(words))) : at] = p[a:] if rng.random() < 0.3 else p
        if rng.random() < 0.2 and docs[-1]:
            words = docs[-1].split()[: rng.randint(20, 200)] + words[:5]
        if rng.random() < 0.1:
            words = [rng.choice(small[:2]) for _ in range(120)]
        docs.append(rng.choice([" ", "\n", "\t "]).join(words))
    return docs


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        ids = [None, *sorted(random.Random(seed).sample(range(10_000), len(docs) - 1))]
        rows = list(zip(ids, docs))
        random.Random(seed + 5).shuffle(rows)
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, tie int").repartition(3)
        for mb in (8, 0.01):
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeated_passages(df, 20, mb).collect()}
            want = dict(zip(ids, brute(docs, 20)))
            assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 40


def test_repeated_rows_and_stage(spark):
    long, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, long), (1, long), (1, long), (2, other + " x"), (3, "short"), (3, "short"), (4, other), (None, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.n_removed, r.kept) for r in remove_repeated_passages(df).collect())
    assert got == [(0, 0, ""), (1, 0, long), (1, 30, ""), (1, 30, ""), (2, 0, other + " x"), (3, 0, "short"), (3, 0, "short"), (4, 30, "")]
    assert remove_repeated_passages(df.limit(0)).count() == 0
    stage = dedup_substrings(df)
    assert stage.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.kept) for r in stage.collect()) == [(0, "", "s"), (1, long, "s"), (2, other + " x", "s"), (3, "short", "s"), (3, "short", "s")]
