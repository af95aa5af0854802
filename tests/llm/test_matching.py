import random
import re

import numpy as np

from deskmill.llm.alignment import PAD_A, PAD_B, banded, padded, smith_waterman
from deskmill.llm.decontamination import find_leaks, gram_frequency, item_grams, rare_seeds, without_leaks
from deskmill.llm.licenses import TEMPLATES, scan_licenses, winnow


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_sw(a, b, match=2, mismatch=-1, gap=1):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if x == y else mismatch), h[i - 1][j] - gap, h[i][j - 1] - gap)
            best = max(best, h[i][j])
    return best


def test_smith_waterman_against_brute_force():
    rng = random.Random(1)
    a = [[rng.randrange(10, 16) for _ in range(rng.randint(1, 12))] for _ in range(80)]
    b = [[rng.randrange(10, 16) for _ in range(rng.randint(0, 20))] for _ in range(80)]
    score, _, end = smith_waterman(padded([np.array(x, np.uint64) for x in a], PAD_A), padded([np.array(x, np.uint64) for x in b], PAD_B))
    for x, y, s, e in zip(a, b, score, end):
        assert s == brute_sw(x, y)
        assert not s or brute_sw(x, y[: e + 1]) == s
    template = np.array([rng.randrange(10, 16) for _ in range(9)], np.uint64)
    rows = [[rng.randrange(10, 16) for _ in range(9 + 40)] for _ in range(60)]
    got, hits, first, last = banded(template, np.array(rows, np.uint64), 20)
    for row, s, h, f, e in zip(rows, got, hits, first, last):
        assert s <= brute_sw(template.tolist(), row)
        assert s == brute_sw(template.tolist(), row[f : e + 1]) and h <= 9


def prose(rng, n):
    return [rng.choice("alpha beta gamma delta of the and in to a is on".split()) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(prose(rng, rng.randint(15, 40)))) for i in range(12)] + [(100, None), (101, "  "), (102, "single"), (None, "two WORDS!")]
    docs, want = [], set()
    for d in range(80):
        words = prose(rng, rng.choice([5, 80, 400]))
        if d % 3 == 0:
            item = items[d % 12]
            copy = words_of(item[1])
            if d % 2:
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = "edited"
            words[len(words) // 2 : len(words) // 2] = copy
            want.add((d, item[0]))
        docs.append((d, "\n".join([", ".join(words)]), 1.0))
    docs += [(900, None, 0.0), (901, "", 0.0), (902, "say two, words. now", 0.0), (903, items[3][1], 0.0), (903, items[3][1], 0.0)]
    want |= {(902, None), (903, 3)}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(items, "item_id long, text string")
    rows = find_leaks(df, bench).collect()
    texts = dict((d[0], d[1]) for d in docs)
    all_words = {i: words_of(t) for i, t in items}
    got = {(r.doc_id, r.item_id) for r in rows}
    assert want <= got
    assert len(rows) == len(got) + 1
    for r in rows:
        a, b = all_words[r.item_id], words_of(texts[r.doc_id])
        assert brute_sw(a, b) / (2 * len(a)) >= r.score >= 0.5
        assert brute_sw(a, b[r.start_word : r.end_word]) / (2 * len(a)) == r.score
    for d in docs:
        for i, t in items:
            if all_words[i] and (d[0], i) not in got:
                assert brute_sw(all_words[i], words_of(d[1])) / (2 * len(all_words[i])) < 0.75, (d[0], i)
    clean = {r.doc_id for r in without_leaks(df, bench).collect()}
    assert clean == set(texts) - {d for d, _ in got}
    assert find_leaks(df.limit(0), bench).count() == 0 and find_leaks(df, bench.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, bench, block_mb=3e-3).collect()} == got


def test_leaks_of_edited_copies(spark):
    rng = random.Random(13)
    items, docs, want = [], [], set()
    for i, n in enumerate([15, 24, 38, 59] * 6):
        item = [f"q{rng.randrange(10**6)}" for _ in range(n)]
        items.append((i, " ".join(item)))
        for d, edits in enumerate((n // 6, n // 4, n // 3)):
            copy = list(item)
            evenly = [round((k + 0.5) * n / edits) for k in range(edits)]
            for at in evenly if d < 2 else rng.sample(range(n), edits):
                copy[at] = "edited"
            text = [*prose(rng, 60), *copy, *prose(rng, 60)]
            docs.append((len(docs), " ".join(text)))
            seeds = any(copy[k : k + 3] == item[k : k + 3] for k in range(n - 2))
            if seeds and brute_sw(item, text) >= 0.5 * 2 * n:
                want.add((docs[-1][0], i))
    assert len(want) > 60
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()} == want


def test_seeds_are_rare_whatever_leaks(spark):
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, rng.choice([2, 20, 30])))) for i in range(30)]
    texts = [" ".join(prose(rng, 300)) for _ in range(60)] + [items[i % 30][1] for i in range(300)]
    texts += [" ".join("changed" if k % 4 == 3 else w for k, w in enumerate(items[i % 30][1].split())) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = item_grams(spark.createDataFrame(items, "item_id long, text string"), 3)
    got = sorted(r.documents for r in gram_frequency(docs, cut).collect())
    own = [t.split() for _, t in items]
    around = {}
    for w in own:
        size = min(3, len(w))
        for o in range(len(w) - size + 1):
            near = around.setdefault(tuple(w[o : o + size]), set())
            near |= {(d, w[o + d + (size if d >= 0 else 0)]) for d in range(-3, 3) if 0 <= o + d + (size if d >= 0 else 0) < len(w)}
    want = []
    for g, near in around.items():
        free = 0
        for w in map(str.split, texts):
            holds = [o for o in range(len(w) - len(g) + 1) if tuple(w[o : o + len(g)]) == g]
            at = lambda o, d: o + d + (len(g) if d >= 0 else 0)
            free += any(not any(0 <= at(o, d) < len(w) and (d, w[at(o, d)]) in near for d in range(-3, 3)) for o in holds)
        if free:
            want.append(free)
    assert got == sorted(want)
    seeds = rare_seeds(cut, gram_frequency(docs, cut), budget=0, stretch=4).collect()
    n_grams = {r.item: len(r.grams) for r in cut.collect()}
    # Budget zero leaves grams that no unlike document holds, and one of each stretch.
    assert all({r.offset // 4 for r in seeds if r.item == i} == set(range(-(-n // 4))) for i, n in n_grams.items())
    every = rare_seeds(cut, gram_frequency(docs, cut), budget=1e9, stretch=4).count()
    assert len(seeds) < every == sum(n_grams.values())


def test_leaks_in_long_texts_and_among_many_items(spark):
    rng = random.Random(4)
    long = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(["which", "of", "the", "following", f"a{i}", f"b{i}", f"c{i}", *prose(rng, 12)])) for i in range(200)] + [(500, " ".join(long))]
    texts = [" ".join(["which of the following"] * 50 + prose(rng, 200)) for _ in range(40)]
    body = prose(rng, 60_000)
    body[50_000:50_000] = items[7][1].split()
    texts += [" ".join(body), " ".join(prose(rng, 500) + long[:1000] + ["x"] * 40 + long[1000:2900]), items[9][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): (r.score, r.start_word, r.end_word) for r in rows if r.score >= 0.75}
    assert found == {(40, 7): (1.0, 50_000, 50_019), (41, 500): (found[41, 500][0], 500, 3440), (42, 9): (1.0, 0, 19)}
    assert found[41, 500][0] == (2 * 2900 - 40) / 6000


def test_licenses(spark):
    rng = random.Random(2)
    docs, want = [], set()
    names = list(TEMPLATES)
    for d in range(60):
        body = prose(rng, 50)
        if d % 2 == 0:
            name = names[(d // 2) % len(names)]
            text = words_of(TEMPLATES[name])
            if len(text) > 20:
                del text[7]
                text[11] = "changed"
            body[20:20] = ["\n#", *text, "\n"]
            want.add((d, name))
        docs.append((d, " ".join(body), "x"))
    docs += [(100, None, ""), (101, "", ""), (102, "Released under the MIT License. " * 3, ""), (103, "the license of the version", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, license string")
    rows = scan_licenses(df).collect()
    got = {(r.doc_id, r.license) for r in rows}
    assert want <= got
    assert {x[0] for x in got} == {x[0] for x in want} | {102}
    assert [(r.coverage, r.matched_words, r.start_word, r.end_word) for r in rows if r.doc_id == 102] == [(1.0, 5, 0, 5), (1.0, 5, 5, 10), (1.0, 5, 10, 15)]
    for r in rows:
        text = words_of(docs[[d[0] for d in docs].index(r.doc_id)][1])
        part, t = text[r.start_word : r.end_word], words_of(TEMPLATES[r.license])
        assert r.coverage == r.matched_words / len(t) >= 0.8
        assert sum(w in part for w in t) >= r.matched_words
    assert scan_licenses(df.limit(0)).count() == 0
    assert scan_licenses(df, {"none": " "}).count() == 0


def test_winnowing_keeps_one_of_every_window():
    grams = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    picked = set(winnow(grams, 4).tolist())
    assert all(picked & set(range(i, i + 4)) for i in range(len(grams) - 3))
