import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from deskmill.llm.language_id import predict, train
from deskmill.llm.queries_models import LISTED, op7_language_id, op8_url_filter
from deskmill.llm.url_rules import judge_urls, listed_rules, match_rules, mine_rules
from deskmill.llm.words import mix

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op7_language_id(spark, SF).join(truth, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_cases(spark):
    data = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (None, "x", "fr"), (3, None, "en"), (4, "le chat", None), (5, "123 !?", "de"), (6, "", "en"), (7, "t", None), (7, "t", None), (8, "und die " * 50_000, None), (9, "\ud55c\uae00 \U0001f600", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = train(df, buckets=1 << 10)
    assert [langs for langs, _ in model] == [["de", "en"]]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(df, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[8][0] == "de"
    assert got[3] == got[5] == got[6] == ("und", 0.0)
    assert predict(df.limit(0), model).count() == 0
    model = train(df.limit(0))
    assert {r.lang_pred for r in predict(df, model).collect()} == {"und"}


def naive_bayes(rows, buckets):
    """Log of prior and likelihood of a text under each language, with plain loops; only the hash of an n-gram is the library's."""
    def grams(text):
        kept = "".join(c if c.isalpha() else " " for c in f"\n{text.lower()}\n")
        for n in (2, 3):
            for i in range(len(kept) - n + 1):
                if kept[i : i + n].strip(" "):
                    h = 0
                    for c in kept[i : i + n]:
                        h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                    yield int(mix(np.array([(h + n) % (1 << 64)], np.uint64))[0]) % buckets

    langs = sorted({lang for _, lang in rows})
    counts = {lang: [0.5] * buckets for lang in langs}
    texts = {lang: 1 for lang in langs}
    for text, lang in rows:
        texts[lang] += 1
        for g in grams(text):
            counts[lang][g] += 1
    sums = {lang: sum(counts[lang]) for lang in langs}
    return lambda text: {lang: math.log(texts[lang] / sum(texts.values())) + sum(math.log(counts[lang][g] / sums[lang]) for g in grams(text)) for lang in langs}


def test_blocks_of_languages_against_naive_bayes_by_hand(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("abcdé "[k % 3 :] + "xyzß"[: k % 5]) for _ in range(rng.randint(1, 60))), f"l{k}") for k in range(7) for _ in range(2 + k)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    by_hand = naive_bayes(rows, 256)
    for size in (512, 3, 1):
        model = train(df, buckets=256, languages_per_block=size)
        assert [x for langs, _ in model for x in langs] == [f"l{k}" for k in range(7)] and all(len(langs) <= size for langs, _ in model)
        for r in predict(df, model).collect():
            text = rows[r.doc_id][0]
            if not any(map(str.isalpha, text)):
                assert (r.lang_pred, r.score) == ("und", 0.0)
                continue
            logs = by_hand(text)
            top = max(logs.values())
            assert logs[r.lang_pred] > top - 1e-3  # the matrix has single precision
            assert abs(r.score - 1 / sum(math.exp(x - top) for x in logs.values())) < 1e-3


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


def test_listed_rules_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/x?y#z", "https://www.example.com/en/1", "https://a.www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/en/", "http://notcom/", "a://b://c.com/", "http://example.com?x=/en/", "http://example.com", "http://sub.example.com/en", "http://.com/", "http://x.com/\n", "http:///p", "://com/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    none = mine_rules(df.select("url", F.lit(False).alias("bad")))
    rows = judge_urls(df, listed_rules(spark, LISTED), none).collect()
    assert len(rows) == len(df.collect())
    for r in rows:
        host, path, best = brute(urls[r.page_id % len(urls)])
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best and best[1]) and r.verdict == (best[2] if best else "allow")
    assert judge_urls(df.limit(0), listed_rules(spark, LISTED), none).count() == 0
    rows = op8_url_filter(spark, SF).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        host, path, best = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert not best or r.verdict == best[2]


def test_mined_rules(spark):
    rows = [(f"http://site{i % 7}.example.org/en/{i}", False) for i in range(300)] + [(f"http://cheap-pills.example.org/buy/{i}", True) for i in range(40)] + [(f"http://site{i % 7}.example.org/buy/{i}", False) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = mine_rules(df, min_support=0.02)
    found = rules.collect()
    assert found and all(len(r.tokens) == 1 and r.confidence == 1.0 for r in found)
    pages = spark.createDataFrame([(1, "https://cheap-pills.other.net/x"), (2, "http://site1.example.org/buy/9"), (3, None), (4, "http://pills.example.org/")], "page_id long, url string")
    hit = {r.page_id for r in match_rules(pages, rules, "page_id").collect()}
    by_hand = {1, 4}
    assert hit == by_hand


def test_support_is_the_same_at_every_size(spark):
    rows = [(f"http://site{i % 7}.example.org/en/{i}", False) for i in range(590)] + [(f"http://rare-casino.net/win/{i}", True) for i in range(10)]
    rules = mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert "host=rare-casino.net" in {t for r in rules for t in r.tokens}
    assert all(r.support >= 0.002 and r.confidence == 1.0 for r in rules)


def test_mined_verdicts_against_brute_force(spark):
    import math
    import random
    from itertools import combinations

    from deskmill.llm.url_rules import url_tokens

    rng = random.Random(4)
    urls = []
    for i in range(600):
        words = [rng.choice("abcdefgh"), rng.choice("klmnop"), rng.choice("xyz")]
        bad = rng.random() < (0.95 if {"a", "k"} <= set(words) or words[0] == "b" else 0.05)
        urls.append((f"http://{rng.choice(['s', 't', 'u-v'])}.example.org/{'/'.join(words)}", bad))
    df = spark.createDataFrame(urls, "url string, bad boolean")
    rows = [(set(r.t), r.bad) for r in df.select(url_tokens(F.col("url")).alias("t"), "bad").collect()]
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    every, bads = {}, {}
    for tokens, bad in rows:
        for size in (1, 2, 3):
            for c in combinations(sorted(tokens), size):
                every[c] = every.get(c, 0) + 1
                bads[c] = bads.get(c, 0) + bad
    least = max(math.ceil(0.01 * n), 2)
    candidates = [c for c in bads if bads[c] >= least]

    def good(c):
        k, m = bads[c], every[c]
        q = k / m
        g = m * (q * math.log(q / base) + ((1 - q) * math.log((1 - q) / (1 - base)) if q < 1 else 0))
        return q >= max(0.6, 2 * base) and len(candidates) * math.exp(-g) <= 1

    rules = [c for c in candidates if good(c)]
    rules = [c for c in rules if not any(set(x) < set(c) and bads[x] / every[x] >= bads[c] / every[c] for x in rules)]
    assert {("path=b",), ("path=a", "path=k")} <= set(rules)
    pages = df.select(F.monotonically_increasing_id().alias("page_id"), "url").collect()
    want = {p.page_id for p, (tokens, _) in zip(pages, rows) if any(set(c) <= tokens for c in rules)}
    mined = mine_rules(df, min_support=0.01)
    got = {r.page_id for r in judge_urls(spark.createDataFrame(pages), listed_rules(spark, LISTED), mined).where("verdict = 'block'").collect()}
    assert 50 < len(want) < 150 and got == want


def test_hosts_of_many_dots(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "net/es/x"), (2, "http://" + "." * 50_000 + "/")], "page_id long, url string")
    empty = mine_rules(df.select("url", F.lit(True).alias("bad")))
    assert [tuple(r) for r in judge_urls(df, listed_rules(spark, LISTED), empty).select("page_id", "rule", "verdict").orderBy("page_id").collect()] == [(1, "net/es/", "block"), (2, None, "allow")]
