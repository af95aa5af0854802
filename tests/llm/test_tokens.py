import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deskmill.llm import simple8b, words
from deskmill.llm.common import shared_folder
from deskmill.llm.packing import SumOfSquares, pack_documents
from deskmill.llm.token_files import read_token_files, write_token_files
from deskmill.llm.tokens import Encoder, vocab_path

TEXTS = [None, "", " ", "\n", "a", "  a  b \n c\n\nd", "x\ty", " lead trail ", "café   z", "a\n b", "1 2\n3  4", "<|endoftext|> x", "don't we'll\nI'm", "a\x85b c", "　 x", "ümlaut, ñandú. Große", "the,the the, the.\nThe", "word " * 3000, "a\0b c"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocab_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(encoder, tokenizer, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    assert np.split(ids, np.cumsum(counts))[-1].size == 0
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == ids_of(tokenizer, text)[:-1], text


def test_encoding_equals_the_tokenizer(tokenizer):
    for room in (4, 100_000):
        e = Encoder(cache_pieces=room)
        for _ in range(2):
            check(e, tokenizer, TEXTS)
    assert e.encode(pa.array([], pa.string()))[0].tolist() == []


def test_encoding_equals_the_tokenizer_on_random_texts(tokenizer):
    parts = ["a", "Bc", "é", "×", "'", "'s", "'ll", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "1", "²", "$$", "...", "ß", "中文", "\u0301", "<|endoftext|>", "_", "\0", "«", "😀", "\ufeff", "\u180e", "Ж"]
    pick = random.Random(3)
    check(Encoder(), tokenizer, ["".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(5000)])


def test_other_kinds_of_vocabulary(tokenizer):
    path = vocab_path("word_bpe_49k.json")
    check(Encoder(path), Tokenizer.from_file(path), TEXTS)


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 5000))
    ids = rng.integers(0, 2, n).astype(np.uint64) if seed == 0 else (rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) >> rng.integers(0, 64, n).astype(np.uint64))
    words, offsets = simple8b.encode(ids)
    assert np.array_equal(simple8b.decode(words, offsets, n), ids)
    if seed == 0 and n:
        assert len(words) <= n / 60 + len(offsets)


def rows(spark):
    data = [(i * 3 % 20 if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a", "x"), (3, "a", "x")]
    return data, spark.createDataFrame(data, "doc_id long, text string, start string")


def test_token_files(spark, tokenizer):
    data, df = rows(spark)
    path = shared_folder(spark, "t")
    write_token_files(df.repartition(3), path, record_ids=50)
    got = [tuple(r) for r in read_token_files(spark, path).orderBy("start").collect()]
    want = sorted(((d, ids_of(tokenizer, t)) for d, t, _ in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for doc_id, start, n, ids in got:
        assert (start, 4 * n) == (at, len(ids))
        at += n
    assert [r[0] for r in got] == [w[0] for w in want]
    assert sorted((r[0] is not None, r[0] or 0, np.frombuffer(r[3], "<u4").tolist()) for r in got) == [(d is not None, d or 0, x) for d, x in want]
    write_token_files(df.limit(0), path + "0")
    assert read_token_files(spark, path + "0").count() == 0


def test_packing_keeps_every_id_once(spark, tokenizer):
    data, df = rows(spark)
    got = pack_documents(df.coalesce(1), 64).collect()
    by_sequence, covered, total = {}, [], 0
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        covered.append((r.doc_id, r.doc_tokens, r.start, r.length, bytes(r.ids)))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= 64 and at & at - 1 == 0
        total += at
    assert total == sum(len(ids_of(tokenizer, t)) for _, t, _ in data)
    long = sorted((s, b) for d, n, s, m, b in covered if n > 3000)
    assert np.frombuffer(b"".join(b for _, b in long), "<u4").tolist() == ids_of(tokenizer, "word " * 3000)
    assert pack_documents(df.limit(0)).count() == 0


def test_packing_takes_few_texts_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    df = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text")).coalesce(1)
    got = pack_documents(df, 64).select("doc_id", "length", "doc_tokens").collect()
    assert int(spark.conf.get(name)) == 1000
    assert {r.doc_id for r in got} == set(range(2500)) and sum(r.length for r in got) == 2500 * got[0].doc_tokens
    spark.conf.set(name, 10)
    pack_documents(df, 64)
    assert int(spark.conf.get(name)) == 10  # fewer stay
    spark.conf.unset(name)


def test_word_hashes_need_little_memory():
    data = np.frombuffer(b"word and another " * 400_000, np.uint8)
    edge = np.flatnonzero(data[1:] == 0x20)[:-1] + 1
    start, end = np.append(0, edge[:-1] + 1), edge
    words._TABLES.clear()
    tracemalloc.start()
    found = words.word_hashes(data, start, end)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept - found.nbytes < 8e6 and peak - found.nbytes < 40e6
    assert (found == np.resize(found[:3], len(found))).all() and len(set(found[:3].tolist())) == 3


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(5)
    packer = SumOfSquares(16)
    for _ in range(400):
        size = int(rng.integers(1, 16))
        sums = {}
        for h in range(17 - size):
            if h == 0 or packer.count[h]:
                c = packer.count.copy()
                c[h] -= h > 0
                c[h + size] += h + size < 16
                sums[h] = int((c[1:16] ** 2).sum())
        chosen = packer.level(size)
        assert sums[chosen] == min(sums.values())
        packer.place((0, size))
