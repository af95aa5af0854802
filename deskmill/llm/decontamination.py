"""Benchmark decontamination: rare n-gram seeds join passages to test items, then Smith-Waterman alignment.

Words are runs of characters other than ASCII marks and white space, A-Z in lower case.  How rare an item's n-gram
is, Spark counts over all documents; the items' own copies, edited ones too, don't count: a document counts for a gram only
where none of the three words before and after it stands where an item has it.  Of all grams those are seeds whose expected
candidates (documents times items that hold the gram) fit into ``candidates`` pairs a document, rarest first, so that the
number of pairs doesn't grow with the number of items; besides, the rarest gram of every ``stretch`` grams of
an item is one.  So a copy is a candidate if it keeps a rare gram, or 2 * ``stretch`` + n - 2 words of the item in a row.

Documents are read where they lie; only passages with a seed leave them, one for each place where an item
would begin, in steps of the item's length rounded up to a power of two.  Passages and items are joined on the seed (a frequent one is
salted by its count), and where the passage holds enough of the item's words for ``min_score`` they are aligned: the
score is that of the best local alignment over that of a perfect copy.

Items go through in blocks of at most ``block_mb`` of text, which bounds the lists of grams that the tasks get; the
documents are read twice for each block.

Cases: null or blank texts match nothing; items of fewer words than a seed use all their words as one
seed; repeated items and documents each give their own rows; null ids are kept; of equally good places in a document the first
is given; a very long text is worked as one slice of its own, and its passages are a few lengths of an item; empty tables give no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.alignment import PAD_A, PAD_B, padded, seed_hits, smith_waterman
from deskmill.llm.common import checkpoint, free_name, text_mb
from deskmill.llm.words import U64, mix, pieces, split_words, whole_windows, window_hashes

_MATCH = 2
#: Cells of a row of alignments that are worked at once.
_CELLS = 1 << 20
#: Words to either side of a gram that tell a copy from a chance place.
_AROUND = 3
#: Documents that hold one seed and meet in one join key.
_PER_SALT = 100_000
_ITEM = "item long, item_id long, words array<long>, size long, reach long, grams array<long>, around array<long>"
_PASSAGE = "row long, doc_id long, reach long, step long, begin long, words array<long>, seeds array<struct<gram: long, offset: long, salt: long>>"
_HIT = "row long, item long, doc_id long, item_id long, score double, start_word long, end_word long"


def _lists(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """A list array of unsigned or signed 64-bit integers."""
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate([np.empty(0, np.int64), *(p.view(np.int64) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _around(words: np.ndarray, grams: np.ndarray, place: np.ndarray, size: int, low: np.ndarray | int, high: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each distance to either side: which places have a word of their text (low to high) there, and the hash of gram, word and distance."""
    for d in [*range(-_AROUND, 0), *range(_AROUND)]:
        at = place + d + (size if d >= 0 else 0)
        has = np.flatnonzero((at >= low) & (at < high))
        yield has, mix(grams[has] ^ mix(words[at[has]] + U64(d + _AROUND + 1)))


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """Items with at least one word: hashes of words, of n-grams (of ``size`` words) and of the grams with a word near them; ``reach`` is the step of passages."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                t = split_words(part["text"], lower=True, marks=True)
                words = [t.hash[a:b] for a, b in zip(t.first[:-1], t.first[1:], strict=True)]
                keep = [i for i, w in enumerate(words) if len(w)]
                words = [words[i] for i in keep]
                size = [min(n, len(w)) for w in words]
                grams = [window_hashes(w, s) for w, s in zip(words, size, strict=True)]
                around = [np.concatenate([h for _, h in _around(w, g, np.arange(len(g)), s, 0, len(w))]) for w, g, s in zip(words, grams, size, strict=True)]
                ids = part.select(["item", "item_id"]).take(pa.array(keep, pa.int64()))
                reach = [1 << (len(w) - 1).bit_length() for w in words]
                yield pa.RecordBatch.from_arrays([*ids.columns, _lists(words), pa.array(size, pa.int64()), pa.array(reach, pa.int64()), _lists(grams), _lists(around)], ["item", "item_id", "words", "size", "reach", "grams", "around"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, _ITEM)


def _hashes(df: DataFrame, column: str) -> np.ndarray:
    """Distinct hashes of a block of items, ascending."""
    return np.unique(df.toArrow()[column].to_numpy().view(U64))


def gram_frequency(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(gram, documents): documents that hold a gram of ``items`` (a block of item_grams) at a place without an item's words around it; grams without any are left out."""
    sizes = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]  # n sizes at most
    grams = {s: _hashes(items.where(F.col("size") == s).select(F.explode("grams").alias("gram")).distinct(), "gram") for s in sizes}
    near = _hashes(items.select(F.explode("around").alias("gram")).distinct(), "gram")
    known = docs.sparkSession.sparkContext.broadcast((grams, near))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, near = known.value
        found = {s: np.zeros(len(g), np.int64) for s, g in grams.items()}
        for batch in batches:
            for part in pieces(batch):
                t = split_words(part["text"], lower=True, marks=True)
                for s, g in grams.items():
                    place, k = seed_hits(window_hashes(t.hash, s), g)
                    whole = whole_windows(t.first, len(t.start), s)[place]
                    place, k = place[whole], k[whole]
                    doc = np.searchsorted(t.first, place, side="right") - 1
                    copied = np.zeros(len(place), bool)
                    for has, h in _around(t.hash, g[k], place, s, t.first[doc], t.first[doc + 1]):
                        copied[has] |= near[np.minimum(np.searchsorted(near, h), len(near) - 1)] == h if len(near) else False
                    doc, k = doc[~copied], k[~copied]
                    once = np.unique(np.stack([doc, k], axis=1), axis=0)[:, 1]
                    found[s] += np.bincount(once, minlength=len(g))
        for s, c in found.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(grams[s][some].view(np.int64)), pa.array(c[some])], ["gram", "documents"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, documents long").groupBy("gram").agg(F.sum("documents").alias("documents"))


def rare_seeds(items: DataFrame, frequency: DataFrame, budget: float, stretch: int) -> DataFrame:
    """(item, reach, size, gram, offset, salts) of the seeds: grams whose pairs, rarest first, fit into ``budget``, and the rarest of each stretch."""
    places = items.select("item", "reach", "size", F.posexplode("grams").alias("offset", "gram"))
    held = places.groupBy("gram").agg(F.countDistinct("item").alias("items"))
    documents = F.coalesce("documents", F.lit(0))
    cost = held.join(frequency, "gram", "left").select("gram", documents.alias("documents"), (documents * F.col("items")).alias("cost"))
    cost = checkpoint(cost.withColumn("level", F.when(F.col("cost") == 0, -1).otherwise(F.floor(F.log2("cost")))))
    limit, total = -1, 0
    for r in cost.groupBy("level").agg(F.sum("cost").alias("cost")).orderBy("level").collect():  # 65 levels at most
        total += r["cost"]
        if total > budget:
            break
        limit = r["level"]
    w = Window.partitionBy("item", F.floor(F.col("offset") / stretch)).orderBy("cost", "offset")
    ranked = places.join(cost, "gram").withColumn("rank", F.row_number().over(w))
    rare = ranked.where((F.col("level") <= limit) | (F.col("rank") == 1))
    return rare.select("item", "reach", "size", "gram", F.col("offset").cast("long").alias("offset"), F.ceil((F.col("documents") + 1) / _PER_SALT).cast("long").alias("salts"))


def seeded_passages(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Passages of documents at the places where an item with a seed there would begin, with those seeds; ``row`` numbers the documents."""
    s = seeds.select("size", "gram", "reach", "offset", "salts").distinct().toArrow()  # of one block of items
    size = s["size"].to_numpy()
    tables = {}
    for n in np.unique(size).tolist():
        part = [s[c].to_numpy()[size == n] for c in ("gram", "reach", "offset", "salts")]
        order = np.argsort(part[0].view(U64), kind="stable")
        tables[n] = [p[order] for p in part]
    known = docs.sparkSession.sparkContext.broadcast(tables)
    seed_type = pa.struct([("gram", pa.int64()), ("offset", pa.int64()), ("salt", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                t = split_words(part["text"], lower=True, marks=True)
                rows, found = part["row"].to_numpy(), [np.empty((0, 6), np.int64)]
                for n, (gram, reach, offset, salts) in known.value.items():
                    place, k = seed_hits(window_hashes(t.hash, n), gram.view(U64))
                    whole = whole_windows(t.first, len(t.start), n)[place]
                    place, k = place[whole], k[whole]
                    doc = np.searchsorted(t.first, place, side="right") - 1
                    step = (place - t.first[doc] - offset[k]) // reach[k]
                    found.append(np.stack([doc, reach[k], step, gram[k], offset[k], rows[doc] % salts[k]], axis=1))
                found = np.unique(np.concatenate(found), axis=0)
                if not len(found):
                    continue
                new = np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)])
                doc, reach, step = found[new, :3].T
                low = np.maximum(t.first[doc], t.first[doc] + (2 * step - 1) * reach // 2)
                high = np.minimum(t.first[doc + 1], t.first[doc] + (2 * step + 5) * reach // 2)
                words = _lists([t.hash[a:b] for a, b in zip(low, high, strict=True)])
                inside = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (3, 4, 5)], fields=list(seed_type))
                held = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(found)), pa.int32()), inside)
                ids = part["doc_id"].take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(rows[doc]), ids, *(pa.array(x) for x in (reach, step, low - t.first[doc])), words, held], ["row", "doc_id", "reach", "step", "begin", "words", "seeds"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, _PASSAGE)


def align_pairs(pairs: DataFrame, min_score: float) -> DataFrame:
    """Hits of pairs (row, item, doc_id, item_id, begin, words, item_words) that score ``min_score`` or more."""

    def enough(a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the passage holds as many of the item's words, repeats counted, as a good score needs."""
        values, most = np.unique(a, return_counts=True)
        _, k = seed_hits(b, values)
        return np.minimum(np.bincount(k, minlength=len(values)), most).sum() >= min_score * len(a)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([batch[c].values[s:e].to_numpy().view(U64) for s, e in zip(o[:-1], o[1:], strict=True)] for c in ("item_words", "words") for o in [batch[c].offsets.to_pylist()])
            begin, out = batch["begin"].to_numpy(), []
            open_ = sorted((i for i in range(len(a)) if enough(a[i], b[i])), key=lambda i: len(b[i]))
            at = 0
            while at < len(open_):  # at most 256 pairs, fewer of long passages
                some = open_[at : at + max(1, min(256, _CELLS // len(b[open_[min(at + 256, len(open_)) - 1]])))]
                at += len(some)
                score, end_a, end_b = smith_waterman(padded([a[i] for i in some], PAD_A), padded([b[i] for i in some], PAD_B), _MATCH)
                good = [j for j, i in enumerate(some) if score[j] >= min_score * _MATCH * len(a[i])]
                if not good:
                    continue
                # The same alignment read backwards ends where it begins.
                back_a, back_b = [a[some[j]][: end_a[j] + 1][::-1] for j in good], [b[some[j]][: end_b[j] + 1][::-1] for j in good]
                _, _, start = smith_waterman(padded(back_a, PAD_A), padded(back_b, PAD_B), _MATCH)
                for j, from_end in zip(good, start.tolist(), strict=True):
                    i, last = some[j], int(begin[some[j]]) + int(end_b[j])
                    out.append((i, float(score[j]) / (_MATCH * len(a[i])), last - from_end, last + 1))
            if out:
                i, *found = (pa.array(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.select(["row", "item", "doc_id", "item_id"]).take(i).columns, *found], ["row", "item", "doc_id", "item_id", "score", "start_word", "end_word"])

    return pairs.select("row", "item", "doc_id", "item_id", "begin", "words", "item_words").mapInArrow(align, _HIT)


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 3, min_score: float = 0.5, block_mb: float = 16, candidates: float = 0.1, stretch: int = 4) -> DataFrame:
    """doc_id, item_id, score (0 to 1) and the span of words, for each document that holds a copy of an item."""
    blocks = 1 + int(text_mb(items) / block_mb)
    cut, budget = checkpoint(item_grams(items, n)), candidates * docs.count() / blocks
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_leaks_of(docs, cut.where(block == b), budget, min_score, stretch) for b in range(blocks)])


def _leaks_of(docs: DataFrame, items: DataFrame, budget: float, min_score: float, stretch: int) -> DataFrame:
    seeds = checkpoint(rare_seeds(items, gram_frequency(docs, items), budget, stretch))
    passages = checkpoint(seeded_passages(docs, seeds))
    place, key = ["row", "reach", "step"], ["gram", "reach", "offset", "salt"]
    salted = seeds.select("item", "reach", "gram", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    held = passages.select(*place, F.explode("seeds").alias("s")).select(*place, "s.*")
    pairs = held.join(salted, key).select(*place, "item").distinct().join(passages.drop("seeds"), place)
    pairs = pairs.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("back"), "end_word", "doc_id", "item_id")).alias("b")
    hits = align_pairs(pairs, min_score).groupBy("row", "item").agg(best)
    return hits.select("b.doc_id", "b.item_id", "b.score", (-F.col("b.back")).alias("start_word"), "b.end_word")


def without_leaks(docs: DataFrame, items: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` without the documents that hold a test item; null doc_ids are compared like others."""
    leak = free_name(docs, "_leak")
    leaks = find_leaks(docs, items, min_score=min_score).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
