"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language in Spark; what comes to the driver is a table of at most
languages x ``buckets`` counts.  Languages are worked in blocks of ``languages_per_block``, so that each matrix of
logarithms, which is broadcast, has a bound (512 x 32,768 float32 values); no language is left out.  Prediction cuts whole texts into n-grams, turns a
batch into a sparse document x bucket table and multiplies it with the matrix in numpy.

The classifier is fitted on at most ``sample_per_language`` labelled documents of each language
(those with the least hash of their id), which bounds training, not prediction.

Cases: a null text, and one without a letter, is ``und`` with score 0; a one-letter text has its n-grams with the
gaps around it; equal posteriors give the first language by name; without training rows all is ``und``;
null languages and null ids don't train; repeated rows are predicted each; a very long text is worked as one slice of
its own; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.common import checkpoint
from deskmill.llm.words import U64, mix, pieces

UNKNOWN = "und"
#: Cells (n-grams times languages) that are worked at once.
_CELLS = 1 << 22
ORDERS = (2, 3)


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two line feeds, and the text each belongs to (one cell more at its end)."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("".join(f"\n{t}\n" for t in lower).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.repeat(np.arange(len(texts)), np.array([len(t) + 2 for t in lower], np.int64))


def hashed_ngrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every n-gram of ORDERS; runs of letters count, everything else is one kind of gap."""
    points, doc = _characters(texts)
    table = _letter_table()
    p = np.where(table[np.minimum(points, len(table) - 1)], points, np.uint32(32)).astype(U64)
    docs, found = [], []
    for n in ORDERS:
        if len(p) < n:
            continue
        h = np.zeros(len(p) - n + 1, U64)
        gap = np.ones(len(h), bool)
        for i in range(n):
            part = p[i : i + len(h)]
            h = h * U64(0x100000001B3) + part
            gap &= part == 32
        keep = (doc[: len(h)] == doc[n - 1 :]) & ~gap
        docs.append(doc[: len(h)][keep])
        found.append((mix(h[keep] + U64(n)) % U64(buckets)).astype(np.int64))
    return np.concatenate([np.empty(0, np.int64), *docs]), np.concatenate([np.empty(0, np.int64), *found])


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """True for letters of the basic plane; its last entry stands for all later characters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(1 << 16)] + [True]))
    return _LETTERS[0]


def sparse_counts(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-zero cells (text, bucket, count), ordered by text."""
    doc, bucket = hashed_ngrams(texts, buckets)
    cell, n = np.unique(doc * buckets + bucket, return_counts=True)
    return cell // buckets, cell % buckets, n


#: Languages and their matrix, languages x (buckets + 1), of log probabilities; the last column is the prior.
Block = tuple[list[str], np.ndarray]


def train(rows: DataFrame, buckets: int = 1 << 15, sample_per_language: int = 5000, languages_per_block: int = 512) -> list[Block]:
    """The model: all languages by name, in blocks of at most ``languages_per_block``, which bounds each matrix."""
    rows = rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    blocks = []
    for at in range(0, len(names), languages_per_block):
        langs = names[at : at + languages_per_block]
        blocks.append((langs, _matrix(rows, {x: sizes[x] for x in langs}, buckets, sample_per_language)))
    total = np.log(sum(np.exp(m[:, -1].astype(np.float64)).sum() for _, m in blocks)) if blocks else 0
    for _, m in blocks:
        m[:, -1] -= np.float32(total)
    return blocks


def _matrix(rows: DataFrame, sizes: dict[str, int], buckets: int, sample_per_language: int) -> np.ndarray:
    """The matrix of the languages of ``sizes`` (by name, with their rows), its prior not yet divided by the sum of all."""
    # Rows under a share of the hash range that leaves about the wanted number, then exactly that many at most.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.2 * sample_per_language / n))])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(place < share[F.col("lang")]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("rank") <= sample_per_language)
    place_of = {lang: i for i, lang in enumerate(sizes)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, max_bytes=1 << 20):
                names, texts = part["lang"].to_pylist(), part["text"].to_pylist()
                doc, bucket, n = sparse_counts(texts, buckets)
                for lang in set(names):
                    mine = np.array([x == lang for x in names])[doc]
                    seen = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    seen[:-1] += np.bincount(bucket[mine], n[mine], buckets).astype(np.int64)
                    seen[-1] += names.count(lang)
        for lang, seen in total.items():
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(seen[some])], ["lang", "bucket", "n"])

    counts = np.zeros((len(sizes), buckets + 1))
    for r in rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[place_of[r["lang"]], r["bucket"]] = r["n"]
    words, prior = counts[:, :-1] + 0.5, counts[:, -1:]
    logs = np.log(words) - np.log(words.sum(axis=1, keepdims=True))
    return np.concatenate([logs, np.log(prior + 1)], axis=1).astype(np.float32)


def _totals(texts: list[str], by_bucket: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log of prior and likelihood of every text under every language of a block."""
    buckets, langs = by_bucket.shape
    doc, bucket, n = sparse_counts(texts, buckets)
    total = np.tile(prior, (len(texts), 1))
    step = max(1, _CELLS // langs)
    for at in range(0, len(doc), step):
        d, b, k = doc[at : at + step], bucket[at : at + step], n[at : at + step]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        total[d[first]] += np.add.reduceat(by_bucket[b] * k[:, None], first, axis=0)
    return total


def predict(docs: DataFrame, model: list[Block]) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred and score, the posterior of that language among all.

    The blocks of a model are worked one after another, each with its own broadcast; between two the rows are a written
    table, with the best language so far, its total and the sum over all languages so far.
    """
    nothing = float("-inf")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(nothing).alias("top"), F.lit(nothing).alias("mass"))
    for i, block in enumerate(model):
        last = i + 1 == len(model)
        columns = [c for c in rows.columns if not (last and c == "text")]  # the text isn't sent back when it was read last
        rows = rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(block), columns), rows.select(columns).schema)
        if not last:
            rows = checkpoint(rows)
    return rows.select("doc_id", "lang_pred", F.when(F.col("top") > nothing, F.least(F.lit(1.0), F.exp(F.col("top") - F.col("mass")))).otherwise(0.0).alias("score"))


def _scorer(shared: Broadcast, columns: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        by_bucket, prior = np.ascontiguousarray(matrix[:, :-1].T, np.float64), matrix[:, -1].astype(np.float64)
        for batch in batches:
            for part in pieces(batch, max_bytes=1 << 20):
                texts = [t or "" for t in part["text"].to_pylist()]
                names = np.array(part["lang_pred"].to_pylist(), object)
                top, mass = np.array(part["top"]), np.array(part["mass"])
                known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                if known.any():
                    total = _totals(texts, by_bucket, prior)[known]
                    best = total.argmax(axis=1)
                    most = total[np.arange(len(total)), best]
                    sums = most + np.log(np.exp(total - most[:, None]).sum(axis=1))
                    better = most > top[known]  # of equal ones the first by name stays
                    names[known] = np.where(better, np.array(langs, object)[best], names[known])
                    top[known], mass[known] = np.maximum(top[known], most), np.logaddexp(mass[known], sums)
                found = {"doc_id": part["doc_id"], "text": part["text"], "lang_pred": pa.array(names, pa.string()), "top": pa.array(top), "mass": pa.array(mass)}
                yield pa.RecordBatch.from_pydict({c: found[c] for c in columns})

    return score
