"""Substring dedup with repeated-phrase automata.

A window is ``window`` (20) consecutive words of one document.  Every word is removed that is covered
by a window whose word sequence starts earlier too (smaller doc_id, or earlier in the same document).

1. Phrases.  Of the 5-word phrases in a window the one with the least hash is its anchor, so equal
   windows have equal anchors, and only every seventh phrase or so is one.  Anchors are counted in
   the corpus; those met twice are recurring phrases.  A phrase is kept as five 12-bit word
   symbols in one long.
2. Automata.  Documents are dealt to buckets of a bounded size.  For every bucket the recurring phrases that
   occur in it are compiled into an Aho-Corasick automaton (one shard), and all documents of the
   bucket are streamed through it.  Its hits are all that is looked at further: a hit is compared with the phrases up to
   a window around it, which gives the run of windows that it anchors, a passage.
3. Passages.  Of equal passages (by hash) the first one in corpus order stays, in all others
   every window starts earlier too.  Passages that stay are compared window by window in the same way.
4. The spans found go back to their bucket, where the words are removed.

A phrase or passage adds one row per bucket to a shuffle however often the bucket has it; a window that stands in
different passages adds one for each of these.  Texts are shuffled once, to their buckets.
Symbols only propose candidates; the decision rests on 64-bit hashes of the words.

Cases: a null or blank text has no words; documents of fewer words than a window stay; null doc_ids
are the smallest; rows with the same doc_id are ordered by a hash of their text; of repeated rows
(same doc_id and text) one comes first and the others repeat it; a very long text is a bucket's largest part, worked
whole; an empty table gives no rows; other columns keep their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.common import text_mb
from deskmill.llm.words import U64, mix, pieces, split_words, whole_windows, window_hashes

PHRASE = 5
_BITS = 12
#: Symbols are shown to the automaton as characters from here on.
_BASE = 0x100


def _phrase_keys(word_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each word, and the key of each phrase (its symbols, 12 bits each)."""
    symbols = (word_hash >> U64(64 - _BITS)).astype(np.uint32)
    n = len(symbols) - PHRASE + 1
    keys = np.zeros(max(n, 0), U64)
    for i in range(PHRASE if n > 0 else 0):
        keys = keys << U64(_BITS) | symbols[i : i + n].astype(U64)
    return symbols, keys


def _anchors(keys: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """For each window start the place of its anchor, the phrase with the least hash."""
    order = mix(keys + U64(1))
    out = np.empty(len(windows), np.int64)
    if not len(windows):
        return out
    views = sliding_window_view(order, window - PHRASE + 1)
    for at in range(0, len(windows), 1 << 18):
        some = windows[at : at + (1 << 18)]
        if some[-1] - some[0] + 1 == len(some):
            out[at : at + len(some)] = some + views[some[0] : some[-1] + 1].argmin(axis=1)
        else:
            out[at : at + len(some)] = some + views[some].argmin(axis=1)
    return out


def _window_starts(t, window: int) -> np.ndarray:
    return np.flatnonzero(whole_windows(t.first, len(t.start), window))


def _recurring_phrases(docs: DataFrame, window: int) -> DataFrame:
    """(bucket, phrase) of every phrase that anchors windows at two places at least."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch["bucket"].to_numpy()
            for bucket in np.unique(buckets):
                mine = batch.filter(pa.array(buckets == bucket))
                for part in pieces(mine, max_bytes=1 << 23):
                    t = split_words(part["text"])
                    _, keys = _phrase_keys(t.hash)
                    found, n = np.unique(keys[np.unique(_anchors(keys, _window_starts(t, window), window))], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bucket)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], ["bucket", "phrase", "n"])

    rows = docs.mapInArrow(anchors, "bucket int, phrase long, n int")  # all columns, so that one shuffle of texts serves all steps
    total = F.sum("n").over(Window.partitionBy("phrase"))
    return rows.withColumn("total", total).where("total > 1").select("bucket", "phrase")


def _occurrences(phrases: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Places where one of the phrases starts, ascending, found by an Aho-Corasick automaton over the symbols."""
    import ahocorasick

    if not len(phrases):
        return np.empty(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    shifts = U64(_BITS) * np.arange(PHRASE - 1, -1, -1, dtype=U64)
    letters = (phrases[:, None] >> shifts & U64((1 << _BITS) - 1)).astype("<u4") + _BASE
    joined = letters.tobytes().decode("utf-32-le")
    for i in range(0, len(joined), PHRASE):
        automaton.add_word(joined[i : i + PHRASE])
    automaton.make_automaton()
    text = (symbols.astype("<u4") + _BASE).tobytes().decode("utf-32-le")
    return np.fromiter((end for end, _ in automaton.iter(text)), np.int64) - PHRASE + 1


def _runs(hits: np.ndarray, keys: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows that each hit anchors, for hits that anchor some."""
    doc = np.searchsorted(first, hits, side="right") - 1
    begin, end = first[doc], first[doc + 1]
    inside = hits + PHRASE <= end
    hits, begin, end = hits[inside], begin[inside], end[inside]
    order, reach = mix(keys + U64(1)), window - PHRASE
    mine = order[hits]
    low, high = np.maximum(hits - reach, begin), np.minimum(hits, end - window)
    for d in range(1, reach + 1):
        before = np.maximum(hits - d, begin)  # of equal phrases the first is the anchor
        low = np.where((before < hits) & (order[before] <= mine), np.maximum(low, before + 1), low)
        after = np.minimum(hits + d, end - PHRASE)
        high = np.where(order[after] < mine, np.minimum(high, after - reach - 1), high)
    some = high >= low
    return low[some], high[some]


def _positions(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row order by (doc_id with null first, tie), and True for rows that repeat the row before."""
    doc = table["doc_id"].combine_chunks()
    null = doc.is_null().to_numpy(zero_copy_only=False)
    doc, tie = doc.fill_null(0).to_numpy(), table["tie"].combine_chunks().to_numpy()
    order = np.lexsort((tie, doc, ~null))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        same[1:] = (doc[a] == doc[b]) & (tie[a] == tie[b]) & (null[a] == null[b])
    return order, same


_OCCURRENCE = "key long, bucket int, doc_id long, tie long, start int, n int, later array<struct<doc_id: long, tie: long, start: int, n: int>>"


def _first_of_equal(key: np.ndarray, columns: dict[str, list | np.ndarray], bucket: int, extra: dict[str, list] | None = None) -> pa.Table:
    """One row per key: its first occurrence in this bucket; the others are listed in ``later``.  Rows are in corpus order."""
    _, lead, group = np.unique(key, return_index=True, return_inverse=True)
    rest = np.ones(len(key), bool)
    rest[lead] = False
    rest = np.flatnonzero(rest)
    rest = rest[np.argsort(group[rest], kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group[rest], minlength=len(lead)))]).astype(np.int32)
    kinds = {"doc_id": pa.int64(), "tie": pa.int64(), "start": pa.int32(), "n": pa.int32()}
    arrays = {c: pa.array(columns[c], kinds[c]) for c in kinds}
    later = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([a.take(pa.array(rest)) for a in arrays.values()], list(kinds)))
    lead_at = pa.array(lead)
    out = {"key": pa.array(key[lead].view(np.int64)), "bucket": pa.array(np.full(len(lead), bucket, np.int32))} | {c: a.take(lead_at) for c, a in arrays.items()} | {"later": later}
    for name, values in (extra or {}).items():
        out[name] = values.take(lead_at)
    return pa.table(out)


def _passages(docs: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    """First passages of each bucket, with the hashes of their windows."""

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order, same = _positions(left)
        left = left.take(pa.array(order[~same]))
        t = split_words(left["text"].combine_chunks())
        symbols, keys = _phrase_keys(t.hash)
        hits = _occurrences(np.unique(right["phrase"].combine_chunks().to_numpy()).view(U64), symbols)
        low, high = _runs(hits, keys, t.first, window)
        n = high - low + 1
        head = np.cumsum(n) - n
        starts = np.repeat(low - head, n) + np.arange(n.sum())
        hashes = window_hashes(t.hash, window)[starts]
        place = np.arange(len(starts)) - np.repeat(head, n)
        total = np.add.reduceat(mix(hashes + place.astype(U64)), head) if len(head) else np.empty(0, U64)
        passage = mix(total + n.astype(U64))
        doc = np.searchsorted(t.first, starts[head], side="right") - 1
        at = pa.array(doc)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([head, [len(starts)]]).astype(np.int32)), pa.array(hashes.view(np.int64)))
        columns = {"doc_id": left["doc_id"].combine_chunks().take(at), "tie": left["tie"].combine_chunks().take(at), "start": (starts[head] - t.first[doc]).astype(np.int32), "n": n.astype(np.int32)}
        return _first_of_equal(passage, columns, key[0].as_py() if hasattr(key[0], "as_py") else key[0], {"windows": lists})

    return docs.groupBy("bucket").cogroup(phrases.groupBy("bucket")).applyInArrow(locate, _OCCURRENCE + ", windows array<long>")


def _rank(rows: DataFrame, parts: int) -> DataFrame:
    """``rank`` 1 for the first occurrence of a key; a key has a row per bucket at most."""
    order = Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_first(), "tie", "start")
    return rows.repartition(parts, "key").withColumn("rank", F.row_number().over(order))


def _spans(ranked: DataFrame) -> DataFrame:
    own = F.when(F.col("rank") > 1, F.array(F.struct("doc_id", "tie", "start", "n"))).otherwise(F.array().cast("array<struct<doc_id: long, tie: long, start: int, n: int>>"))
    return ranked.select("bucket", F.explode(F.concat(own, "later")).alias("s")).select("bucket", "s.*")


def _windows(ranked: DataFrame) -> DataFrame:
    """Windows of the passages that stay, one row per bucket and window."""
    w = ranked.where("rank = 1 AND n > 0 AND size(later) >= 0").select("bucket", "doc_id", "tie", "start", F.posexplode("windows").alias("i", "key"))
    return w.select("key", "bucket", "doc_id", "tie", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n"), F.array().cast("array<struct<doc_id: long, tie: long, start: int, n: int>>").alias("later"))


def _rewrite(docs: DataFrame, spans: DataFrame, window: int, keep_untouched: bool) -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name not in ("bucket", "text")]
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        order, same = _positions(left)
        left = left.take(pa.array(order))
        text = left["text"].combine_chunks()
        t = split_words(text, hashed=False)
        counts = np.diff(t.first)
        doc_ids, ties = left["doc_id"].to_pylist(), left["tie"].to_pylist()
        row = {k: i for i, k in reversed(list(enumerate(zip(doc_ids, ties, strict=True))))}
        change = np.zeros(len(t.start) + 1, np.int64)
        if right.num_rows:
            where = np.array([row[k] for k in zip(right["doc_id"].to_pylist(), right["tie"].to_pylist(), strict=True)], np.int64)
            begin = t.first[where] + right["start"].combine_chunks().to_numpy()
            np.add.at(change, begin, 1)
            np.add.at(change, begin + right["n"].combine_chunks().to_numpy() + window - 1, -1)
        for i in np.flatnonzero(same & (counts >= window)):  # repeated rows
            change[t.first[i]] += 1
            change[t.first[i + 1]] -= 1
        gone = np.cumsum(change)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[t.first[1:]] - total[t.first[:-1]]
        data, start, end = t.data.tobytes(), t.start.tolist(), t.end.tolist()
        kept = []
        for i, (a, b) in enumerate(zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True)):
            if removed[i]:
                kept.append(b" ".join([data[start[k] : end[k]] for k in (a + np.flatnonzero(~gone[a:b])).tolist()]).decode())
            elif keep_untouched:
                kept.append(text[i].as_py())
            else:
                kept.append(b" ".join(data[start[a] : end[b - 1]].split()).decode() if b > a else "")
        values = [left[f.name] for f in fields] + [pa.array(counts), pa.array(removed), pa.array(kept, pa.string())]
        return pa.Table.from_arrays(values, names=[f.name for f in [*fields, *added]])

    return docs.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(remove, T.StructType([*fields, *added]))


def remove_repeated_passages(docs: DataFrame, window: int = 20, bucket_mb: float = 8, task_mb: float = 24, keep_untouched: bool = False) -> DataFrame:
    """Each row of ``docs`` with n_words, n_removed and ``kept``: the words that stay, joined by one space.

    A bucket, of about ``bucket_mb`` of text, is what one automaton sees; a task works the buckets of ``task_mb``.  ``keep_untouched`` leaves texts without a repeated passage as they are.  Other columns of ``docs`` are kept as c0, c1 and so on.
    """
    if window < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    d = d.withColumn("tie", F.xxhash64("text"))
    size = text_mb(docs)
    buckets, parts = 1 + int(size / bucket_mb), 1 + int(size / task_mb)
    bucket = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("tie")), F.lit(buckets)).cast("int")
    d = d.withColumn("bucket", bucket).repartition(parts, "bucket")
    # Both readers of the passages ask for all columns, so that they share one shuffle.
    passages = _rank(_passages(d, _recurring_phrases(d, window), window), parts)
    windows = _rank(_windows(passages), parts)
    return _rewrite(d, _spans(passages.where("size(windows) > 0")).unionByName(_spans(windows)), window, keep_untouched)


def dedup_substrings(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; untouched texts stay as they are, documents without a word left go."""
    found = remove_repeated_passages(docs, window, keep_untouched=True).where("n_removed < n_words OR n_words = 0")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return found.select(*(back[c].alias(c) for c in docs.columns))
