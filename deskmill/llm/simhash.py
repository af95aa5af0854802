"""SimHash near-duplicates through an inverted index of positional bytes.

Two operators share the method.  Fingerprints are cut into positional bytes; an inverted index
brings together fingerprints with the guaranteed minimum of equal bytes at equal positions; only
those are verified.

``hamming_components`` links 64-bit fingerprints at ``max_bits`` (2) or fewer differing bits.  Two bits
touch two bytes at most, so linked fingerprints share six of their eight positional bytes: postings
are keyed by the 28 choices of six positions and their bytes.  A pair with m equal bytes meets
in C(m, 6) postings, so every pair in a posting has reached the minimum.  Members of a posting
differ in two known bytes only: there are 65,536 at most, whatever the input, and they are
verified without listing pairs, by looking up the 136 byte pairs near each.

``near_duplicates`` finds documents with a word-shingle similarity (Jaccard) of 0.8 or more, which 64 bits
can't tell.  Its fingerprint is wide: distinct shingles are dealt to lanes by hash, some four
to a lane, and each lane gets the eight bytes of its own SimHash.  Lanes in common are postings in common.
First the members of a posting meet the one that shares most (a star, which joins the copies of an original at
once); then the pairs of the postings of wide lanes that are not in one component by then meet, those of one
family (the texts that share a most frequent head) in blocks of texts in which lanes in common are tallied, the few others as
pairs.  The similarity is verified over whole texts, which are sent once to a bucket of many pairs, not once for each pair.

Cases: a null or blank text has no words: fingerprint zero, linked like any other here, and a copy of
other blank texts there; fewer words than a shingle are one shingle; a very long text is worked as one
slice of its own; repeated rows are linked as copies; null doc_ids take part, and a component of nulls only
has a null id; an empty table gives no rows; other columns keep their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import checkpoint, free_name
from deskmill.llm.components import connected_components
from deskmill.llm.words import U64, Words, joined_by_space, mix, pieces, split_words, whole_windows, window_hashes

_CHUNK = 1 << 17
#: Members of a posting that meet all others in one join key.
_BLOCK = 256
#: Lanes of as many shingles of a text or more bring together the pairs that the star leaves; they hold fewer unlike pairs than small lanes.
_WIDE_LANE = 3.2
#: Text that a bucket of pairs is to hold.
_BUCKET_BYTES = 1 << 24


def bit_majority(hashes: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Per group the 64-bit integer whose bits are set in over half of its hashes; ``group`` ascends."""
    ones, total = np.zeros((n_groups, 64), np.int64), np.bincount(group, minlength=n_groups)
    for at in range(0, len(hashes), _CHUNK):
        g = group[at : at + _CHUNK]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[g[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(U64)


def shingle_xxh64(words: Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle (words joined by one space) and the text it is of."""
    from xxhash import xxh64_intdigest

    words = joined_by_space(words)
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    start = words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(start + size, words.first[1:][doc]) - 1
    data = words.data.tobytes()
    digests = [xxh64_intdigest(data[s:e], seed) for s, e in zip(words.start[start].tolist(), words.end[last].tolist(), strict=True)]
    return np.array(digests, U64), doc


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and 64-bit SimHash over all shingles of each whole text, A-Z in lower case."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                hashes, doc = shingle_xxh64(split_words(part["text"], lower=True, hashed=False), shingle, seed)
                found = bit_majority(hashes, doc, part.num_rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found)], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(prints, "doc_id long, fingerprint long")


def near_masks(max_bits: int) -> list[int]:
    """16-bit patterns of one to ``max_bits`` bits."""
    return [sum(1 << b for b in c) for k in range(1, max_bits + 1) for c in combinations(range(16), k)]


def posting_edges(members: np.ndarray, free: tuple[int, int], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links among fingerprints that differ in the two ``free`` bytes only."""
    a, b = (U64(8 * i) for i in free)
    local = ((members >> a & U64(255)) | (members >> b & U64(255)) << U64(8)).astype(np.int64)
    if len(members) <= 16:
        near = np.array([[int(x ^ y).bit_count() <= max_bits for y in local.tolist()] for x in local.tolist()])
        i, j = np.nonzero(near)
    else:
        at = np.full(1 << 16, -1, np.int64)
        at[local] = np.arange(len(local))
        pairs = [(np.arange(len(local)), at[local ^ m]) for m in near_masks(max_bits)]
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        i, j = i[j >= 0], j[j >= 0]
    label = np.arange(len(local))
    while True:  # least member of each group of links
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(local)))
    return members[moved], members[label[moved]]


def hamming_components(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    if max_bits not in (0, 1, 2):
        raise ValueError("two free bytes hold at most two differing bits in every case")
    choices = list(combinations(range(8), 2))

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    prints = checkpoint(prints)
    distinct = checkpoint(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    fixed = [signed((1 << 64) - 1 & ~(0xFF << 8 * a) & ~(0xFF << 8 * b)) for a, b in choices]
    keys = F.array(*(F.struct(F.lit(c).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bytes")) for c, m in enumerate(fixed)))
    spread = distinct.repartition(1 + distinct.count() // 20_000, "fingerprint")  # 28 rows come of each
    postings = spread.select("fingerprint", F.explode(keys).alias("key")).select("key.choice", "key.bytes", "fingerprint")
    postings = postings.groupBy("choice", "bytes").agg(F.collect_list("fingerprint").alias("members")).where(F.size("members") > 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, U64), np.empty(0, U64))]
            left, right = [], []
            for choice, members in zip(batch["choice"].to_pylist(), batch["members"].to_pylist(), strict=True):
                if len(members) == 2:
                    x, y = sorted(members)
                    if ((x ^ y) & (1 << 64) - 1).bit_count() <= max_bits:
                        left.append(y)
                        right.append(x)
                else:
                    out.append(posting_edges(np.sort(np.array(members, np.int64).view(U64)), choices[choice], max_bits))
            out.append((np.array(left, np.int64).view(U64), np.array(right, np.int64).view(U64)))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    edges = postings.select("choice", "members").mapInArrow(link, "a long, b long")
    reached = connected_components(edges)
    labelled = distinct.join(reached, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", F.coalesce("label", "fingerprint").alias("label"))
    roots = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    labelled = labelled.join(roots, "label").select(F.col("fingerprint").alias("print"), "component_id")
    return prints.join(labelled, F.col("fingerprint") == F.col("print")).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle."""
    h = window_hashes(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        else:
            value = np.full(min(1, b - a), b - a, U64)
            for x in words.hash[a:b]:
                value = mix(value * U64(3) + x)
            out.append(value)
    return out


def lane_prints(shingles: np.ndarray, lanes: int = 16, per_lane: int = 4) -> list[tuple[int, int]]:
    """(posting position, eight bytes) of the lanes, at the two lane counts next to len / per_lane."""
    out, n = [], len(shingles)
    if not n:
        return out
    dealt = mix(shingles ^ U64(0xA5A5A5A5A5A5A5A5))
    exact = np.log2(max(1.0, n / per_lane))
    for level in {int(np.floor(exact)), int(np.ceil(exact))}:
        lane = (dealt & U64((1 << level) - 1)).astype(np.int64)
        mine = np.flatnonzero(lane < lanes)
        order = mine[np.argsort(lane[mine], kind="stable")]
        used, group = np.unique(lane[order], return_inverse=True)
        found = bit_majority(mix(shingles[order] + U64(level)), group, len(used)).view(np.int64)
        out += [(level << 8 | int(p), int(v)) for p, v in zip(used, found, strict=True)]
    return out


def similar(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash and component (two hashes of its first text) of every distinct (doc_id, text).

    Equal texts are one text here, whatever their number; ``first_id`` is the smallest doc_id with it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    # One document per text: the hash and the length stand for the text.
    texts = rows.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch["text_hash"].to_numpy(), return_index=True)  # copies in one batch are worked once
            for part in pieces(batch.take(pa.array(np.sort(first)))):
                hashes, positions, prints, sizes = [], [], [], []
                for text_hash, found in zip(part["text_hash"].to_pylist(), shingle_sets(split_words(part["text"], lower=True), shingle), strict=True):
                    for position, value in lane_prints(found):
                        hashes.append(text_hash)
                        positions.append(position)
                        prints.append(value)
                        sizes.append(len(found))
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(positions, pa.int32()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32())], ["text_hash", "position", "bytes", "n"])

    postings = rows.select("text_hash", "text").mapInArrow(post, "text_hash long, position int, bytes long, n int")
    postings = checkpoint(postings)
    shared = postings.groupBy("position", "bytes").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).where("first <> last").select("position", "bytes")
    postings = checkpoint(postings.join(shared, ["position", "bytes"], "left_semi").distinct())
    sizes = postings.groupBy("position", "bytes").agg(F.count("*").alias("members"))
    postings = checkpoint(postings.join(sizes, ["position", "bytes"]))
    weights = postings.groupBy("text_hash").agg(F.sum("members").alias("weight"))
    heads = checkpoint(postings.join(weights, "text_hash").groupBy("position", "bytes").agg(F.max(F.struct("weight", "text_hash", "n")).alias("head")))
    heads = heads.select("position", "bytes", F.col("head.weight").alias("weight"), F.col("head.text_hash").alias("head"), F.col("head.n").alias("head_n"))
    near = F.least("n", "head_n") >= similarity * F.greatest("n", "head_n") - 1e-6
    pair = F.least("text_hash", "head").alias("text_hash"), F.greatest("text_hash", "head").alias("head")
    met = checkpoint(postings.join(heads, ["position", "bytes"]))
    star = checkpoint(met.where("text_hash <> head").where(near).select(*pair).distinct())
    # Texts of one family mostly share their most frequent head: blocks of them are verified against each other.
    family = met.groupBy("text_hash").agg(F.max(F.struct("weight", "head")).alias("f"), F.max("n").alias("n")).select("text_hash", "n", F.col("f.head").alias("family"))
    family = family.join(family.groupBy("family").agg(F.count("*").alias("k")), "family")
    block = F.xxhash64("family", F.pmod(F.xxhash64("text_hash"), F.ceil(F.col("k") / _BLOCK))).alias("block")
    family = checkpoint(family.select("text_hash", "n", "family", block))

    def verify(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, np.ndarray] = {}
        for batch in left.combine_chunks().to_batches():
            for part in pieces(batch):
                found.update(zip(part["text_hash"].to_pylist(), shingle_sets(split_words(part["text"], lower=True), shingle), strict=True))
        ends = zip(right["a"].to_pylist(), right["b"].to_pylist(), strict=True)
        keep = [i for i, (x, y) in enumerate(ends) if similar(found[x], found[y]) >= similarity]
        return right.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def texts_of(needed: DataFrame) -> DataFrame:
        """(text_hash, text) of the texts in ``needed``."""
        # Copies of a text are many rows: salted, so that they are cut down to one in several tasks.
        wanted = needed.select("text_hash").distinct().select("text_hash", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
        return checkpoint(salted.join(wanted, ["text_hash", "salt"], "left_semi").groupBy("text_hash").agg(F.first("text").alias("text")))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that are similar: both texts of a pair meet in a bucket of pairs of the same blocks."""
        blocks = pairs.join(family, "text_hash").join(family.select(F.col("text_hash").alias("head"), F.col("n").alias("head_n"), F.col("block").alias("head_block")), "head")
        blocks = checkpoint(blocks.select("text_hash", "head", "n", "head_n", F.xxhash64(F.least("block", "head_block"), F.greatest("block", "head_block")).alias("key")))
        needed = blocks.select("key", "text_hash", "n").union(blocks.select("key", "head", "head_n")).distinct()
        size = needed.agg(F.sum(F.col("n") + shingle)).first()[0] or 0
        bucket = F.pmod("key", F.lit(1 + 8 * size // _BUCKET_BYTES)).alias("bucket")
        needed = needed.select("text_hash", bucket).distinct()
        found = texts_of(needed)
        sent = needed.join(found, "text_hash").select("bucket", "text_hash", "text")
        cut = blocks.select(F.col("text_hash").alias("a"), F.col("head").alias("b"), bucket)
        return checkpoint(sent.groupBy("bucket").cogroup(cut.groupBy("bucket")).applyInArrow(verify, "a long, b long"))

    def link_block(block: pa.Table) -> pa.Table:
        """Similar pairs, of different components, of the texts of two blocks of a family; lanes in common are tallied first."""
        block = block.combine_chunks()
        ids, n, label = (block[c].to_numpy() for c in ("text_hash", "n", "label"))
        lanes = pa.ListArray.from_arrays(block["lanes"].chunk(0).offsets, block["lanes"].chunk(0).values) if len(ids) else None
        owner = np.repeat(np.arange(len(ids)), np.diff(lanes.offsets.to_numpy()))
        _, lane = np.unique(lanes.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(lane, kind="stable")
        lane, owner = lane[order], owner[order]
        tally = np.zeros((len(ids), len(ids)), np.uint8)
        for some in np.split(owner, np.flatnonzero(np.diff(lane)) + 1):
            tally[np.ix_(some, some)] += 1
        able = np.minimum.outer(n, n) >= similarity * np.maximum.outer(n, n) - 1e-6
        x, y = np.nonzero((tally > 0) & able & (label[:, None] != label[None, :]) & (ids[:, None] < ids[None, :]))
        sets: list[np.ndarray] = []
        if len(x):
            for batch in block.select(["text"]).to_batches():
                for part in pieces(batch):
                    sets += shingle_sets(split_words(part["text"], lower=True), shingle)
        keep = np.array([similar(sets[i], sets[j]) >= similarity for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
        return pa.table({"a": pa.array(ids[x[keep]]), "b": pa.array(ids[y[keep]])})

    def within_families() -> DataFrame:
        """Similar pairs of one family among the members of postings that are not in one component."""
        open_ = members.groupBy("family", "text_hash").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list(F.xxhash64("position", "bytes")).alias("lanes"))
        several = open_.groupBy("family").agg(F.count("*").alias("k"), F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("family", F.ceil(F.col("k") / _BLOCK).cast("int").alias("k"))
        open_ = checkpoint(open_.join(several, "family"))
        mine = F.pmod(F.xxhash64("text_hash"), F.col("k")).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.xxhash64("family", F.least(o, mine), F.greatest(o, mine)))
        sent = open_.join(texts_of(open_), "text_hash").select("text_hash", "n", "label", "lanes", "text", F.explode(meets).alias("meet"))
        return checkpoint(sent.groupBy("meet").applyInArrow(link_block, "a long, b long"))

    edges = verified(star)
    # All other pairs of a posting that are not in one component: a block of its members against each member.
    members = postings.join(connected_components(edges), F.col("text_hash") == F.col("node"), "left").select("position", "bytes", "text_hash", "n", "members", F.coalesce("label", "text_hash").alias("label"))
    members = members.where(F.col("n") >= _WIDE_LANE * F.pow(F.lit(2), F.shiftright("position", 8)))
    several = members.groupBy("position", "bytes").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("position", "bytes")
    members = members.join(several, ["position", "bytes"], "left_semi").join(family.select("text_hash", "family"), "text_hash")
    members = checkpoint(members)
    blocks = F.ceil(F.col("members") / _BLOCK).cast("int")
    left = members.withColumn("block", F.pmod(F.xxhash64("text_hash"), blocks).cast("int")).drop("members")
    right = members.select("position", "bytes", F.col("text_hash").alias("head"), F.col("n").alias("head_n"), F.col("label").alias("head_label"), F.col("family").alias("head_family"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    others = left.join(right, ["position", "bytes", "block"]).where("text_hash < head AND label <> head_label AND family <> head_family").where(near).select("text_hash", "head").distinct()
    others = checkpoint(others.join(star, ["text_hash", "head"], "left_anti"))
    reached = connected_components(edges.unionByName(verified(others)).unionByName(within_families()))
    labelled = texts.join(reached, F.col("text_hash") == F.col("node"), "left").select("text_hash", "first_id", F.coalesce("label", "text_hash").alias("component"))
    return labelled


def keep_first_of_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id (nulls last)."""
    labelled = near_duplicates(docs, shingle, similarity)
    order = F.struct(F.col("first_id").isNull(), "first_id", "text_hash")
    firsts = labelled.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.text_hash").alias("_kept_hash"), F.col("k.first_id").alias("_kept_id"))
    text_hash, kept_hash, kept_id = (free_name(docs, c) for c in ("_text_hash", "_kept_hash", "_kept_id"))
    rows = docs.withColumn(text_hash, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    firsts = firsts.withColumnsRenamed({"_kept_hash": kept_hash, "_kept_id": kept_id})
    rows = rows.join(firsts, (F.col(text_hash) == F.col(kept_hash)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
    # Rows of the same doc_id and text: one stays.
    return rows.dropDuplicates(["doc_id", text_hash]).drop(text_hash)
