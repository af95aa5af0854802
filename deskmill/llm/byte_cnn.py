"""Quality classifier: a convolutional network over the bytes of whole documents, in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Every filter is a table of
weights per byte value and place, so its response at a position is a sum of look-ups; a chunk keeps each
filter's largest response, the rectified maxima of all chunks are averaged, and a logistic unit turns them
into one probability.  The filters and the unit are learned by gradient descent (Adam); only the
place of each maximum carries a gradient back, so a step backwards is cheap.

Training takes at most ``sample_per_class`` labelled documents of each class (those with the least hash of
their id), and of each at most ``train_chunks`` chunks, evenly spread over the whole document; that bounds
what comes to the driver (2 x 2,000 x 8 x 256 bytes by default).  Documents weigh as their class's share of all
labelled rows asks, so that the score is a probability.  Scoring reads whole documents where they lie, in
pieces of a fixed number of chunks, with the weights broadcast (0.1 MB).

Cases: a null or empty text has one chunk of padding, and so a score; documents without label, id or with a label
other than 0 and 1 don't train; an id labelled both ways counts once as each; of documents that repeat an id one trains,
the one with the least bytes; labels of absent documents take places of the sample; with labels of one class only the score
is that class's share, and without any it is 0.5; repeated rows are scored each; very long texts are worked in
pieces; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.words import pieces, text_bytes

#: Bytes of a chunk, and how many of them the next chunk repeats: no place of a filter is lost between two.
CHUNK, OVERLAP = 256, 16
#: Chunks that are worked at once.
_AT_ONCE = 64


@dataclass
class Network:
    """tables (width x 256 x filters), bias (filters), weight (filters) and offset of the logistic unit."""

    tables: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    def responses(self, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Response of each filter at each place of each chunk, without bias; places that reach over a chunk's end are out."""
        width = len(self.tables)
        places = chunks.shape[1] - width + 1
        total = self.tables[0][chunks[:, :places]]
        for i in range(1, width):
            total += self.tables[i][chunks[:, i : i + places]]
        beyond = np.arange(places) > np.maximum(sizes - width, 0)[:, None]
        total[beyond] = -np.inf
        return total


def chunk_places(size: int) -> np.ndarray:
    """Where the chunks of a document of ``size`` bytes start: one at least, the last reaches its end."""
    return np.arange(0, max(1, size - OVERLAP), CHUNK - OVERLAP)


def cut_chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of one document's bytes from ``starts``, padded with zeros, and their sizes."""
    sizes = np.minimum(CHUNK, len(data) - starts)
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts], sizes


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def fit(chunks: np.ndarray, sizes: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray, filters: int = 24, width: int = 6, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """The network for chunks (of document ``doc``, ascending from 0) and a label and weight per document."""
    rng = np.random.default_rng(seed)
    prior = np.average(label, weights=weight)
    net = Network(rng.normal(0, 0.1, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.3, filters).astype(np.float32), float(np.log(prior / (1 - prior))))
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    first = np.searchsorted(doc, np.arange(len(label) + 1))
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(label))])
        mine, order = order[:batch], order[batch:]
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in mine])
        n = first[mine + 1] - first[mine]
        owner = np.repeat(np.arange(len(mine)), n)
        total = net.responses(chunks[rows], sizes[rows])
        at = total.argmax(axis=1)
        top = np.take_along_axis(total, at[:, None, :], axis=1)[:, 0] + net.bias
        live = np.maximum(top, 0)
        mean = np.zeros((len(mine), filters))
        np.add.at(mean, owner, live)
        mean /= n[:, None]
        wrong = (_sigmoid(mean @ net.weight + net.offset) - label[mine]) * weight[mine] / weight[mine].sum()
        back = (wrong / n)[owner, None] * net.weight * (top > 0)
        tables = np.zeros_like(net.tables)
        unit = np.broadcast_to(np.arange(filters), at.shape)
        for i in range(width):
            np.add.at(tables[i], (np.take_along_axis(chunks[rows], at + i, axis=1), unit), back)
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, gradient in (("tables", tables), ("bias", back.sum(axis=0)), ("weight", wrong @ mean + 1e-4 * net.weight), ("offset", wrong.sum())):
            m, v = moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * np.square(gradient)
            moments[name] = m, v
            setattr(net, name, getattr(net, name) - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        net.tables = net.tables.astype(np.float32)
    return net


def _constant(labels) -> Network:
    """A network that gives every document the share of label 1 among ``labels``: one value, or none."""
    offset = 0.0 if not labels else 50.0 if 1 in labels else -50.0
    return Network(np.zeros((1, 256, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), offset)


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = 2000, train_chunks: int = 8) -> Network:
    """The network for documents (doc_id, text) and labels (doc_id, quality).

    The sample is drawn from the labels; its ids (2 x ``sample_per_class`` at most) go to the documents, no text is shuffled.
    """
    rows = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").distinct()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return _constant(sizes)
    # Rows under a share of the hash range that leaves about the wanted number, then exactly that many at most.
    share = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, 1.2 * sample_per_class / n))])
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("label")])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))).where(F.col("rank") <= sample_per_class)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data, starts = text_bytes(part["text"])
                out = []
                for a, b in zip(starts, starts[1:], strict=False):
                    places = chunk_places(b - a - 1)
                    if len(places) > train_chunks:
                        places = places[np.linspace(0, len(places) - 1, train_chunks).round().astype(np.int64)]
                    chunks, n = cut_chunks(data[a : b - 1], places)
                    out.append((chunks.tobytes(), n.tolist()))
                yield pa.RecordBatch.from_arrays([part["id"], part["label"], pa.array([x for x, _ in out], pa.binary()), pa.array([n for _, n in out], pa.list_(pa.int32()))], ["id", "label", "chunks", "sizes"])

    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows.select("id", "label")), "id")
    one = texts.select("id", "label", "text").mapInArrow(cut, "id string, label int, chunks binary, sizes array<int>").groupBy("id", "label").agg(F.min(F.struct("chunks", "sizes")).alias("c"))
    found = one.select("id", "label", "c.*").collect()
    if len({r["label"] for r in found}) < 2:
        return _constant({r["label"] for r in found})
    found.sort(key=lambda r: (r["id"], r["label"]))
    chunks = np.frombuffer(b"".join(r["chunks"] for r in found), np.uint8).reshape(-1, CHUNK)
    label = np.array([r["label"] for r in found])
    # Each class weighs as it does among all labelled rows.
    weight = np.where(label == 1, sizes[1] / label.sum(), sizes[0] / (1 - label).sum())
    return fit(chunks, np.concatenate([r["sizes"] for r in found]), np.repeat(np.arange(len(found)), [len(r["sizes"]) for r in found]), label, weight / weight.mean())


def document_score(net: Network, data: np.ndarray) -> float:
    """Probability of label 1 for the bytes of one whole document."""
    places, total = chunk_places(len(data)), np.zeros(len(net.bias))
    for i in range(0, len(places), _AT_ONCE):
        top = net.responses(*cut_chunks(data, places[i : i + _AT_ONCE])).max(axis=1) + net.bias
        total += np.maximum(top, 0).sum(axis=0)
    return float(_sigmoid(total / len(places) @ net.weight + net.offset))


def predict(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of documents (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in pieces(batch):
                data, starts = text_bytes(part["text"])
                scores = [document_score(net, data[a : b - 1]) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
