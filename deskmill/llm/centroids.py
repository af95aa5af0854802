"""Centroid clustering: Lloyd's rounds over vectors that are cut into blocks of columns (dimension shards).

Vectors become integers, ``floor(scale * x)``, and lie as blocks of rows by blocks of columns.  A task that
holds a column block adds up exact partial squared distances against its slice of the centroids;
``reduceByKey`` adds the blocks of one set of rows and the least sum names the cluster.  The cluster numbers
go back to the column blocks, which lie where they were (same partitioner, so no vector moves in a round),
and each shard replaces its own slice by the floored means.

Per round and vector, k distances a shard and one cluster number a shard are shuffled.  What comes to the
driver are the slices, k x dimensions integers.  Every round starts from the table of blocks in the shared
folder and from plain integers, so its lineage doesn't grow and lost executors cost their blocks only.

Cases: null vectors, and those with another number of components, or a null or non-finite one, are left out;
rows with a null id are clustered, but never start a cluster; repeated ids are rows of their own, and equal
hashes start clusters in the order of id and components; fewer vectors than clusters give that many clusters;
equal distances give the smaller number; components beyond +-2**27 count as that; sums of distances beyond a
long are its largest value; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import checkpoint, shared_folder

#: Squares of differences within this bound, summed over 64 components, fit in 64 bits.
_LIMIT = 1 << 27
_LARGEST = (1 << 63) - 1
_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, dimensions: int = 64) -> DataFrame:
    """(vec_id, x) of the vectors with ``dimensions`` finite components."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    return v.where(F.coalesce((F.size("x") == dimensions) & finite, F.lit(False)))


def first_centroids(vectors: DataFrame, k: int, salt: str, scale: int = 1024) -> np.ndarray:
    """The k vectors with the least sha256 of ``<salt>:<vec_id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(key, "vec_id", "x").limit(k).collect()
    return np.array([_integers(np.array(r["x"]), scale) for r in rows], np.int64)


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * x), -_LIMIT, _LIMIT).astype(np.int32)


def column_blocks(dimensions: int, shards: int) -> list[slice]:
    edge = [dimensions * i // shards for i in range(shards + 1)]
    return [slice(a, b) for a, b in zip(edge, edge[1:], strict=False)]


def write_blocks(vectors: DataFrame, path: str, columns: list[slice], scale: int = 1024, rows: int = 4096) -> None:
    """The table (block, shard, ids, cells): integers of up to ``rows`` vectors in one block of columns; shard 0 holds the ids."""
    width = columns[-1].stop

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                x = _integers(part["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
                block = (part["task"][0].as_py() << 32) + made
                made += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(columns), pa.int64()),
                    pa.array(range(len(columns)), pa.int32()),
                    pa.array([part["vec_id"].to_pylist()] + [None] * (len(columns) - 1), pa.list_(pa.int64())),
                    pa.array([x[:, c].astype("<i4").tobytes() for c in columns], pa.binary()),
                ], ["block", "shard", "ids", "cells"])

    numbered = vectors.select("vec_id", "x", F.spark_partition_id().cast("long").alias("task"))
    numbered.mapInArrow(cut, "block long, shard int, ids array<long>, cells binary").write.parquet(path)


def _partial(cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances over one block of columns (vectors x k), in as few bytes as they need."""
    out = np.empty((len(cells), len(centroids)), np.int64)
    for i, c in enumerate(centroids):
        difference = cells - c
        out[:, i] = np.einsum("ij,ij->i", difference, difference)
    return out.astype(np.uint32) if not out.size or out.max() < 1 << 32 else out


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) + b


def _add_sums(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", dimensions: int = 64, scale: int = 1024, shards: int = 4) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of (vec_id, embedding)."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    vectors = whole_vectors(vectors, dimensions)
    centroids = first_centroids(vectors, k, salt, scale)
    if not len(centroids):
        return spark.createDataFrame([], _SCHEMA)
    k, columns, path = len(centroids), column_blocks(dimensions, shards), shared_folder(spark, "vector-blocks")
    write_blocks(vectors, path, columns, scale)
    table = spark.read.schema("block long, shard int, ids array<long>, cells binary").parquet(path)
    parts = max(sc.defaultParallelism, -(-table.count() // 256))

    def cells(row) -> tuple:
        c = columns[row["shard"]]
        return (row["block"], row["shard"]), np.frombuffer(row["cells"], "<i4").reshape(-1, c.stop - c.start).astype(np.int64)

    # Dealt out once: every round's join finds its column blocks in place.
    held = table.select("block", "shard", "cells").rdd.map(cells).partitionBy(parts)

    def distances(now):
        return held.map(lambda e: (e[0][0], _partial(e[1], now.value[:, columns[e[0][1]]]))).reduceByKey(_add, parts)

    def sums(entry) -> tuple:
        (_, shard), (x, cluster) = entry
        total = np.zeros((k, x.shape[1]), np.int64)
        np.add.at(total, cluster, x)
        return shard, (total.astype(object), np.bincount(cluster, minlength=k).astype(object))

    for _ in range(rounds):
        now = sc.broadcast(centroids)
        nearest = distances(now).mapValues(lambda d: d.argmin(axis=1).astype(np.uint16))
        told = nearest.flatMap(lambda e: [((e[0], s), e[1]) for s in range(len(columns))]).partitionBy(parts)

        def moved(entry, now=now) -> tuple:
            shard, (total, n) = entry
            mine = now.value[:, columns[shard]].copy()
            for i in np.flatnonzero(n):
                mine[i] = total[i] // n[i]  # exact, and floored as Python's integers are
            return shard, mine

        slices = dict(held.join(told, parts).map(sums).reduceByKey(_add_sums, len(columns)).map(moved).collect())
        centroids = np.concatenate([slices[s] for s in range(len(columns))], axis=1)
        now.unpersist()

    now = sc.broadcast(centroids)

    def judged(entry) -> tuple:
        block, d = entry
        nearest = d.argmin(axis=1)
        return block, nearest.tolist(), d[np.arange(len(d)), nearest].tolist()

    found = spark.createDataFrame(distances(now).map(judged), "block long, cluster array<int>, distance array<long>", verifySchema=False)
    ids = table.where("shard = 0").select("block", "ids")
    found = checkpoint(found.join(ids, "block").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("r")).select(F.col("r.ids").alias("vec_id"), "r.cluster", "r.distance"))
    weight = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}  # k rows
    every = min(sum(weight.values()), _LARGEST)
    facts = [(i, min(weight.get(i, 0), _LARGEST), every, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
