"""Filter interaction audit: what each of five filters removes in every order, kept up to date by a stream.

Documents come as available-now micro-batches.  Texts are keys of the stream's state (by digest, in buckets of about
a thousand), which holds the smallest id seen with each and the rows of that id.  A row is counted under the mask of the filters that it
fails; when a smaller id arrives with the same text, the rows of the former smallest id are copies from then
on, so their earlier masks are taken back from the counters of their part and counted anew.  Each micro-batch
adds its changes as one small table of counters per part and mask; a repeated micro-batch overwrites its own.

The order of files doesn't matter.  Texts stay out of the shuffles: what travels is a digest, five bits and
the part.  Rows of one text that meet in a task are combined before the shuffle, so a group of copies sends
one row per task and label, however large it is.  The counters have at most 128 rows per part and batch.

Filters, as failure conditions over whole texts (words are runs of other than space and 0x09-0x0D):
A: fewer than 200 words; B: under half of the words distinct; C: more than 3 % of the code points in A-Z;
D: one of ``#$%&*|``; E: the text of a smaller id, removed or not.

Cases: a null text is empty; a null id is neither smaller nor larger than another, so such a row never fails E
and makes no other row fail it; rows that repeat an id are counted each, and equal ids make no copies; a null
language is the part with the empty name, together with empty ones; several labels of an id count as 1 if one
of them is; rows without labels are neither good nor toxic; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskmill.llm.common import SPACE_CLASS, SPACES, shared_folder

FILTERS = "ABCDE"
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_COUNTS = "part string, mask int, flags int, n long"
_ROW = ["bucket", "digest", "mask", "known", "part", "flags"]
_HELD = ["digest", "mask", "part", "flags", "low", "at"]
_TYPES = {"digest": pa.string(), "mask": pa.int32(), "part": pa.string(), "flags": pa.int32(), "low": pa.int64(), "at": pa.int64()}
#: State lies on the executors' disks and as changes in the checkpoint; small stores don't reserve space.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def audit_table(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, texts_per_bucket: int = 1024) -> DataFrame:
    """``audit_orders`` of the whole table of documents at ``path``."""
    buckets = -(-max(1, spark.read.parquet(path).count()) // texts_per_bucket)
    return audit_orders(count_masks(stream_table(spark, path, batches), labels, buckets))


def stream_table(spark: SparkSession, path: str, batches: int = 4) -> DataFrame:
    """The table at ``path`` as a stream of about ``batches`` micro-batches of whole files."""
    table = spark.read.parquet(path)
    files = -(-max(1, len(table.inputFiles())) // batches)
    # As a pattern, the path may name a folder or one file.
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{{{name}}}")


def failed_filters(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    inner = F.btrim(text, F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACE_CLASS}+"))
    # One pass over the words gives both of their counts.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return F.transform(
        F.array(F.struct(counts.alias("w"), capitals.alias("c"))),
        lambda x: F.when(x["w"]["n"] < 200, _BIT["A"]).otherwise(0)
        + F.when(100 * x["w"]["kinds"].cast("long") < 50 * x["w"]["n"].cast("long"), _BIT["B"]).otherwise(0)
        + F.when(100 * x["c"].cast("long") > 3 * F.length(text).cast("long"), _BIT["C"]).otherwise(0)
        + F.when(F.rlike(text, F.lit(r"[#$%&*|]")), _BIT["D"]).otherwise(0),
    )[0]


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one text, part and label in one: the smallest id, how many rows have it, and how many have a larger one."""
    for rows in batches:
        if len(rows):
            low = rows.groupby(_ROW, sort=False)["doc_id"].transform("min")
            rows = rows.assign(low=low, at=(rows["doc_id"] == low).astype("int64"), above=(rows["doc_id"] != low).astype("int64"))
            yield rows.groupby(_ROW, sort=False, as_index=False).agg({"low": "first", "at": "sum", "above": "sum"})


def _counted(rows: pd.DataFrame, n: pd.Series, copy: bool) -> pd.DataFrame:
    mask = rows["mask"] | _BIT["E"] if copy else rows["mask"]
    return pd.DataFrame({"part": rows["part"], "mask": mask, "flags": rows["flags"], "n": n})


def _retract(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows that have the smallest id of their text after ``new`` rows, and the changes of the counters.

    ``held`` are such rows before (digest, mask, part, flags, low, at); those that a smaller id displaces are taken back.
    """
    nameless = new[~new["known"]]
    new = new[new["known"]]
    rows = pd.concat([held.assign(above=0, old=True), new.drop(columns=["known", "bucket"]).assign(old=False)], ignore_index=True)
    least = rows["low"] == rows.groupby("digest", sort=False)["low"].transform("min")
    old = rows["old"].astype(bool)
    out, fresh, late = rows[old & ~least], rows[~old & least], rows[~old & ~least]
    changes = pd.concat([
        _counted(nameless, nameless["at"] + nameless["above"], False),
        _counted(out, -out["at"], False), _counted(out, out["at"], True),
        _counted(fresh, fresh["at"], False), _counted(fresh, fresh["above"], True),
        _counted(late, late["at"] + late["above"], True),
    ])
    held = rows[least].groupby(["digest", "mask", "part", "flags", "low"], sort=False, as_index=False)["at"].sum()
    return held[_HELD], changes.groupby(["part", "mask", "flags"], sort=False, as_index=False)["n"].sum()


def _retracting(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Changes of the counters by the new rows of one bucket of texts; the state is the bucket's rows with the smallest ids."""
    if state.exists:
        held = pa.ipc.open_stream(state.get[0]).read_pandas()
    else:
        held = pd.DataFrame({c: pd.Series(dtype="object" if c in ("digest", "part") else "int64") for c in _HELD})
    for rows in batches:
        held, changes = _retract(held, rows)
        yield changes[changes["n"] != 0]
    sink = pa.BufferOutputStream()
    table = pa.Table.from_arrays([pa.array(held[c], _TYPES[c]) for c in _HELD], _HELD)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def count_masks(stream: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """(part, mask, n, good, toxic) of a finite stream of documents (doc_id, text, lang) and labels (doc_id, quality, toxic).

    Texts are keyed by digest in ``buckets`` of the state: about a thousand texts in each are worked at once.
    """
    spark = stream.sparkSession
    one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality", "toxic").where("_id IS NOT NULL").groupBy("_id").agg((one("quality") + 2 * one("toxic")).alias("flags"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stream.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), failed_filters(text).alias("mask"))
    rows = rows.join(known.hint("merge"), F.col("_doc") == F.col("_id"), "left")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")
    rows = rows.select(bucket, "digest", "mask", F.col("_doc").isNotNull().alias("known"), F.coalesce("_doc", F.lit(0)).alias("doc_id"), "part", F.coalesce("flags", F.lit(0)).alias("flags"))
    rows = rows.mapInPandas(_combined, "bucket long, digest string, mask int, known boolean, part string, flags int, low long, at long, above long")
    changes = rows.groupBy("bucket").applyInPandasWithState(_retracting, _COUNTS, "held binary", "append", "NoTimeout")
    folder = shared_folder(spark, "filter-audit")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters/batch={batch_id}")

    spark.createDataFrame([], _COUNTS).coalesce(1).write.parquet(f"{folder}/counters/batch=-1")
    with _settings(spark, _STORE):
        query = changes.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    counts = spark.read.schema(_COUNTS).parquet(f"{folder}/counters")
    flag = lambda bit: F.sum(F.when(F.col("flags").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    return counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), flag(1).alias("good"), flag(2).alias("toxic")).where("n <> 0")


def audit_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley.

    ``masks`` are (part, mask, n, good, toxic); each of the 32 masks of a part meets the 600 steps of all orders.
    """
    steps = []
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(1 << filters.index(f)).alias("bit"), F.lit(before).alias("before")))
            before |= 1 << filters.index(f)
    # Steps in slices, so that no generated method holds all of them.
    slices = F.flatten(F.array(*(F.array(*steps[i : i + 60]) for i in range(0, len(steps), 60))))
    r = masks.select("*", F.explode(slices).alias("s")).select("*", "s.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    out = r.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~earlier).alias("kept"), total("n", fails & ~earlier).alias("removed"), total("n", fails & earlier).alias("redundant"), total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"), total("toxic", fails & ~earlier).alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows each
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))
