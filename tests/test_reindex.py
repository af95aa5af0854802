import os

import numpy as np

from deskmill.sources.chunks import read_chunks, replace_chunks, write_chunks
from deskmill.streaming.reindex import stream_reindex

CHUNK = "source_type string, source_id long, site_id long, position int, content string, embedding array<float>"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_layout" not in d and "_ledger" not in d}


def rows(spark, path):
    return sorted((r.source_type, r.source_id, r.position, r.content) for r in read_chunks(spark, path).collect())


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(k, i, None, p, f"old {i} {p}", [1.0]) for k in ("entry", "url") for i in range(60) for p in range(2)]
    write_chunks(spark.createDataFrame(old, CHUNK), path, "overwrite", buckets=16)
    before = files(path)
    new = [("entry", 5, 1, 0, "new", [2.0]), ("entry", 6, 1, 0, "not asked for", [2.0]), ("url", 7, 1, 0, "failed", [2.0])]
    touched = spark.createDataFrame([("entry", 5), ("entry", 5), ("url", 8), ("url", 7), ("file", 1)], "source_type string, source_id long")
    failed = spark.createDataFrame([("url", 7)], "source_type string, source_id long")
    for _ in range(2):  # again: the same
        replace_chunks(spark.createDataFrame(new, CHUNK), touched, path, failed)
        want = [(k, i, p, c) for k, i, _, p, c, _ in old if (k, i) not in (("entry", 5), ("url", 8))] + [("entry", 5, 0, "new")]
        assert rows(spark, path) == sorted(want)
    folder = lambda f: os.path.dirname(f)
    changed = {folder(f) for f in before - files(path)}
    assert len(changed) == 2 and {f for f in before if folder(f) not in changed} <= files(path)
    everything = spark.createDataFrame([(k, i) for k in ("entry", "url") for i in range(60)], "source_type string, source_id long")
    replace_chunks(spark.createDataFrame([], CHUNK), everything, path)
    assert rows(spark, path) == []
    write_chunks(spark.createDataFrame(old[:3], CHUNK), path)
    assert len(rows(spark, path)) == 3


def embedder():
    return lambda texts: [None if "broken" in t else np.array([len(t)], np.float32) for t in texts]


CHANGE = "source_type string, source_id long, site_id long, version long, status string, draft boolean, title string, html string"


def test_stream_keeps_the_table_at_the_last_versions(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    write_chunks(spark.createDataFrame([("entry", 9, None, 0, "stays", [1.0]), ("entry", 4, None, 0, "old four", [1.0])], CHUNK), path, "overwrite", buckets=4)

    def save(*changes):
        spark.createDataFrame([("entry", i, site, v, status, draft, title, html) for i, site, v, status, draft, title, html in changes], CHANGE).coalesce(1).write.mode("append").parquet(source)

    def run(name):
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
        stream_reindex(stream, path, str(tmp_path / name), embedder, size=200, overlap=0).awaitTermination()

    def now():
        return sorted((r.source_id, r.site_id, r.content) for r in read_chunks(spark, path).collect())

    save((1, 1, 1, "live", False, "One", "<p>first</p>"), (1, 1, 2, "live", False, "One", "<p>second</p>"), (1, 2, 2, "live", False, "Un", "<p>deux</p>"), (1, 1, 3, "live", True, "One", "<p>draft</p>"), (2, 1, 1, "live", False, "Two", "<p>two</p>"))
    save((2, 1, 2, "disabled", False, "Two", "<p>two</p>"), (1, 1, 1, "live", False, "One", "<p>late</p>"), (3, 1, 1, "live", None, "", "three"), (4, 1, 1, "live", False, "Four", "broken"), (5, 1, 1, "live", False, "Five", ""))
    run("a")
    want = [(1, 1, "One\n\nsecond"), (1, 2, "Un\n\ndeux"), (3, 1, "three"), (4, None, "old four"), (9, None, "stays")]
    assert now() == sorted(want, key=lambda r: (r[0], r[1] or 0))
    before = files(path)
    run("b")  # all batches again, under the same numbers
    assert now() == sorted(want, key=lambda r: (r[0], r[1] or 0)) and files(path) == before
    save((4, 1, 1, "live", False, "Four", "mended"), (1, 1, 4, "live", False, "One", "<p>fourth</p>"))
    run("b")
    assert now() == [(1, 1, "One\n\nfourth"), (3, 1, "three"), (4, 1, "Four\n\nmended"), (9, None, "stays")]
