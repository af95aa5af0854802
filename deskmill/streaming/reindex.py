"""Keeping the chunk table up to date by a stream of saved sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions.tables import stored, table_if_any
from deskmill.functions.text import normalize_text
from deskmill.operators.chunking import chunk_text
from deskmill.operators.embed import Embedder, embed_chunks
from deskmill.operators.index import contextualize
from deskmill.sources.chunks import SOURCE, replace_chunks

_LEDGER = "source_type string, source_id long, version long"


def reindex(changes: DataFrame, path: str, embedder: Callable[[], Embedder], text: Callable[[Column], Column] = normalize_text, size: int = 1200, overlap: int = 150) -> None:
    """Bring the table at ``path`` to the last saved version of every source in ``changes``.

    ``changes`` are (source_type, source_id, site_id, version, status, draft, title, html), a row per site of a version.  Drafts
    are no versions; a version that is in the table, or an older one, is left alone, so repeated and late batches change
    nothing.  Sources that are not live lose their chunks.  A source of which a chunk got no vector keeps its old chunks, and
    its version stays open for a later try.
    """
    c = changes.where(~F.coalesce("draft", F.lit(False)) & F.col("version").isNotNull() & F.col("source_id").isNotNull())
    last = c.groupBy(*SOURCE).agg(F.max("version").alias("version"))
    ledger = table_if_any(c.sparkSession, f"{path}/_ledger", _LEDGER)
    if ledger is not None:
        done = ledger.groupBy(*SOURCE).agg(F.max("version").alias("done"))
        last = last.join(done, list(SOURCE), "left").where("done IS NULL OR version > done").drop("done")
    c = stored(c.join(last, [*SOURCE, "version"]), "changes")
    live = c.where("status = 'live'").select(*SOURCE, "site_id", "title", text(F.col("html")).alias("text")).where("trim(text) <> ''")
    chunks = contextualize(chunk_text(live, size=size, overlap=overlap))
    chunks = stored(embed_chunks(chunks.select(*SOURCE, "site_id", "position", "content"), embedder), "new-chunks")
    failed = chunks.where("embedding IS NULL").select(*SOURCE).distinct()
    touched = c.select(*SOURCE, "version").distinct().join(failed, list(SOURCE), "left_anti")
    replace_chunks(chunks, touched, path)
    # Last, so that a batch that fails before is done again; entries of a repeated batch are the same.
    touched.select(*SOURCE, "version").write.mode("append").parquet(f"{path}/_ledger")


def stream_reindex(changes: DataFrame, path: str, checkpoint_path: str, embedder: Callable[[], Embedder], **options):
    """Run ``reindex`` over all there is of a stream of changes."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        reindex(batch, path, embedder, **options)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
