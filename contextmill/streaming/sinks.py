"""Micro-batched writes: call log, session log, index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.symbols import extract_imports, extract_symbols
from ..operators.upkeep import missing_vectors
from ..sources.embedders import Embedder, embed_symbols
from ..sources.store import Store

LOG_INTERVAL, SESSION_INTERVAL = "4 seconds", "3 seconds"


def append_sink(rows: DataFrame, store: Store, table: str, checkpoint: str, interval: str = LOG_INTERVAL) -> DataStreamWriter:
    """Appends every micro-batch to a table of the store."""
    return (rows.writeStream.foreachBatch(lambda batch, _: store.append(table, batch))
            .option("checkpointLocation", checkpoint).trigger(processingTime=interval))


def index_batch(store: Store, files: DataFrame, now: Column, include_logs: bool = False) -> None:
    """Indexes one batch of files (file, project_path, content): symbols, edges, manifest, postings.

    All rows carry the batch's version, and the manifest is written last, so readers switch to the new
    rows of a file at once and a retried batch leaves at most rows that no manifest row points to.
    """
    files = files.persist()
    ident = F.xxhash64("project_path", "file", "name", "kind", "start_line")
    store.append("symbols", extract_symbols(files, include_logs).withColumn("id", ident).withColumn("version", now))
    store.append("edges", extract_imports(files).withColumn("version", now))
    store.append("indexed_files", files.select("file", "project_path", now.alias("indexed_at")))
    store.refresh_text("code", files.select(F.col("project_path").alias("scope"), F.col("file").alias("unit")))
    files.unpersist()


def index_stream(files: DataFrame, store: Store, checkpoint: str, interval: str = LOG_INTERVAL) -> DataStreamWriter:
    def write(batch: DataFrame, _: int) -> None:
        now = batch.sparkSession.sql("SELECT current_timestamp()::timestamp_ntz AS now").first()["now"]
        index_batch(store, batch.select("file", "project_path", "content"), F.lit(now).cast("timestamp_ntz"))

    return writer_of(files, write, checkpoint, interval)


def writer_of(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, interval: str) -> DataStreamWriter:
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def embed_backlog(store: Store, make: Callable[[], Embedder], files: int | None = None) -> None:
    """Embeds symbols of files without a current vector; recomputed each time, so a lost run is repeated.

    `files` bounds one pass by priority (path order); the rest is found missing by the next pass.
    """
    symbols = store.symbols()
    todo = missing_vectors(symbols, store.read("vectors"))
    if files is not None:
        todo = todo.orderBy("project_path", "file").limit(files)
    pending = symbols.join(todo, ["file", "project_path"], "left_semi")
    store.append("vectors", embed_symbols(pending, make))


def split_late(rows: DataFrame, ts: str, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch; late ones go to a side table instead of being lost."""
    late = F.col(ts) < watermark
    return rows.where(~late), rows.where(late)
