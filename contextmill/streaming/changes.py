"""File changes, debounce, session dedup, throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.changes import is_removal
from ..sources.files import plain_path

WATERMARK = "1 hour"
DEBOUNCE = "500 milliseconds"


def file_stream(spark: SparkSession, root: str, project_path: str, max_files: int = 1000) -> DataFrame:
    """(file, project_path, content, mtime) of files as they appear or are rewritten. The file source
    never reports deletions: run upkeep.catch_up on a schedule beside it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = (spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", max_files).load(root))
    return raw.select(plain_path(F.col("path")).alias("file"), F.lit(project_path).alias("project_path"),
                      F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"))


def debounced(events: DataFrame, by: str = "path", ts: str = "ts", gap: str = DEBOUNCE, watermark: str = WATERMARK) -> DataFrame:
    """One row per burst of events on a path: its last event. Renamed paths are removals."""
    bursts = events.withWatermark(ts, watermark).groupBy(F.col(by), F.session_window(ts, gap).alias("burst"))
    last = bursts.agg(F.max_by("event", ts).alias("event"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))
    return last.select(by, "event", is_removal(F.col("event")).alias("removed"), "last_ts", "events")


def first_returns(returned: DataFrame, ts: str = "returned_at", watermark: str = WATERMARK) -> DataFrame:
    """Rows a session has not been sent before, with state bounded by the watermark."""
    return returned.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["session_id", "file", "name", "start_line"])


def throughput(events: DataFrame, ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    windows = events.withWatermark(ts, watermark).groupBy(F.window(ts, "5 seconds", "500 milliseconds").alias("w"))
    return windows.agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), "events", (F.col("events") / 5.0).alias("per_second"))


def idle_sessions(events: DataFrame, by: str, ts: str, gap, watermark: str = WATERMARK) -> DataFrame:
    """Sessions separated by an idle gap, which may be an expression (pinned projects wait longer)."""
    s = events.withWatermark(ts, watermark).groupBy(F.col(by), F.session_window(ts, gap).alias("s"))
    return s.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events")).drop("s")
