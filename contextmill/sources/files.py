"""Source trees and log files."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.globs import DEFAULT_IGNORES, any_glob, walkable
from ..functions.languages import language_of
from ..functions.scalars import relative_path
from ..operators.usage import log_fields

MAX_TAIL = 500


def plain_path(path: Column) -> Column:
    """Path without its file system scheme."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def source_files(spark: SparkSession, root: str, project_path: str, ignores: Iterable[str] = DEFAULT_IGNORES,
                 include_logs: bool = False, linked_children: Iterable[str] = (), max_log_bytes: int | None = None) -> DataFrame:
    """(file, project_path, content, mtime, size) of the files to index under root.

    Skipped directories, ignored paths, linked children and other file types are filtered on the path,
    before any content is read into a later stage. Log files are kept whole unless max_log_bytes cuts them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = raw.withColumn("file", plain_path(F.col("path")))
    relative = relative_path("file", F.lit(root.rstrip("/")))
    keep = (language_of("file", include_logs) != "") & walkable(relative) & ~any_glob(relative, ignores)
    for child in linked_children:
        keep = keep & ~F.startswith("file", F.lit(child.rstrip("/") + "/"))
    logs = language_of("file", True) == "plaintext"
    content = F.col("content")
    if max_log_bytes is not None:
        content = F.when(logs, F.substring("content", 1, max_log_bytes)).otherwise(content)
    return found.where(keep).select(
        "file", F.lit(project_path).alias("project_path"), content.cast("string").alias("content"),
        F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), F.col("length").alias("size"))


def log_tail(spark: SparkSession, path: str, lines: int = 200) -> DataFrame:
    """Last lines of a log, newest first: (level, timestamp, message, raw)."""
    n = min(lines if lines > 0 else 200, MAX_TAIL)
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_id"))
    last = raw.orderBy(F.desc("block"), F.desc("line_id")).limit(n)
    return last.select(log_fields(F.col("value")).alias("f"), "value", "block", "line_id").select(
        "f.level", "f.timestamp", "f.message", F.col("value").alias("raw"))


def discover_projects(roots: Iterable[str], max_depth: int = 2) -> list[str]:
    """Directories holding a '.git' entry, at most max_depth levels below the roots (a shallow listing)."""
    found = set()
    for root in roots:
        base = root.rstrip("/").count("/")
        for directory, names, files in os.walk(root):
            if ".git" in names or ".git" in files:
                found.add(directory)
            depth = directory.count("/") - base
            names[:] = [] if depth >= max_depth else [d for d in names if not d.startswith(".")]
    return sorted(found)
