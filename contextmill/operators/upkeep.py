"""Keeping derived tables in step: missing and orphan vectors, catch-up, upserts, tombstones, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import micros
from .ordered import running_sum


def missing_vectors(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """(file, project_path) with a symbol whose text has no current code vector. A vector belongs to
    the content hash; symbols without a hash need any vector of their own."""
    code = vectors.where(F.coalesce("doc_type", F.lit("code")) == "code")
    hashed = symbols.where(F.coalesce("embed_hash", F.lit("")) != "")
    stale = hashed.join(code.select("project_path", F.col("content_hash").alias("embed_hash")).distinct(),
                        ["project_path", "embed_hash"], "left_anti")
    unhashed = symbols.where(F.coalesce("embed_hash", F.lit("")) == "")
    bare = unhashed.join(code.select("project_path", F.col("symbol_id").alias("id")), ["project_path", "id"], "left_anti")
    keys = ["file", "project_path"]
    return stale.select(*keys).union(bare.select(*keys)).distinct()


def orphan_vectors(vectors: DataFrame, symbols: DataFrame) -> DataFrame:
    return vectors.join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti")


def stale_pending(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pending entries whose file has no symbol any more."""
    return pending.join(symbols.select("file", "project_path"), ["file", "project_path"], "left_anti")


def catch_up(on_disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """(file, status): new, modified, deleted or unchanged. on_disk: file, mtime. indexed: file, indexed_at."""
    both = on_disk.select("file", "mtime").join(indexed.select("file", "indexed_at"), "file", "full")
    status = (F.when(F.col("indexed_at").isNull(), "new").when(F.col("mtime").isNull(), "deleted")
              .when(F.col("mtime") > F.col("indexed_at"), "modified").otherwise("unchanged"))
    return both.select("file", status.alias("status"))


def latest_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows of an append log: the last version per key, as a map-side combined aggregate."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*keys, "r.*").select(*log.columns)


def without(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not deleted by a tombstone."""
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def bump(counter: Column, delta: Column) -> Column:
    """Counter update that never falls below zero."""
    return F.greatest(F.lit(0), counter + delta)


def purge_projects(rows: DataFrame, projects: list[str]) -> DataFrame:
    """What remains of a table after whole projects are removed (a pruned scan when partitioned)."""
    return rows.where(~F.col("project_path").isin(*projects) | F.col("project_path").isNull())


def expired(log: DataFrame, now: Column, max_age_days: int = 90) -> Column:
    """Row is older than the first day kept."""
    return F.col("timestamp") < F.date_trunc("day", now - F.make_dt_interval(F.lit(max_age_days)))


def retention(files: DataFrame, now: Column, max_age_days: int = 0, max_total: int = 0) -> DataFrame:
    """Adds `drop`: older than the age, or among the oldest survivors until the rest fits max_total.

    files: path, size, mtime. The size rule is a running total over all survivors by age, cut over many
    tasks; the last file dropped is the first whose removal brings the total under the cap.
    """
    old = F.col("mtime") < now - F.make_dt_interval(F.lit(max_age_days)) if max_age_days > 0 else F.lit(False)
    aged = files.withColumn("drop", old)
    if max_total <= 0:
        return aged
    survivors = aged.where(~F.col("drop"))
    total = survivors.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).scalar()
    cum = running_sum(survivors, [], micros("mtime"), [F.col("mtime"), F.col("path")], F.col("size"), "freed")
    sized = cum.withColumn("drop", F.col("freed") - F.col("size") < total - max_total).select(*aged.columns)
    return aged.where("drop").unionByName(sized)
