"""Parquet tables of one deployment: append logs with derived current views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.filters import purge_parent_duplicates
from ..operators.upkeep import latest_by_key, purge_projects, without
from ..schemas import DDL, PARTITIONS, schema_of
from .generations import Generations, read_paths
from .text_index import TextSegments

# Collections with a text index: their table, what is replaced as a whole, the id and its type, the searched columns.
TEXTS = {
    "code": ("symbols", ("project_path", "file", "version"), "id", "long", ("name", "fqn", "code")),
    "docs": ("doc_content", ("", "source_id", "updated_at"), "chunk_id", "string", ("title", "content")),
}
TABLE_TEXTS = {table: collection for collection, (table, *_) in TEXTS.items()}

# What counts as current in a table that maintenance may shrink: how it is told, its key and its time.
CURRENT_KEYS = {
    "symbols": ("file", ("file",), "version"),
    "edges": ("file", ("source_file",), "version"),
    "indexed_files": ("latest", ("file", "project_path"), "indexed_at"),
    "summaries": ("latest", ("file", "name", "project_path"), "created_at"),
    "doc_content": ("source", ("source_id",), "updated_at"),
    "doc_sources": ("latest", ("id",), "created_at"),
    "context_notes": ("notes", ("ref",), "created_at"),
}
# Tables with rows of files and projects, and their file column.
FILE_COLUMNS = {"symbols": "file", "edges": "source_file", "vectors": "source_file", "indexed_files": "file", "summaries": "file"}
REWRITE_FILES = 32


@dataclass
class Store:
    """Tables under one root folder. Nothing is updated in place: rows are appended, and the current
    state is a view over them. Maintenance rewrites a table into new folders and switches to them at once."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def generations(self, table: str) -> Generations:
        return Generations(self.spark, self.path(table))

    def read(self, table: str) -> DataFrame:
        return read_paths(self.spark, self.generations(table).paths(), schema_of(table))

    def append(self, table: str, rows: DataFrame) -> None:
        self._writer(table, rows, "append").parquet(self.generations(table).append_path())

    def _writer(self, table: str, rows: DataFrame, mode: str):
        schema = schema_of(table)
        have = set(rows.columns)
        typed = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        writer = typed.write.mode(mode)
        return writer.partitionBy(*PARTITIONS[table]) if table in PARTITIONS else writer

    # --- maintenance: rewrites that readers do not notice (see generations) ---

    def rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Puts change(rows) in place of a table's rows; False where a late append came in between."""
        schema = schema_of(table)

        def write(rows: DataFrame, path: str) -> None:
            # one task per partition value and core at most, so that many small files become few
            keys = PARTITIONS.get(table, [])
            self._writer(table, rows.repartition(*keys, F.pmod(F.xxhash64(*rows.columns), F.lit(REWRITE_FILES))) if keys else rows, "error").parquet(path)

        return self.generations(table).rewrite(lambda paths: change(read_paths(self.spark, paths, schema)), write)

    def compact(self, tables: tuple[str, ...] = tuple(CURRENT_KEYS)) -> dict[str, bool]:
        """Rewrites tables to their current rows. The text indexes are brought up to date first, as they need the texts
        of ended versions to take them back."""
        done = {}
        for table in tables:
            if table in TABLE_TEXTS:
                self.refresh_text(TABLE_TEXTS[table])
            done[table] = self.rewrite(table, lambda rows, t=table: self._current(t, rows))
        return done

    def _current(self, table: str, rows: DataFrame) -> DataFrame:
        """What remains of rows: the latest per key, rows that no later version of their file or source ended, notes not deleted."""
        kind, keys, at = CURRENT_KEYS[table]
        if kind == "latest":
            return latest_by_key(rows, list(keys), [at])
        if kind == "file":
            # rows are written before the manifest that makes them current: only what a later version ended goes
            live = self.files().select("project_path", F.col("file").alias(keys[0]), F.col("indexed_at").alias("__live"))
            known = rows.join(live, ["project_path", *keys], "left")
            return known.where(F.col("__live").isNull() | (F.col("version") >= F.col("__live"))).drop("__live")
        return self.doc_content(rows) if kind == "source" else without(rows, self.read("note_tombstones"), list(keys))

    def purge(self, project_paths: list[str]) -> dict[str, bool]:
        """Removes every row of projects."""
        self._drop_text(self.symbols().where(F.col("project_path").isin(*project_paths)))
        return {t: self.rewrite(t, lambda rows: purge_projects(rows, project_paths)) for t in FILE_COLUMNS}

    def purge_links(self, links: DataFrame) -> dict[str, bool]:
        """Removes rows that a parent keeps for files of a linked child (parent_path, child_path)."""
        links = links.select("parent_path", "child_path")
        kept = purge_parent_duplicates(self.symbols().select("project_path", "file", "id"), links)
        self._drop_text(self.symbols().join(kept.select("id"), "id", "left_anti"))
        return {t: self.rewrite(t, lambda rows, c=column: purge_parent_duplicates(rows, links, c)) for t, column in FILE_COLUMNS.items()}

    def _drop_text(self, symbols: DataFrame) -> None:
        self.refresh_text("code")
        self.text("code").apply(None, self._as_documents("code", symbols))

    def expire(self, table: str, keep: Column) -> bool:
        """Rewrites a log to the rows that meet keep (null counts as kept)."""
        return self.rewrite(table, lambda rows: rows.where(F.coalesce(keep, F.lit(True))))

    def vacuum(self) -> None:
        """Deletes what rewrites left behind; run it when no reader of an older state is left."""
        for table in DDL:
            self.generations(table).vacuum()
        for collection in TEXTS:
            self.text(collection).vacuum()

    # --- current views ---

    def files(self) -> DataFrame:
        return latest_by_key(self.read("indexed_files"), ["file", "project_path"], ["indexed_at"])

    def _of_current_files(self, table: str, file: str) -> DataFrame:
        """Rows written by the latest indexing of their file; a deleted file has no live version."""
        live = self.files().select("project_path", F.col("file").alias(file), F.col("indexed_at").alias("version"))
        return self.read(table).join(live, ["project_path", file, "version"], "left_semi")

    def symbols(self) -> DataFrame:
        return self._of_current_files("symbols", "file")

    def edges(self) -> DataFrame:
        return self._of_current_files("edges", "source_file")

    def summaries(self) -> DataFrame:
        return latest_by_key(self.read("summaries"), ["file", "name", "project_path"], ["created_at"])

    def notes(self) -> DataFrame:
        counts = self.read("context_note_access").groupBy("ref").agg(F.count("*").alias("access_count"), F.max("accessed_at").alias("last_accessed_at"))
        live = without(self.read("context_notes"), self.read("note_tombstones"), ["ref"])
        return live.join(counts, "ref", "left").na.fill(0, ["access_count"])

    def doc_sources(self) -> DataFrame:
        """Listed sources; a version without url removes a source."""
        return latest_by_key(self.read("doc_sources"), ["id"], ["created_at"]).where("url <> ''")

    def doc_content(self, rows: DataFrame | None = None) -> DataFrame:
        """Chunks of the latest fetch of every listed source."""
        rows = self.read("doc_content") if rows is None else rows
        newest = rows.groupBy("source_id").agg(F.max("updated_at").alias("updated_at"))
        newest = newest.join(self.doc_sources().select(F.col("id").alias("source_id")), "source_id", "left_semi")
        return rows.join(newest, ["source_id", "updated_at"], "left_semi")

    def settings(self) -> DataFrame:
        return latest_by_key(self.read("settings"), ["key"], ["updated_at"])

    # --- text index ---

    def text(self, collection: str) -> TextSegments:
        return TextSegments(self.spark, f"{self.root}/text/{collection}", TEXTS[collection][3])

    def _as_documents(self, collection: str, rows: DataFrame) -> DataFrame:
        _, (scope, unit, version), key, _, fields = TEXTS[collection]
        return rows.select((F.col(scope) if scope else F.lit("")).alias("scope"), F.col(unit).alias("unit"), F.col(version).alias("version"),
                           F.col(key).alias("doc"), F.concat_ws(" ", *fields).alias("text"))

    def refresh_text(self, collection: str, touched: DataFrame | None = None) -> None:
        """Brings the index in step with the table: current versions it lacks are added, versions it holds that are no longer
        current are ended. touched (scope, unit) limits the comparison to what a batch wrote; without it everything is
        compared, which repairs an index after a lost batch and builds one from nothing."""
        index = self.text(collection)
        held = index.units()
        every = self._as_documents(collection, self.read(TEXTS[collection][0]))
        current = self._as_documents(collection, self.symbols() if collection == "code" else self.doc_content())
        if touched is not None:
            keys = touched.select("scope", "unit").distinct()
            held, every, current = (df.join(keys, ["scope", "unit"], "left_semi") for df in (held, every, current))
        versions = ["scope", "unit", "version"]
        ended = held.join(current.select(*versions), versions, "left_anti")
        index.apply(current, every.join(ended, versions, "left_semi"))

    # --- bundles ---

    def export_bundle(self, project_path: str, target: str) -> None:
        """Current tables of one project as Parquet folders."""
        for name, rows in (("symbols", self.symbols()), ("edges", self.edges()), ("summaries", self.summaries()),
                           ("vectors", self.read("vectors")), ("indexed_files", self.files())):
            rows.where(F.col("project_path") == project_path).write.mode("overwrite").parquet(f"{target}/{name}")

    def import_bundle(self, source: str) -> None:
        for name in ("symbols", "edges", "summaries", "vectors", "indexed_files"):
            self.append(name, self.spark.read.schema(schema_of(name)).parquet(f"{source}/{name}"))
        self.refresh_text("code")
