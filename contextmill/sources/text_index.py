"""A text index kept as segments: every batch adds one, a commit makes it visible, compaction replaces many by one.

A unit is what is indexed as a whole (a file, a document source, a note); a batch brings new versions of units and says which
versions no longer count. Nothing is changed in place. A segment holds blocks of postings, the versions it ends, and deltas
of document counts; readers see exactly the segments of the commits they found, so a batch is visible whole or not at all,
and one that failed half-way leaves files nobody reads. One writer per index at a time; compaction may run beside it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import posting_blocks as pb
from ..session import MAX_PINNED_ROWS

#: Named by the form of the segments: an index of an older form counts as none, and Store.refresh_text builds it again.
LOG = "commits-2"
COMMITS = "id string, replaces array<string>, at timestamp_ntz"


@dataclass
class TextSegments:
    """The index under one folder; documents have ids of doc_type."""

    spark: SparkSession
    root: str
    doc_type: str = "long"
    home_docs: int = pb.HOME_DOCS
    block_rows: int = pb.BLOCK_ROWS

    @property
    def _schemas(self) -> dict[str, str]:
        return {"blocks": pb.blocks_ddl(self.doc_type), "dead": pb.UNIT_TYPES, "ended": pb.ENDED, "sizes": pb.SIZES, "units": pb.UNIT_TYPES}

    def segments(self) -> list[str]:
        """Ids in force: committed and not replaced. As many as batches since the last compaction."""
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.root}/{LOG}").orderBy("at", "id").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        gone = {i for r in rows for i in r["replaces"]}
        return [r["id"] for r in rows if r["id"] not in gone]

    def _read(self, part: str, ids: list[str]) -> DataFrame:
        schema = f"{self._schemas[part]}, segment string"
        if not ids:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{part}/segment={i}" for i in ids]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{part}").parquet(*paths)

    def snapshot(self, ids: list[str] | None = None) -> pb.Corpus:
        """The index as of now; later batches and compactions do not change it."""
        ids = self.segments() if ids is None else ids
        blocks, dead, ended, sizes = (self._read(part, ids) for part in ("blocks", "dead", "ended", "sizes"))
        return pb.Corpus(blocks, dead.drop("segment"), ended.drop("segment"), sizes.drop("segment"))

    def units(self, ids: list[str] | None = None) -> DataFrame:
        """(scope, unit, version): what the index holds."""
        ids = self.segments() if ids is None else ids
        held, dead = (self._read(part, ids).drop("segment") for part in ("units", "dead"))
        return held.join(dead, pb.VERSION, "left_anti").distinct()

    def _none(self, part: str) -> DataFrame:
        return self.spark.createDataFrame([], self._schemas[part])

    def _write(self, segment: str, part: str, rows: DataFrame) -> None:
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self._schemas[part]).schema])
        typed.write.parquet(f"{self.root}/{part}/segment={segment}")

    def _commit(self, segment: str, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(segment, replaces)], "id string, replaces array<string>")
        row.withColumn("at", F.current_timestamp().cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{self.root}/{LOG}")

    def apply(self, added: DataFrame | None, removed: DataFrame | None = None) -> str:
        """Indexes documents (scope, unit, version, doc, text) and ends versions: removed has the documents they hold,
        with their texts, so that their counts can be taken back. Versions already held are not added again, and only
        versions held are taken back, so a batch may be repeated. Returns the segment's id."""
        segment, ids = uuid.uuid4().hex, self.segments()
        held = self.units(ids)
        if added is not None and ids:
            added = _without(added, held, "left_semi")
        if removed is not None:
            removed = _without(removed.dropna(subset=pb.VERSION), held, "left_anti") if ids else None
        # a home's rows come out together and sorted by term, so a prefix reads few pages
        self._write(segment, "blocks", self._none("blocks") if added is None else pb.make_blocks(added, self.home_docs, self.block_rows))
        self._write(segment, "dead", self._none("dead") if removed is None else removed.select(*pb.VERSION).distinct())
        self._write(segment, "ended", self._none("ended") if removed is None else pb.ended_counts(removed, self.home_docs))
        blocks, ended = (self._read(part, [segment]) for part in ("blocks", "ended"))
        self._write(segment, "sizes", pb.size_deltas(blocks, ended).coalesce(1))
        self._write(segment, "units", pb.documents(blocks).select(*pb.VERSION).distinct())
        self._commit(segment, [])
        return segment

    def compact(self) -> str | None:
        """Rewrites the segments in force as one, without what no longer counts. Readers keep the files they started with
        until vacuum(); batches committed meanwhile stay beside the new segment."""
        ids = self.segments()
        if len(ids) < 2:
            return None
        now, segment = self.snapshot(ids), uuid.uuid4().hex
        sizes = now.sizes.groupBy("scope").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
        total = sizes.agg(F.sum("n").alias("n"), F.sum("total").alias("t")).first()
        n = total["n"] or 0
        # what ended is not among the postings, so nothing is to be taken back
        self._write(segment, "dead", self._none("dead"))
        self._write(segment, "ended", self._none("ended"))
        self._write(segment, "units", self.units(ids))
        self._write(segment, "sizes", sizes.coalesce(1))
        self._write(segment, "blocks", pb.remade_blocks(pb.live_postings(now), n, total["t"] or 0, self.home_docs, self.block_rows))
        self._commit(segment, ids)
        return segment

    def vacuum(self) -> list[str]:
        """Deletes the files of replaced segments; run it when no reader of an older snapshot is left. Commits stay."""
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.root}/{LOG}").collect() if self.segments() else []
        gone = sorted({i for r in rows for i in r["replaces"]})
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for part in self._schemas:
            for i in gone:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}/segment={i}")
                path.getFileSystem(conf).delete(path, True)
        return gone

    def search(self, requests: DataFrame, limit: int, scopes: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) over the current snapshot."""
        return pb.BlockSearch(self.snapshot().within(scopes), requests, limit, allowed).hits()


def _without(rows: DataFrame, held: DataFrame, how: str) -> DataFrame:
    """rows without those of their versions that join held in this way. The versions are found first, by their names alone, so
    that texts are not shuffled to meet them unless there are many."""
    versions = rows.select(*pb.VERSION).distinct().join(held, pb.VERSION, how)
    found = versions.limit(MAX_PINNED_ROWS + 1).toArrow()
    if found.num_rows == 0:
        return rows
    few = found.num_rows <= MAX_PINNED_ROWS
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, versions.schema)) if few else versions, pb.VERSION, "left_anti")
