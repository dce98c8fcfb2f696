"""Append logs that can be rewritten while others read them.

A table is a list of folders: the one it began with, and those that commits added and did not replace. A rewrite first opens a
new folder for appends, then writes what remains of the older ones to another, and puts that in their place with one commit.
Readers list the folders once and keep what they found; the files of replaced folders stay until vacuum().

Appends go to the folder that was open when they began. One that is still writing to an older folder is noticed before the
commit: the rewrite gives up and leaves the table as it was. One rewrite per table at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

COMMITS = "name string, opens boolean, replaces array<string>, at timestamp_ntz"
Write = Callable[[DataFrame, str], None]


@dataclass
class Generations:
    """The folders of one table. They lie beside it, so that all of them have the same partition columns."""

    spark: SparkSession
    path: str

    def _path(self, folder: str) -> str:
        return f"{self.path}.{folder}" if folder else self.path

    def _hadoop(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        place, fs = self._hadoop(path)
        return fs.exists(place)

    def _commits(self) -> list:
        """As many rows as rewrites, two each; no job for a table that was never rewritten."""
        log = self._path("commits")
        return self.spark.read.schema(COMMITS).parquet(log).orderBy("at", "name").collect() if self._exists(log) else []

    def _commit(self, name: str, opens: bool, replaces: Iterable[str]) -> None:
        row = self.spark.createDataFrame([(name, opens, list(replaces))], "name string, opens boolean, replaces array<string>")
        row.withColumn("at", F.current_timestamp().cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(self._path("commits"))

    def _in_force(self) -> tuple[list[str], str]:
        """Folders that count, in order, and the one open for appends."""
        rows = self._commits()
        gone = {f for r in rows for f in r["replaces"]}
        opened = [r["name"] for r in rows if r["opens"]]
        return [f for f in ["", *(r["name"] for r in rows)] if f not in gone], opened[-1] if opened else ""

    def paths(self) -> list[str]:
        """Folders to read: those in force that have been written to."""
        return [p for p in map(self._path, self._in_force()[0]) if self._exists(p)]

    def append_path(self) -> str:
        return self._path(self._in_force()[1])

    def _files(self, folders: list[str]) -> set[str]:
        found = set()
        for path in filter(self._exists, map(self._path, folders)):
            place, fs = self._hadoop(path)
            listing = fs.listFiles(place, True)
            while listing.hasNext():
                found.add(listing.next().getPath().toString())
        return found

    def rewrite(self, change: Callable[[list[str]], DataFrame], write: Write) -> bool:
        """Puts the rows of change(folders) in place of those the folders hold; what is appended meanwhile stays beside them.
        False, and nothing changed, where an append that began earlier came in between."""
        opened, closed = uuid.uuid4().hex, self._in_force()[0]
        self._commit(opened, True, [])
        before = self._files(closed)
        name = uuid.uuid4().hex
        write(change([p for p in map(self._path, closed) if self._exists(p)]), self._path(name))
        if self._files(closed) != before:
            return False
        self._commit(name, False, closed)
        return True

    def vacuum(self) -> list[str]:
        """Deletes replaced folders; run it when no reader of an older state is left."""
        gone = sorted({f for r in self._commits() for f in r["replaces"]})
        for folder in gone:
            place, fs = self._hadoop(self._path(folder))
            fs.delete(place, True)
        return gone


def read_paths(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Rows of all folders, of which there are two or three: each is a partitioned table of its own. A folder that a
    vacuum took away meanwhile is an error, not an empty table."""
    reads = [spark.read.schema(schema).parquet(p).select(*schema.names) for p in paths]
    return reduce(DataFrame.unionByName, reads) if reads else spark.createDataFrame([], schema)
