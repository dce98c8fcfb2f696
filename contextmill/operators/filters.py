"""Search filters and project scopes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.languages import filter_suffixes
from ..functions.scalars import ancestors


@dataclass(frozen=True)
class SearchFilters:
    """Path prefix, kinds and language; empty fields do not filter."""

    path_prefix: str = ""
    kinds: tuple[str, ...] = field(default_factory=tuple)
    language: str = ""

    @classmethod
    def parse(cls, args: dict[str, Any]) -> "SearchFilters | None":
        """From request arguments: kinds as list or comma-separated text, joined with kind."""
        raw = args.get("kinds") or []
        parts = raw.split(",") if isinstance(raw, str) else [k for k in raw if isinstance(k, str)]
        if isinstance(args.get("kind"), str):
            parts = [*parts, args["kind"]]
        kinds = tuple(dict.fromkeys(k.strip() for k in parts if k.strip()))
        found = cls(str(args.get("path_prefix") or "").strip(), kinds,
                    str(args.get("language") or "").strip().lower())
        return None if found == cls() else found

    def predicate(self, root: str, file: str = "file", kind: str = "kind") -> Column:
        """One predicate for every leg of a search. A path prefix is exact-or-under; an unknown
        language admits nothing."""
        test = F.lit(True)
        if self.kinds:
            test = test & F.col(kind).isin(*self.kinds)
        if self.language:
            suffixes = filter_suffixes(self.language)
            any_suffix = F.lit(False)
            for s in suffixes:
                any_suffix = any_suffix | F.endswith(F.lower(file), F.lit(s))
            test = test & any_suffix
        if self.path_prefix:
            prefix = self.path_prefix.removeprefix("./")
            target = prefix if prefix.startswith("/") else f"{root}/{prefix.strip('/')}"
            target = target.rstrip("/")
            test = test & ((F.col(file) == target) | F.startswith(F.col(file), F.lit(target + "/")))
        return test


def scope_paths(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, project_path): every root with itself and its linked children (one level)."""
    own = roots.select("root", F.col("root").alias("project_path"))
    linked = roots.join(links, roots["root"] == links["parent_path"]).select(
        "root", F.col("child_path").alias("project_path"))
    return own.unionByName(linked).distinct()


def in_scope(rows: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """Rows of one root project and its linked children. The children of one project are few and are looked
    up first: as literals they prune the partitions of the scan, so other projects are not read."""
    return rows.where(F.col("project_path").isin(*scope_names(links, root)))


def scope_names(links: DataFrame, root: str) -> list[str]:
    """A project and its linked children."""
    children = links.where(F.col("parent_path") == root).select("child_path").distinct().collect()
    return [root, *(r["child_path"] for r in children)]


def auto_links(projects: DataFrame) -> DataFrame:
    """(parent_path, child_path) for indexed projects that lie strictly below another one.

    Every path is expanded to its ancestors, so the prefix test becomes an equi-join.
    """
    paths = (projects.select("project_path")
             .where(F.col("project_path").isNotNull() & ~F.col("project_path").isin("", ".")).distinct())
    up = paths.select(F.col("project_path").alias("child_path"),
                      F.explode(ancestors("project_path")).alias("parent_path"))
    return up.join(paths.select(F.col("project_path").alias("parent_path")), "parent_path", "left_semi").select(
        "parent_path", "child_path")


def owning_project(files: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """Adds owner: the longest linked child of root that contains the file, else root."""
    children = links.where(F.col("parent_path") == root).select(F.col("child_path").alias("__at")).distinct()
    distinct_files = files.select("file").distinct()
    places = distinct_files.select("file", F.explode(F.concat(ancestors("file"), F.array("file"))).alias("__at"))
    owners = (places.join(children, "__at").groupBy("file")
              .agg(F.max_by("__at", F.length("__at")).alias("__owner")))
    return (files.join(owners, "file", "left")
            .withColumn("owner", F.coalesce("__owner", F.lit(root))).drop("__owner"))


def link_is_valid(parent: Column, child: Column, parent_is_linked: Column) -> Column:
    """A link needs a strict sub-path and a parent that is not itself linked under a container."""
    return (parent != "") & F.startswith(child, F.concat(parent, F.lit("/"))) & ~parent_is_linked


def purge_parent_duplicates(rows: DataFrame, links: DataFrame, file: str = "file") -> DataFrame:
    """Drops rows kept under a parent project for files that a linked child owns."""
    places = rows.select("project_path", file).distinct().select(
        "project_path", file, F.explode(F.concat(ancestors(file), F.array(file))).alias("child_path"))
    doubled = places.join(links.withColumnRenamed("parent_path", "project_path"),
                          ["project_path", "child_path"], "left_semi").select("project_path", file).distinct()
    return rows.join(doubled, ["project_path", file], "left_anti")
