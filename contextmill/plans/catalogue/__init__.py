"""Registered queries over the test tables, each with its reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Collects queries and their SQL under stable names."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def register(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


def all_queries() -> Catalogue:
    from . import analysis, documents, history, index, search, usage

    merged = Catalogue()
    for module in (search, documents, usage, index, analysis, history):
        merged.queries.update(module.CATALOGUE.queries)
        merged.sql.update(module.CATALOGUE.sql)
    return merged
