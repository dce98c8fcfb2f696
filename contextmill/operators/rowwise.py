"""Row-local helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row. Spark does not hoist an expression out of an array
    lambda, so whatever a lambda looks at should be a real column, not an expression."""
    once = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", once.alias("__once")).select(*df.columns, *[F.col("__once")[n].alias(n) for n in columns])
