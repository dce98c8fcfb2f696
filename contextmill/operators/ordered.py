"""Ordered computations over groups of any size.

A plain window puts a whole group into one task. Here the order axis is first cut into buckets of
about equal row counts, so that a group holding a third of the data is spread over many tasks:
running totals and neighbours are computed inside (group, bucket) and stitched together with a
summary that has one row per (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_BUCKETS = 512
_B = "__bucket"


def split_points(df: DataFrame, axis: Column, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of a numeric axis: at most MAX_BUCKETS - 1 numbers reach the driver.

    Any set of points gives the same final result; they only balance the work.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = max(2, min(n, MAX_BUCKETS))
    quantiles = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(axis.cast("double"), quantiles, 10 * n).alias("p")).first()
    return sorted(set(found["p"] or []))


def bucket_of(axis: Column, points: Sequence[float]) -> Column:
    """Bucket number of a value by binary decisions over the split points (monotone in the value)."""
    value = axis.cast("double")

    def choose(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(points[middle]), choose(low, middle)).otherwise(choose(middle + 1, high))

    return choose(0, len(points)) if points else F.lit(0)


def _group(by: Sequence[str]) -> list:
    return [F.col(c) for c in by] or [F.lit(0)]


def running_sum(df: DataFrame, by: Sequence[str], axis: Column, order: Sequence[Column],
                value: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Inclusive running total of value per group in the given order.

    axis must be a non-null number that never decreases along the order. The grouping columns must
    not be null.
    """
    points = split_points(df, axis, buckets)
    placed = df.withColumn("__v", value).withColumn(_B, bucket_of(axis, points))
    totals = placed.groupBy(*by, _B).agg(F.sum("__v").alias("__total"))
    before = (Window.partitionBy(*_group(by)).orderBy(_B)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*by, _B, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__off"))
    inside = (Window.partitionBy(*by, _B).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (placed.join(offsets, [*by, _B])
            .withColumn(out, F.col("__off") + F.sum("__v").over(inside))
            .drop("__v", "__off", _B))


def neighbour(df: DataFrame, by: Sequence[str], axis: Column, order: Sequence[str],
              take: Sequence[str], out: str, following: bool = True,
              buckets: int | None = None) -> DataFrame:
    """Adds a struct of the next (or previous) row of the same group in ascending order; null at the end."""
    points = split_points(df, axis, buckets)
    placed = df.withColumn(_B, bucket_of(axis, points))
    row, key = F.struct(*take), F.struct(*order)
    edge = (F.min_by if following else F.max_by)(row, key)
    edges = placed.groupBy(*by, _B).agg(edge.alias("__edge"))
    across = Window.partitionBy(*_group(by)).orderBy(_B)
    shift = F.lead if following else F.lag
    edges = edges.select(*by, _B, shift("__edge", 1).over(across).alias("__edge"))
    inside = Window.partitionBy(*by, _B).orderBy(*order)
    return (placed.join(edges, [*by, _B])
            .withColumn(out, F.coalesce(shift(row, 1).over(inside), F.col("__edge")))
            .drop("__edge", _B))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """Best k rows per group. Spark cuts every input partition to k rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per group by ascending order columns, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*by, "__row.*").select(*df.columns)


def as_of(probes: DataFrame, versions: DataFrame, by: Sequence[str], at: Column, since: Column,
          take: Sequence[str], out: str, buckets: int | None = None) -> DataFrame:
    """Adds to every probe a struct of the last version of its group with since <= at, null if none.

    at and since are numbers. Probes and versions are merged on the time axis, so the work is linear
    even where one group holds most of both; among versions of one instant the largest row wins.
    """
    p = probes.select(F.struct("*").alias("__p"), *by, at.alias("__t"), F.lit(None).alias("__v"))
    v = versions.select(F.lit(None).alias("__p"), *by, since.alias("__t"), F.struct(*take).alias("__v"))
    points = split_points(v, F.col("__t"), buckets)
    both = p.select("__p", *by, "__t", F.lit(None).cast(v.schema["__v"].dataType).alias("__v")).unionByName(
        v.select(F.lit(None).cast(p.schema["__p"].dataType).alias("__p"), *by, "__t", "__v"))
    placed = both.withColumn(_B, bucket_of(F.col("__t"), points))
    last = placed.where("__v IS NOT NULL").groupBy(*by, _B).agg(F.max(F.struct("__t", "__v")).alias("__last"))
    every = placed.select(*by, _B).distinct().join(last, [*by, _B], "left")
    before = Window.partitionBy(*_group(by)).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*by, _B, F.last("__last", ignorenulls=True).over(before)["__v"].alias("__carry"))
    # versions sort before probes of the same instant
    inside = (Window.partitionBy(*by, _B).orderBy("__t", F.col("__p").isNotNull(), "__v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = (placed.join(carried, [*by, _B])
              .withColumn(out, F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col("__carry"))))
    return filled.where("__p IS NOT NULL").select("__p.*", out)
