"""Centroid clustering with Ptolemaic pivots.

In Euclidean space four points obey Ptolemy's inequality, so for two pivots p and s

    d(x, c) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)| / d(p, s).

The pivots are fixed; each vector's distances to them are computed once and kept in a written table beside the vector. In a
round the few centroids get their distances to the pivots, each vector gets the best bound over all pairs of pivots for
every centroid and is compared exactly with the centroid of the least bound; others are compared exactly only where their
bound does not exceed that distance. Square roots are floating point, so bounds are lowered by more than their rounding
error; distances themselves are whole numbers, and ties go to the smaller number of a centroid.

Each task adds up its vectors per cluster and sends those sums in limbs of 30 bits, so totals are exact whatever their size;
per round the driver sees the totals of k clusters and sends back k centroids. Vectors stay where they are.

Components beyond SMALL in size take Python's whole numbers and are compared with every centroid. A distance that does not
fit a long is null, and so is an inertia that holds one or does not fit itself.

Left out: null vectors, vectors of another size, and such with null or non-finite components. Null ids count as empty text,
repeated rows are all clustered, vectors of equal hash are ordered by their components, fewer vectors than k give as many
centroids, an empty table gives an empty result, other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.catalogue import Catalogue
from .common import table, written

CATALOGUE = Catalogue()
DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
PIVOTS = 5
SMALL = 1 << 26
LIMB = 30
LARGEST = (1 << 63) - 1
#: More than the relative rounding error of a bound's square roots, products and quotient.
SLACK = 2.0**-46

Centroids = list[list[int]]


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is beyond floating point."""
    return math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    x = F.col("x")
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))


def _hash(tag: str) -> Column:
    return F.sha2(F.concat(F.lit(tag + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def first_by_hash(usable: DataFrame, tag: str, n: int, scale: int) -> Centroids:
    """The n vectors of least hash of `tag:id`: n rows reach the driver."""
    return [[whole(c, scale) for c in r["x"]] for r in usable.orderBy(_hash(tag), "x").limit(n).select("x").collect()]


def _small(points: Centroids) -> bool:
    return all(abs(c) <= SMALL for p in points for c in p)


def _matrix(points: Centroids) -> np.ndarray:
    return np.array(points, dtype=np.int64)


def _squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances; components of both are at most SMALL, or the arrays hold Python's whole numbers."""
    off = rows - point
    return (off * off).sum(axis=1)


def with_pivot_distances(usable: DataFrame, pivots: Centroids, dims: int, scale: int) -> DataFrame:
    """(vec_id, x, near): usable vectors with their squared distances to the pivots; null where a component is large."""
    points = _matrix(pivots)
    kind = usable.schema["vec_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1), dims)
            scaled = np.floor(rows * scale)
            fits = (np.abs(scaled) <= SMALL).all(axis=1)
            v = np.where(fits[:, None], scaled, 0).astype(np.int64)
            near = np.stack([_squares(v, p) for p in points], axis=1) if len(points) else np.zeros((len(v), 0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(d) if ok else None for d, ok in zip(near, fits, strict=True)], pa.list_(pa.int64()))],
                names=["vec_id", "x", "near"])

    return usable.mapInArrow(measure, f"vec_id {kind}, x array<double>, near array<long>")


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Assigner:
    """Nearest centroid of small vectors under bounds from pivots; counts the exact comparisons it makes."""

    def __init__(self, centroids: Centroids, pivots: Centroids) -> None:
        self.centroids = _matrix(centroids)
        to_pivot = [[math.sqrt(sum((a - b) ** 2 for a, b in zip(c, p, strict=True))) for p in pivots] for c in centroids]
        self.to_pivot = np.array(to_pivot, dtype=np.float64).reshape(len(centroids), len(pivots))
        between = {(i, j): sum((a - b) ** 2 for a, b in zip(pivots[i], pivots[j], strict=True)) for i, j in combinations(range(len(pivots)), 2)}
        self.pairs = [(i, j, math.sqrt(d)) for (i, j), d in between.items() if d]
        self.compared = 0

    def bounds(self, near: np.ndarray) -> np.ndarray:
        """Never above the squared distances of rows to centroids."""
        best = np.zeros((len(near), len(self.centroids)))
        own = np.sqrt(near.astype(np.float64))
        for i, j, apart in self.pairs:
            a, b = own[:, i, None] * self.to_pivot[:, j], own[:, j, None] * self.to_pivot[:, i]
            np.maximum(best, (np.abs(a - b) - SLACK * (a + b)) / apart, out=best)
        return best * best * (1 - SLACK)

    def assign(self, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = self.bounds(near)
        cluster = bounds.argmin(axis=1)
        off = rows - self.centroids[cluster]
        distance = (off * off).sum(axis=1)
        self.compared += len(rows)
        first = cluster.copy()
        for j, centroid in enumerate(self.centroids):
            at = np.flatnonzero((bounds[:, j] <= distance) & (first != j))
            self.compared += len(at)
            exact = _squares(rows[at], centroid)
            better = (exact < distance[at]) | (exact == distance[at]) & (j < cluster[at])
            distance[at[better]], cluster[at[better]] = exact[better], j
        return cluster, distance


def _assigned(centroids: Centroids, pivots: Centroids, scale: int) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    """For a batch (vec_id, x, near): (positions, vectors, clusters, distances) of its small and of its other vectors."""
    assigner = Assigner(centroids, pivots) if _small(centroids) else None

    def of(batch: pa.RecordBatch) -> Iterator[tuple]:
        values, known = _rows(batch.column(1), len(centroids[0])), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        fast = np.flatnonzero(known) if assigner else np.empty(0, np.int64)
        if len(fast):
            rows, near = np.floor(values[fast] * scale).astype(np.int64), _rows(batch.column(2).take(pa.array(fast)), len(pivots))
            yield fast, rows, *assigner.assign(rows, near)
        for at in np.setdiff1d(np.arange(batch.num_rows), fast):
            v = [whole(c, scale) for c in values[at]]
            exact, j = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
            yield np.array([at]), np.array([v], dtype=object), np.array([j]), np.array([exact], dtype=object)

    return of


def limbs(total: int) -> list[int]:
    """A whole number in digits of LIMB bits, least first, all with its sign."""
    sign, rest, out = (1 if total >= 0 else -1), abs(total), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def cluster_sums(cached: DataFrame, centroids: Centroids, pivots: Centroids, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster its count and componentwise sums. Adding up is Spark's; the driver reads k clusters."""
    assigned = _assigned(centroids, pivots, scale)
    dims = len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}  # component -1 counts
        for batch in batches:
            for _, rows, cluster, _ in assigned(batch):
                for j in np.unique(cluster):
                    mine = rows[cluster == j]
                    old = totals.setdefault(int(j), [0] * (dims + 1))
                    totals[int(j)] = [a + int(b) for a, b in zip(old, [*mine.sum(axis=0), len(mine)], strict=True)]
        out = [(j, d, k, part) for j, sums in totals.items() for d, s in enumerate(sums) for k, part in enumerate(limbs(s))]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["cluster", "dim", "limb", "part"])

    parts = cached.mapInArrow(add, "cluster int, dim int, limb int, part long").groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part"))
    found: dict[int, list[int]] = {}
    for r in parts.collect():
        found.setdefault(r["cluster"], [0] * (dims + 1))[r["dim"]] += r["part"] << (LIMB * r["limb"])
    return {j: (sums[dims], sums[:dims]) for j, sums in found.items()}


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE,
                    clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Centroids]:
    """((vec_id, cluster, distance), final centroids): every usable vector at its nearest final centroid."""
    usable = usable_vectors(vectors, id_col, vector_col, dims)
    centroids, fixed = first_by_hash(usable, "1", clusters, scale), first_by_hash(usable, "pivot", pivots, scale)
    fixed = [p for p in fixed if _small([p])]
    cached = written(with_pivot_distances(usable, fixed, dims, scale), "pivots")
    for _ in range(rounds if centroids else 0):
        for j, (n, sums) in cluster_sums(cached, centroids, fixed, scale).items():
            centroids[j] = [s // n for s in sums]
    kind = cached.schema["vec_id"].dataType.simpleString()
    assigned = _assigned(centroids, fixed, scale) if centroids else None

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for at, _, j, exact in assigned(batch):
                cluster[at] = j
                for i, d in zip(at, exact, strict=True):
                    distance[i] = int(d) if d <= LARGEST else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return cached.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """Adds cluster_inertia, inertia and the digest of the centroid; k rows are joined."""
    spark, fits = assigned.sparkSession, "decimal(38,0)"
    known = written(assigned, "pivots-assigned")
    total = lambda: F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast(fits)))
    held = lambda c: F.when(F.col(c) <= F.lit(LARGEST), F.col(c)).cast("long")
    sums = known.groupBy("cluster").agg(total().alias("c"), F.count("*").alias("rows"), F.count("distance").alias("known"), F.sum(F.col("distance").cast(fits)).alias("s"))
    every = sums.agg(F.when(F.sum("rows") == F.sum("known"), F.sum("s")).alias("i")).scalar()
    digests = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)],
                                    "cluster int, centroid_sha256 string")
    of_cluster = sums.join(digests, "cluster").select("cluster", held("c").alias("cluster_inertia"), every.alias("i"), "centroid_sha256")
    return known.join(F.broadcast(of_cluster.select("cluster", "cluster_inertia", held("i").alias("inertia"), "centroid_sha256")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (SELECT rid, vec_id, v, j, d FROM (SELECT k.rid, k.vec_id, k.v, c.j, list_sum(list_transform(list_zip(k.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d,
    row_number() OVER (PARTITION BY k.rid ORDER BY d, c.j) AS place FROM kept k, c{r} c) WHERE place = 1),
s{r} AS (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {DIMS + 1}) t(i) GROUP BY j, i),
m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m{r}.m, c.m) AS m FROM c{r} c LEFT JOIN m{r} USING (j))"""


SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS j, v AS m FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS})),
{",".join(_round(r) for r in range(ROUNDS))},
{_round(ROUNDS).split(f"s{ROUNDS} AS")[0].rstrip().rstrip(",")}
SELECT vec_id, a.j AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (j)
"""


@CATALOGUE.register("op13_centroid_clusters", SQL)
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings")))
