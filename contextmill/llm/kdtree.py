"""Exact top-k by inner product with a KD-tree per shard.

Vectors are scaled to whole numbers. Shards hold a bounded number of rows. In a first wave each shard's own queries
search its tree, which gives every query a k-th score that no final answer can fall below. That bound travels with
the query to all other shards, in whose trees nodes are visited best-first by the largest inner product their
tight box allows, until that falls below the k-th score. A shard reads its rows once, builds its tree and then
streams queries past it, so memory is bounded by the shard; many queries of one shard are dealt over salted copies.

Vectors with components so large that an inner product of two such could pass a long are kept apart and meet all rows in
blocks, in integers of any size. Exact repeats of a row are one row of a tree with a number of copies.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..plans.catalogue import Catalogue
from .common import cut, table

CATALOGUE = Catalogue()
SCALE = 1024
SHARD_ROWS = 8192
LEAF_ROWS = 64
QUERIES_PER_SALT = 50_000
FOUND = "query_id long, vec_id long, score long, copies long"
WIDE_BLOCK = 512


class KDTree:
    """Median splits along the widest side; every node has the tight box of its rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, copies: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        exact = np.float64 if rows.shape[1] * float(np.abs(rows).max(initial=0)) ** 2 < 2**52 else np.int64
        order = np.lexsort((ids,))
        spans, children, lows, highs, todo = [], [], [], [], [(0, len(ids), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            block, me = rows[order[start:end]], len(spans)
            low, high = block.min(axis=0), block.max(axis=0)
            if parent >= 0:
                children[parent][side] = me
            spans.append((start, end))
            children.append([-1, -1])
            lows.append(low)
            highs.append(high)
            axis = int((high - low).argmax())
            if end - start > leaf_rows and high[axis] > low[axis]:
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(block[:, axis], middle)]
                todo += [(start, start + middle, me, 0), (start + middle, end, me, 1)]
        self.ids, self.copies, self.rows, self.spans, self.children = ids[order], copies[order], rows[order].astype(exact), spans, children
        self.low, self.high, self.kind = np.stack(lows).astype(exact), np.stack(highs).astype(exact), exact

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, ids, scores, copies) of at most k best different rows per query that reach the query's floor; ties to smaller ids."""
        queries = queries.astype(self.kind)
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for i, query in enumerate(queries):
            bound, floor = bounds[i], floors[i]
            at, best = np.empty(0, np.int64), np.empty(0, np.int64)
            heap = [(-bound[0], 0)]
            while heap:
                negative, node = heapq.heappop(heap)
                if -negative < floor:
                    break
                left, right = self.children[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= floor:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                start, end = self.spans[node]
                scores = self.rows[start:end] @ query
                keep = (scores >= floor) & (self.ids[start:end] != own[i])
                if keep.any():
                    at = np.concatenate([at, start + np.flatnonzero(keep)])
                    best = np.concatenate([best, scores[keep].astype(np.int64)])
                    top = np.lexsort((self.ids[at], -best))[:k]
                    at, best = at[top], best[top]
                    if len(best) == k:
                        floor = max(floor, best[-1])
            yield i, self.ids[at], best, self.copies[at]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x array<double>, dims, copies, wide), a row per different (vec_id, x). Left out: null vectors and ids, empty
    vectors, such with null or non-finite components. wide: a product with another such vector might not fit a long."""
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    wide = F.exists(x, lambda c: F.abs(c) * scale >= F.sqrt(F.lit(2.0**62) / F.size(x)))
    return rows.groupBy("vec_id", "x").agg(F.count("*").alias("copies")).select("vec_id", "x", F.size(x).alias("dims"), "copies", wide.alias("wide"))


def _whole(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def _wide_pairs(rows: DataFrame, n: int, n_wide: int, k: int, scale: int) -> DataFrame:
    """Answers of pairs with a wide vector, at most k for each query and pair of blocks."""
    i, j = max(1, math.ceil(n_wide / WIDE_BLOCK)), max(1, math.ceil(n / SHARD_ROWS))
    block = F.xxhash64("vec_id", "x")
    wide = rows.where("wide").select(F.pmod(block, F.lit(i)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(j - 1))).alias("j"), "vec_id", "x", "query", "copies")
    every = rows.select(F.explode(F.sequence(F.lit(0), F.lit(i - 1))).alias("i"), F.pmod(block, F.lit(j)).alias("j"), "vec_id", "x", "query", "copies", "wide")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        def best(asking: pd.DataFrame, held: pd.DataFrame) -> Iterator[tuple[int, int, int, int]]:
            vectors = [[_whole(c, scale) for c in v] for v in held["x"]]
            for q, v in zip(asking["vec_id"], asking["x"], strict=True):
                query = [_whole(c, scale) for c in v]
                scored = ((sum(map(operator.mul, query, other)), vec, n) for vec, other, n in zip(held["vec_id"], vectors, held["copies"], strict=True) if vec != q)
                top = heapq.nsmallest(k, ((-s, vec, n) for s, vec, n in scored if -(2**63) <= s < 2**63))
                yield from ((q, vec, -s, n) for s, vec, n in top)

        found = [*best(right[right["query"]], left), *best(left[left["query"]], right[~right["wide"]])]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "copies"]).astype("int64")

    return wide.groupBy("i", "j").cogroup(every.groupBy("i", "j")).applyInPandas(meet, FOUND)


def exact_topk(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
               shard_rows: int = SHARD_ROWS, queries_per_salt: int = QUERIES_PER_SALT) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product per query, ties to smaller ids.

    is_query is a condition on vec_id. A query never meets rows of its own id. Vectors of different length do not
    meet. A query with fewer candidates than k gets them all; an empty table gives an empty result. Every row is a candidate:
    one that is there twice comes back twice. Repeats of a query's row ask once; the answers of several different vectors under
    one id are ranked together. A pair whose score does not fit a long has no answer.
    """
    rows = usable(vectors, id_col, vector_col, scale).withColumn("query", is_query)
    whole = rows.where("NOT wide").select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"), "dims", "copies", "query")
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("long")).alias("q"), F.sum(F.col("wide").cast("long")).alias("wide")).collect()
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for size in sizes:
        dims = F.col("dims") == size["dims"]
        if size["wide"]:
            found = found.unionByName(_wide_pairs(rows.where(dims), size["n"], size["wide"], k, scale))
        if size["n"] > size["wide"]:
            found = found.unionByName(_one_length(cut(whole.where(dims)), size["dims"], size["n"], size["q"], k, shard_rows, queries_per_salt))
    every = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("_copy"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "_copy")
    return every.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _one_length(rows: DataFrame, dims: int, n: int, n_queries: int, k: int, shard_rows: int, queries_per_salt: int) -> DataFrame:
    shards, salts = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / queries_per_salt))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))

    def at_home(rows: pd.DataFrame) -> pd.DataFrame:
        ids, matrix = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy())
        asked = rows["query"].to_numpy()
        tree = KDTree(ids, matrix, rows["copies"].to_numpy())
        out = [(ids[asked][i], *hit) for i, *hits in tree.search(matrix[asked], ids[asked], k, np.full(asked.sum(), -np.inf)) for hit in zip(*hits, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "copies"]).astype("int64")

    first = cut(placed.groupBy("shard").applyInPandas(at_home, FOUND))
    if shards == 1:
        return first
    # a k-th score counts only where k answers were found
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select("query_id", "low")
    asking = placed.where("query").join(floors, placed["vec_id"] == floors["query_id"], "left").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to"), "shard", "vec_id", "v", "low")
    asking = asking.where("to != shard").select(
        F.col("to").alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "vec_id", "v", "low", F.lit(1).cast("long").alias("copies"))
    held = placed.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "vec_id", "v",
                         F.lit(None).cast("long").alias("low"), "copies")

    def abroad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, ids, blocks, copies = None, None, [], [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)])
            edges = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == end:
                    continue
                part, (shard, salt, kind) = batch.slice(start, end - start), keys[:, start]
                part_ids, matrix = part.column(3).to_numpy(), _matrix(part.column(4), dims)
                if kind == 0:
                    if at != (shard, salt):
                        at, tree, ids, blocks, copies = (shard, salt), None, [], [], []
                    ids.append(part_ids)
                    copies.append(part.column(6).to_numpy())
                    blocks.append(matrix)
                    continue
                if at != (shard, salt):
                    continue  # a shard without rows
                if tree is None:
                    tree, ids, blocks = KDTree(np.concatenate(ids), np.concatenate(blocks), np.concatenate(copies)), [], []
                low = part.column(5).to_pandas().astype("float64").fillna(-np.inf).to_numpy()
                hits = [(part_ids[i], *hit) for i, *hit in tree.search(matrix, part_ids, k, low) if len(hit[0])]
                if hits:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.full(len(hit[1]), hit[0]) for hit in hits])),
                         *(pa.array(np.concatenate([hit[n] for hit in hits])) for n in (1, 2, 3))], names=["query_id", "vec_id", "score", "copies"])

    other = (held.unionByName(asking).repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "vec_id")
             .mapInArrow(abroad, FOUND))
    return first.unionByName(other)


SQL = """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM s q JOIN s c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""


@CATALOGUE.register("op10_exact_topk", SQL)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
