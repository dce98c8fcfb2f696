"""Exact nearest neighbours by cosine similarity.

The vectors stay where they were scanned. Each task multiplies its Arrow batches with the matrix of
request vectors and keeps, per request, only rows that can still be among the best k of the batch
(ties included); the final cut is a ranked top-k per request.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordered import top_per_group

SIM_DIGITS = 9
MAX_MATRIX_BYTES = 64 << 20


def _normalize_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _batch_scorer(query_ids: list[int], matrix: np.ndarray, k: int, dims: int):
    queries = _normalize_rows(matrix)
    qids = np.asarray(query_ids, dtype=np.int64)
    # so many rows at once that the similarities stay within the bound, whatever the number of requests
    step = max(k, MAX_MATRIX_BYTES // (8 * max(len(qids), 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = _normalize_rows(flat.astype(np.float64).reshape(batch.num_rows, dims))
            sims = np.round(queries @ rows.T, SIM_DIGITS)
            if batch.num_rows > k:
                cut = -np.partition(-sims, k - 1, axis=1)[:, k - 1:k]
                q, r = np.nonzero(sims >= cut)
            else:
                q, r = np.divmod(np.arange(sims.size), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[q]), batch.column(0).take(pa.array(r)), pa.array(sims[q, r] + 0.0)],
                names=["query_id", "vec_id", "similarity"])

    return score


def knn(vectors: DataFrame, requests: DataFrame, k: int, dims: int, id_col: str = "vec_id",
        vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar vectors per request.

    requests has (query_id, vector). Vectors of another size than dims are left out, as are requests
    of another size. vec_id has the type of id_col. The request matrix and the similarities of a task are
    limited to MAX_MATRIX_BYTES each; more requests than that take several passes over the vectors.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.size(vector_col) == dims).select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = requests.where(F.size("vector") == dims).select("query_id", "vector").collect()
    per_pass = max(1, MAX_MATRIX_BYTES // (8 * dims))
    schema = f"query_id long, vec_id {vectors.schema[id_col].dataType.simpleString()}, similarity double"
    scored = None
    for i in range(0, len(rows), per_pass):
        block = rows[i:i + per_pass]
        matrix = np.array([r["vector"] for r in block], dtype=np.float64)
        part = usable.mapInArrow(_batch_scorer([r["query_id"] for r in block], matrix, k, dims), schema)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        scored = spark.createDataFrame([], schema)
    return top_per_group(scored, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)
