"""Vector expressions. All arithmetic is in double precision over float inputs."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .scalars import ColumnLike, as_col


def _doubles(v: ColumnLike) -> Column:
    return as_col(v).cast("array<double>")


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Cosine similarity, 0 when either norm is 0."""
    denominator = norm(a) * norm(b)
    return F.when(denominator == 0, F.lit(0.0)).otherwise(dot(a, b) / denominator)


def l2_normalize(v: ColumnLike) -> Column:
    """Unit vector; a zero vector is returned as it is."""
    length = norm(v)
    return F.when(length == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / length))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_float32(blob: pd.Series) -> pd.Series:
    """Little-endian float32 blob to array; null when the length is not a multiple of four."""
    return blob.map(lambda b: list(struct.unpack(f"<{len(b) // 4}f", b))
                    if b is not None and len(b) % 4 == 0 else None)
