import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextmill.llm.kdtree import exact_topk

from .helpers import clashing


def brute(rows, k=10, every=100):
    usable = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in set(usable):
        if q % every == 0:
            scored = ((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))
            out.setdefault(q, []).extend((s, i) for s, i in scored if -(2**63) <= -s < 2**63)
    return sorted((q, n, i, -s) for q, found in out.items() for n, (s, i) in enumerate(sorted(found)[:k], 1))


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def answers(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_against_brute_force(spark, shard_rows):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) + (i % 4) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]
    got = exact_topk(clashing(table(spark, rows)), F.col("vec_id") % 20 == 0, shard_rows=shard_rows, queries_per_salt=7)
    assert answers(got) == brute(rows, every=20)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 0.0]), (500, []), (None, [1.0, 1.0]),
            (600, [1.0, 2.0, 3.0]), (1, [0.0, 0.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-1.0, -2.0]), (700, [3e38, 0.0])]
    got = answers(exact_topk(table(spark, rows), F.col("vec_id") % 100 == 0))
    assert got == brute([(i, v and [x if x is None else np.float32(x).item() for x in v]) for i, v in rows])
    assert [x[2] for x in got if x[0] == 0] == [2, 3, 1, 4]


@pytest.mark.parametrize("shard_rows", [8, 10_000])
def test_repeats_and_large_components(spark, shard_rows):
    r = random.Random(5)
    rows = [(i, [float(r.randint(-9, 9)) for _ in range(3)]) for i in range(60) for _ in range(1 + i % 3)]
    rows += [(100, [1.0, 0.0, 0.0]), (101, [3e10, 0.0, 1.0]), (102, [3e10, 0.0, 1.0]), (102, [3e10, 0.0, 1.0]), (103, [-3e10, 5.0, 0.0]), (200, [1e15, 1.0, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(exact_topk(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows))
    assert got == brute(rows, every=20)
    assert [x[2] for x in got if x[0] == 100][:3] == [101, 102, 102]


def test_empty_table(spark):
    got = exact_topk(table(spark, []), F.col("vec_id") % 100 == 0)
    assert got.count() == 0 and got.columns == ["query_id", "rank", "vec_id", "score"]
