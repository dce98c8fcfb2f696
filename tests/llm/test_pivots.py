import hashlib
import math
import random

import numpy as np
import pytest

from contextmill.llm.pivots import Assigner, cluster_vectors, limbs, with_inertia

from .helpers import clashing

LARGEST = 2**63 - 1


def whole(x, scale=64):
    return math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale


def brute(rows, dims, k=16, rounds=3):
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, j in last:
        inertia[j] = inertia.get(j, 0) + d
    fits = lambda d: d if d <= LARGEST else None
    part = {j: fits(s) if all(d <= LARGEST for _, d, c in last if c == j) else None for j, s in inertia.items()}
    total = fits(sum(inertia.values())) if all(d <= LARGEST for _, d, _ in last) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, fits(d), part[j], total, digest[j]) for i, d, j in last), key=repr)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def answers(df, dims, **more):
    return sorted((tuple(r) for r in with_inertia(*cluster_vectors(df, dims=dims, **more)).collect()), key=repr)


@pytest.mark.parametrize("pivots", [0, 1, 2, 5])
def test_against_brute_force(spark, pivots):
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.gauss(i % 7, 0.4))) for _ in range(6)]) for i in range(500)] + [(1000 + i, [0.25] * 6) for i in range(60)]
    rows += rows[:30] + [(7, [1.0] * 6), (7, [2.0] * 6), (None, [0.5] * 6), (None, [0.5] * 6)]
    assert answers(clashing(table(spark, rows)), 6, pivots=pivots) == brute(rows, 6)


def test_awkward_and_large_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [-inf, 1.0]), (7, [1.0, 2.0, 3.0])]
    rows += [(10 + i, [float(i % 5), -float(i)]) for i in range(40)] + [(100, [1e9, -3e7]), (101, [1e9, -3e7]), (102, [1e300, 1.0]), (103, [-1.7e308, 5e-324])]
    assert answers(table(spark, rows, "double"), 2) == brute(rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5])] * 20])
def test_small_tables(spark, rows):
    assert answers(table(spark, rows), 2) == brute(rows, 2)


def test_bounds_never_exceed_distances_and_save_comparisons():
    r = np.random.default_rng(1)
    middle = r.integers(-2000, 2000, (16, 32))
    rows = (middle[r.integers(0, 16, 4000)] + r.integers(-60, 60, (4000, 32))).astype(np.int64)
    pivots = [[int(x) for x in rows[i]] for i in range(5)]
    near = np.stack([((rows - np.array(p)) ** 2).sum(axis=1) for p in pivots], axis=1)
    a = Assigner([[int(x) for x in c] for c in middle], pivots)
    exact = ((rows[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (a.bounds(near) <= exact).all()
    cluster, distance = a.assign(rows, near)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert a.compared < 0.5 * exact.size


def test_limbs():
    for n in (0, 1, -1, 2**30, -(2**30) - 1, 10**300, -(10**300)):
        assert sum(p << (30 * k) for k, p in enumerate(limbs(n))) == n and all(abs(p) < 2**30 for p in limbs(n))
