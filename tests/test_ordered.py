"""Ordered computations against plain loops, with one group holding most rows."""

import random

from pyspark.sql import functions as F

from contextmill.operators import ordered


def rows(seed, n=400):
    rnd = random.Random(seed)
    return [(i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.randint(0, 60), rnd.randint(0, 9)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, k string, t long, v long")


def test_running_sum(spark):
    data = rows(1)
    got = ordered.running_sum(frame(spark, data), ["k"], F.col("t"), [F.col("t"), F.col("id")], F.col("v"), "s", 7)
    want, totals = {}, {}
    for i, k, t, v in sorted(data, key=lambda r: (r[2], r[0])):
        totals[k] = totals.get(k, 0) + v
        want[i] = totals[k]
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_running_sum_without_group(spark):
    data = rows(2)
    got = ordered.running_sum(frame(spark, data), [], -F.col("t"), [F.desc("t"), F.col("id")], F.col("v"), "s")
    want, total = {}, 0
    for i, k, t, v in sorted(data, key=lambda r: (-r[2], r[0])):
        total += v
        want[i] = total
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_neighbours(spark):
    data = rows(3)
    nxt = ordered.neighbour(frame(spark, data), ["k"], F.col("t"), ["t", "id"], ["id"], "n", True, 9)
    prv = ordered.neighbour(frame(spark, data), ["k"], F.col("t"), ["t", "id"], ["id"], "n", False, 9)
    after, before = {}, {}
    for k in {r[1] for r in data}:
        ids = [r[0] for r in sorted((r for r in data if r[1] == k), key=lambda r: (r[2], r[0]))]
        after |= dict(zip(ids, ids[1:] + [None]))
        before |= dict(zip(ids, [None] + ids[:-1]))
    assert {r["id"]: r["n"] and r["n"]["id"] for r in nxt.collect()} == after
    assert {r["id"]: r["n"] and r["n"]["id"] for r in prv.collect()} == before


def test_as_of(spark):
    versions, probes = rows(4, 150), rows(5, 300)
    got = ordered.as_of(frame(spark, probes).select("id", "k", "t"), frame(spark, versions), ["k"], F.col("t"), F.col("t"), ["t", "id", "v"], "m", 6)
    want = {}
    for i, k, t, _ in probes:
        known = [(vt, vi, vv) for vi, vk, vt, vv in versions if vk == k and vt <= t]
        want[i] = max(known) if known else None
    assert {r["id"]: tuple(r["m"]) if r["m"] else None for r in got.collect()} == want


def test_buckets_split_a_hot_group(spark):
    df = spark.range(1000).select(F.col("id").alias("t"), F.lit("hot").alias("k"))
    points = ordered.split_points(df, F.col("t"), 8)
    sizes = [r["count"] for r in df.groupBy(ordered.bucket_of(F.col("t"), points).alias("b")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 250


def test_top_per_group_is_cut_before_the_shuffle(spark):
    df = ordered.top_per_group(frame(spark, rows(6)), ["k"], [F.desc("v"), F.col("id")], 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert df.groupBy("k").count().agg(F.max("count")).first()[0] == 5
