"""Admission under the caps of all sessions, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from contextmill.operators.notes import Limits, admit_globally

NOTE = "ref string, session_id string, pos long, token_est long, held boolean"


def brute(rows, limits):
    count = used = 0
    of, out = {}, {}
    for ref, session, _, size, held in sorted(rows, key=lambda r: (not r[4], r[2], r[1], r[0])):
        n, t = of.get(session, (0, 0))
        why = None
        if not held:
            why = ("single_note_tokens" if size > limits.session_tokens else "session_notes" if n >= limits.session_notes
                   else "session_tokens" if t + size > limits.session_tokens else "global_notes" if count >= limits.global_notes
                   else "global_tokens" if used + size > limits.global_tokens else None)
        if why is None:
            count, used, of[session] = count + 1, used + size, (n + 1, t + size)
        out[ref] = (why is None, why)
    return out


def decided(df):
    return {r["ref"]: (r["admitted"], r["refused_by"]) for r in df.collect()}


@pytest.mark.parametrize("seed, sessions, caps", [(1, 1, (5, 60, 8, 50)), (2, 12, (4, 40, 20, 170)), (3, 150, (3, 30, 25, 10_000))])
def test_against_a_loop(spark, seed, sessions, caps):
    r = random.Random(seed)
    rows = [(f"h{i}", f"s{r.randrange(sessions)}", -1, r.randrange(1, 6), True) for i in range(3)]
    rows += [(f"n{i}", f"s{r.randrange(sessions)}", r.randrange(200), r.choice([0, 1, 5, 9, 20, 31, 70]), False) for i in range(300)]
    limits = Limits(*caps)
    assert decided(admit_globally(spark.createDataFrame(rows, NOTE), limits)) == brute(rows, limits)


def test_a_million_sessions(spark):
    many = spark.range(1_000_000).select(F.concat(F.lit("n"), "id").alias("ref"), F.concat(F.lit("s"), "id").alias("session_id"),
                                         F.col("id").alias("pos"), (F.pmod("id", F.lit(900)) + 1).alias("token_est"), F.lit(False).alias("held"))
    got = admit_globally(many).groupBy("admitted", "refused_by").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()
    want = {}
    for i, (admitted, why) in enumerate(brute([(i, i, i, i % 900 + 1, False) for i in range(1_000_000)], Limits()).values()):
        n, _ = want.get((admitted, why), (0, 0))
        want[admitted, why] = (n + 1, i)
    assert {(r["admitted"], r["refused_by"]): (r["n"], r["last"]) for r in got} == want


def test_full_and_empty(spark):
    rows = [("h", "s", -1, 10, True), ("n", "t", 1, 1, False)]
    limits = Limits(5, 50, 1, 100)
    assert decided(admit_globally(spark.createDataFrame(rows, NOTE), limits)) == brute(rows, limits) == {"h": (True, None), "n": (False, "global_notes")}
    assert admit_globally(spark.createDataFrame([], NOTE), limits).count() == 0
