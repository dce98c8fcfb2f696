import random

import pytest
from pyspark.sql import functions as F

from contextmill.operators import notes
from contextmill.streaming.admission import admit_stream

SMALL = notes.Limits(session_notes=5, session_tokens=40)


def arrivals(seed, n=200):
    rnd = random.Random(seed)
    return [(f"r{i}", "hot" if rnd.random() < 0.6 else rnd.choice("xy"), i, rnd.choice([0, 1, 3, 8, 15, 33, 41])) for i in range(n)]


def loop(data, limits):
    state, out = {}, {}
    for ref, s, pos, t in sorted(data, key=lambda r: r[2]):
        n, used = state.get(s, (0, 0))
        if t > limits.session_tokens:
            out[ref] = "single_note_tokens"
        elif n + 1 > limits.session_notes:
            out[ref] = "session_notes"
        elif used + t > limits.session_tokens:
            out[ref] = "session_tokens"
        else:
            out[ref], state[s] = None, (n + 1, used + t)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_admission_equals_the_loop(spark, seed):
    limits = notes.Limits(session_notes=3 + seed * 4, session_tokens=40 + 30 * seed)
    data = arrivals(seed)
    df = spark.createDataFrame(data, "ref string, session_id string, pos long, token_est long")
    got = {r["ref"]: r["refused_by"] for r in notes.admit(df, limits).collect()}
    assert got == loop(data, limits)


@pytest.mark.parametrize("seed", range(3))
def test_lru_equals_the_loop(spark, seed):
    data = [(r, s, p, t) for r, s, p, t in arrivals(seed + 10)]
    kept = {}
    for ref, s, pos, t in data:
        if t > SMALL.session_tokens:
            continue
        mine = kept.setdefault(s, [])
        while mine and (len(mine) + 1 > SMALL.session_notes or sum(x[1] for x in mine) + t > SMALL.session_tokens):
            mine.pop(0)
        mine.append((ref, t))
    df = spark.createDataFrame(data, "ref string, session_id string, created_at long, token_est long").withColumn("access_count", F.lit(0))
    got = {r["ref"] for r in notes.keep_newest(df, SMALL).collect()}
    assert got == {ref for mine in kept.values() for ref, _ in mine}


def test_stream_admission_equals_the_loop(spark, tmp_path):
    data = arrivals(3, 90)
    for i in range(3):
        part = spark.createDataFrame(data[i * 30:(i + 1) * 30], "ref string, session_id string, pos long, token_est long")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("ref string, session_id string, pos long, token_est long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (admit_stream(src, SMALL).writeStream.format("memory").queryName("admitted").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["ref"]: r["admitted"] for r in spark.sql("SELECT * FROM admitted").collect()}
    assert got == {k: v is None for k, v in loop(data, SMALL).items()}


def test_search_keeps_sessions_apart(spark):
    df = spark.createDataFrame([("a", "s1", "shared label", "alpha text", 1), ("b", "s2", "shared label", "alpha text", 2)],
                               "ref string, session_id string, label string, content string, created_at long")
    ask = lambda text, s: spark.createDataFrame([(0, text, s)], "query_id long, text string, session_id string")
    assert [r["ref"] for r in notes.search_notes(df, ask("alph", "s1")).collect()] == ["a"]
    # phrase fallback: no word starts with it
    assert [(r["ref"], r["score"]) for r in notes.search_notes(df, ask("hared", "s2")).collect()] == [("b", 0.5)]
    assert {r["ref"] for r in notes.search_notes(df, ask("alpha", "")).collect()} == {"a", "b"}


def test_flush_needs_a_scope(spark):
    df = spark.createDataFrame([("a", "s1", "p", 3)], "ref string, session_id string, project_path string, token_est int")
    with pytest.raises(ValueError):
        notes.flush(df)
    assert notes.flush(df, "s1").count() == 1 and notes.flush(df, "s2", ["a"]).count() == 0
