import random

from pyspark.sql import functions as F

from contextmill.functions.scalars import json_token_estimate, saved_vs_files, tokens_saved
from contextmill.operators import fusion, packing

HIT = ("query_id long, rank int, score double, mode string, token_budget int, already boolean, file string, out_file string, name string, "
       "kind string, start_line int, end_line int, code string, source string, skeleton string, summary string, extra_bytes int")


def loop(hits, budget):
    """Packing as a loop with running counts."""
    top, full, used, sent, skipped = hits[0]["score"], 0, 0, [], []
    for h in hits:
        ratio = h["score"] / top if top > 0 else None
        if ratio is None:
            mode = "full" if full < 3 else "skeleton"
        else:
            mode = "full" if ratio >= 0.5 or full < 2 else "skeleton" if ratio >= 0.2 else "summary"
        body = {"full": h["source"], "skeleton": h["skeleton"], "summary": h["summary"]}[mode]
        size = len(body)
        if h["already"]:
            skipped.append((h["rank"], mode))
            continue
        if mode == "full":
            full += 1
        if used + size > budget:
            break
        used += size
        sent.append((h["rank"], mode))
    return sent, skipped


def test_packing_equals_the_loop(spark):
    rnd, rows, want = random.Random(5), [], {}
    for q in range(40):
        n = rnd.randint(1, 30)
        scores = sorted((round(rnd.random() ** 3, 3) for _ in range(n)), reverse=True)
        if q % 9 == 0:
            scores = [0.0] * n
        hits = [dict(rank=i + 1, score=s, already=rnd.random() < 0.3, source="s" * rnd.randint(1, 60), skeleton="k" * rnd.randint(1, 20),
                     summary="u" * rnd.randint(1, 9)) for i, s in enumerate(scores)]
        budget = rnd.randint(1, 300)
        want[q] = loop(hits, budget)
        rows += [(q, h["rank"], h["score"], "auto", budget, h["already"], "f", "f", "n", "k", 1, 1, "", h["source"], h["skeleton"], h["summary"], 0) for h in hits]
    df = spark.createDataFrame(rows, HIT)
    # size of the content only, so that the loop above needs no JSON
    packed = packing.pack(df).withColumn("size", F.when(F.col("effective_mode") == "full", F.length("source"))
                                         .when(F.col("effective_mode") == "skeleton", F.length("skeleton")).otherwise(F.length("summary")))
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    packed = packed.withColumn("cum", F.sum(F.when(~F.col("already"), F.col("size")).otherwise(0)).over(w))
    got = {q: ([], []) for q in want}
    for r in packed.where("cum <= token_budget").orderBy("query_id", "rank").collect():
        got[r["query_id"]][1 if r["already"] else 0].append((r["rank"], r["effective_mode"]))
    assert {q: (list(a), list(b)) for q, (a, b) in got.items()} == want


def test_savings(spark):
    one = lambda u, s, f, d: spark.range(1).select(
        tokens_saved(F.lit(u), F.lit(s), F.lit(d)).alias("a"), saved_vs_files(F.lit(u), F.lit(f), F.lit(d)).alias("b")).first()
    assert tuple(one(100, 500, 800, 50)) == (450, 750)
    assert tuple(one(600, 500, 800, 0)) == (0, 200)


def test_json_tokens_count_escapes(spark):
    df = spark.createDataFrame([('{"a":"<b>& "}',)], "j string")
    # <, > and & take six bytes each, U+2028 six instead of three
    assert df.select(json_token_estimate(F.col("j"))).first()[0] == (len('{"a":"b"}') + 18 + 6) // 4


def test_summary_fallbacks(spark):
    from contextmill.functions.scalars import content_hash
    hits = spark.createDataFrame([("f", "a", "/p", "code"), ("f", "b", "/p", "other"), ("g", "c", "/p", "")], "file string, name string, project_path string, code string")
    good = spark.createDataFrame([("code",)], "c string").select(content_hash("c")).first()[0]
    cached = spark.createDataFrame([("f", "a", "/p", "sum a", good), ("f", "", "/p", "file sum", "zzz"), ("g", None, "/p", "file g", "zzz")],
                                   "file string, name string, project_path string, summary_text string, content_hash string")
    got = {r["name"]: r["summary"] for r in packing.attach_summaries(hits, cached).collect()}
    assert got == {"a": "sum a", "b": None, "c": "file g"}


def test_session_dedup(spark):
    hits = spark.createDataFrame([("s", "/proj/a.go", "Foo", 10), ("s", "/proj/a.go", "Foo", 11)], "session_id string, file string, name string, start_line int")
    sent = hits.where("start_line = 10")
    assert [r["already"] for r in packing.mark_returned(hits, sent.union(sent)).orderBy("start_line").collect()] == [True, False]
    assert packing.drop_returned(hits, sent).count() == 1


def test_fusion(spark):
    rows = [(0, "k1", 1, 9.0, 1, 0), (0, "k2", 2, 8.0, 2, 0), (0, "k1", 3, 7.0, 3, 0), (0, "k2", 4, 0.9, 1, 1), (1, "k9", 5, 4.0, 1, 0), (1, "k9", 6, 3.0, 2, 0)]
    df = spark.createDataFrame(rows, "query_id long, key string, id long, score double, rank int, leg int")
    got = [(r["query_id"], r["key"], r["id"], r["leg"], r["score"]) for r in fusion.hybrid(df, 10).orderBy("query_id", "rank").collect()]
    assert got == [(0, "k2", 2, 0, round(1 / 62 + 1 / 61, 12)), (0, "k1", 1, 0, round(1 / 61 + 1 / 63, 12)), (1, "k9", 5, 0, 4.0), (1, "k9", 6, 0, 3.0)]
    assert {r["query_id"]: r["hybrid_after_fuse"] for r in fusion.stage_counts(df.select("query_id").distinct(), df, 1).collect()} == {0: 2, 1: 1}
