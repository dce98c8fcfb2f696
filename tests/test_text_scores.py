"""BM25 inside the scan: the same answers as the joins give, and few rows leave a task."""

import random

import pytest
from pyspark.sql import functions as F

from contextmill.functions.text import tokens
from contextmill.operators import lexical, text_scores


def joined(docs, req, limit):
    asked = lexical.Asked.of(req)
    toks = docs.select(F.col("id").alias("doc_id"), tokens("text").alias("toks"))
    weights = lexical.bm25_weights(lexical.scan_matches(toks, asked), lexical.corpus_totals(toks), asked.few)
    return lexical.bm25_rank(weights, asked.terms, limit)


def answers(found):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7)) for r in found.collect())


def some_docs(n):
    rng = random.Random(5)
    words = ["alpha", "alpine", "beta", "été", "gamma", "al", "x1"]
    return [(i, None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(i % 9))) for i in range(n)]


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_scan_equals_joins(spark, kind):
    docs = spark.createDataFrame(some_docs(400), "id long, text string").withColumn("id", F.col("id").cast(kind)).repartition(3)
    req = spark.createDataFrame([(1, "al beta al"), (2, "gamma zzz"), (3, "x1 g"), (4, None), (5, "!!")], "query_id long, text string")
    assert answers(lexical.bm25_search(docs, req, "id", F.col("text"), 7)) == answers(joined(docs, req, 7))


def test_repeated_ids_add_up(spark):
    docs = spark.createDataFrame([(1, "red blue"), (1, "red green"), (2, "red"), (1, "red")], "id long, text string")
    req = spark.createDataFrame([(1, "red gr")], "query_id long, text string")
    found = lexical.bm25_search(docs, req, "id", F.col("text"), 5)
    assert answers(found) == answers(joined(docs, req, 5)) and found.count() == 2


@pytest.mark.parametrize("kind, pinned", [("long", 200), ("string", 200), ("int", 0), ("string", 0)])
def test_a_repeated_id_does_not_join_all_documents_with_requests(spark, monkeypatch, kind, pinned):
    rows = some_docs(300) + [(i, t) for i, t in some_docs(60) if i % 2] + [(5, "al alpha"), (5, "al alpha beta"), (None, "al x1"), (None, "gamma"), (None, "x1")]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("id", F.col("id").cast(kind)).repartition(3)
    req = spark.createDataFrame([(1, "al beta al"), (2, "gamma zzz"), (3, "x1 g"), (4, None)], "query_id long, text string")
    expected = sorted(map(str, joined(docs, req, 9).collect()))
    asked = lexical.Asked.of(req)
    monkeypatch.setattr(lexical.Asked, "of", lambda requests: asked)
    monkeypatch.setattr(lexical, "MAX_PINNED_ROWS", pinned)
    # before, one repeated id joined every match of every document with the requests
    monkeypatch.setattr(lexical, "bm25_rank", None)
    assert sorted(map(str, lexical.bm25_search(docs, req, "id", F.col("text"), 9).collect())) == expected


def test_rows_that_leave_the_scan_do_not_grow_with_the_documents(spark):
    req = spark.createDataFrame([(q, "al b g x") for q in range(20)], "query_id long, text string")
    asked = lexical.Asked.of(req)
    terms = text_scores.Terms.of(asked.counted, asked.words)
    for n in (500, 5000):
        toks = spark.createDataFrame(some_docs(n), "id long, text string").repartition(2).select(F.col("id").alias("doc_id"), tokens("text").alias("toks"))
        scored = text_scores.best(toks, terms, text_scores.np.ones(len(terms.words)), 4.0, 10, 1.2, 0.75, 9)
        assert scored.count() == 2 * 10 * 20


def test_many_requests_take_passes(spark, monkeypatch):
    monkeypatch.setattr(text_scores, "MAX_MATRIX_BYTES", 1000)
    docs = spark.createDataFrame(some_docs(200), "id long, text string").repartition(2)
    req = spark.createDataFrame([(q, ["al", "be ga", "x1 é"][q % 3]) for q in range(40)], "query_id long, text string")
    assert answers(lexical.bm25_search(docs, req, "id", F.col("text"), 6)) == answers(joined(docs, req, 6))


def plain_substrings(rows, asked, limit):
    out = []
    for q, text in asked:
        terms = (text or "").lower().split()
        scored = []
        for i, name, code in rows:
            hay = "\x01".join(v for v in (name, code) if v is not None).lower()
            low = (name or "").lower()
            if any(t in hay for t in terms):
                scored.append((-sum(10.0 if low == t else 5.0 if low.startswith(t) else 3.0 if t in low else 1.0 for t in terms), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


def test_substrings_equal_brute_force_and_few_rows_leave_the_scan(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "Foo", "foobar", "afoo", "z", "été"]), rng.choice([None, "has foo", "none", "zz top"])) for i in range(900)]
    asked = [(0, "Foo zz"), (1, "top foo foo"), (2, "missing"), (3, ""), (4, None), (5, "ÉT o")]
    docs = spark.createDataFrame(rows, "id long, name string, code string").repartition(3)
    req = spark.createDataFrame(asked, "query_id long, text string")
    got = lexical.substring_search(docs, req, "id", F.col("name"), [F.col("name"), F.col("code")], 9)
    assert answers(got) == plain_substrings(rows, asked, 9)
    # before, every hit of every request left the scan
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_cascade_looks_up_unanswered_requests_only(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry
    looked = []
    plain = lexical.phrase_search
    monkeypatch.setattr(lexical, "phrase_search", lambda docs, req, *rest: looked.append(req.count()) or plain(docs, req, *rest))
    rows = entry.queries()["fts_like_cascade"](spark, sf_dir)
    answered = rows.where("stage = 0").select("query_id").distinct().count()
    total = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count() + spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    assert looked == [total - answered]
