"""Hits go to the scan of what they name: no text of the other rows is shuffled to meet them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contextmill.plans import capsule, retrieve

QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Tables count as too large for a broadcast that was not asked for."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def inputs(spark):
    syms = spark.range(300).select(
        "id", F.concat(F.lit("n"), F.col("id") % 50).alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("/r/f"), F.col("id") % 100).alias("file"),
        F.lit("/r").alias("project_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.concat(F.lit("f"), "id").alias("fqn"),
        F.concat(F.lit("word"), F.col("id") % 7, F.lit(" code")).alias("code"), F.concat(F.lit("source of "), "id").alias("source"), F.lit("skel").alias("skeleton"))
    vectors = syms.select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    asked = spark.createDataFrame([(1, "word3 n4", [1.0, 0.2], "s"), (2, "word1", None, "s"), (3, "", [0.1, 1.0], "")], "query_id long, text string, vector array<float>, session_id string")
    asked = asked.select("*", F.lit("auto").alias("mode"), F.lit(90).alias("token_budget"), F.lit("/r").alias("root"))
    sent = syms.where("id % 3 = 0").select(F.lit("s").alias("session_id"), "file", "name", "start_line")
    cached = syms.where("id % 2 = 0 AND id < 100").select("file", F.when(F.col("id") % 4 == 0, F.col("name")).otherwise("").alias("name"), "project_path",
                                                         F.lit("summed up").alias("summary_text"), F.lit("").alias("content_hash"))
    return dict(symbols=syms, vectors=vectors, requests=asked, returned=sent.union(sent), summaries=cached)


def answers(df):
    return sorted(map(str, df.collect()))


def test_few_hits_and_many_give_the_same_capsules(spark, monkeypatch):
    few = answers(capsule.capsule(**inputs(spark), limit=20, dims=2))
    monkeypatch.setattr(capsule, "MAX_PINNED_ROWS", 0)
    assert few == answers(capsule.capsule(**inputs(spark), limit=20, dims=2)) and len(few) == 60
    assert any("already=True" in r for r in few) and any("summed up" in r for r in few)


def test_repeated_ids_come_once_per_row(spark):
    given = inputs(spark)
    given["symbols"] = given["symbols"].union(given["symbols"].where("id = 3"))
    ranked = spark.createDataFrame([(1, 3, 1.0, 1), (1, 4, 0.5, 2)], "query_id long, id long, score double, rank int")
    hits = capsule.prepare_hits(ranked, given["symbols"], given["requests"], given["returned"], given["summaries"])
    assert sorted(r["id"] for r in hits.collect()) == [3, 3, 4]


@pytest.mark.parametrize("name", ["capsule_pack", "mode_select"])
def test_texts_meet_the_hits_in_their_scan(spark, sf_dir, large, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    # what is left to shuffles are the hits and the summaries of their files
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
    assert all("id#" not in line and "doc_id#" not in line for line in plan.splitlines() if "SortMergeJoin" in line and "LeftSemi" not in line)


def test_savings_make_the_capsules_once(spark, sf_dir, large):
    plan = plan_of(QUERIES["capsule_savings"](spark, sf_dir))
    assert "Window" not in plan and plan.count("SortMergeJoin") <= 1


def test_chunks_of_a_retrieval_meet_the_hits_in_their_scan(spark, large):
    given = inputs(spark)
    docs = given["symbols"].select(F.col("id").alias("chunk_id"), F.col("name").alias("title"), F.col("code").alias("content"), F.col("file").alias("path"))
    hits = spark.createDataFrame([(1, 5, 1.0, 1), (1, 6, 0.5, 2)], "query_id long, doc_id long, score double, rank int")
    rows = retrieve.doc_chunks_for(docs, given["requests"], 5, hits)
    assert "SortMergeJoin" not in plan_of(rows) and rows.count() == 2
