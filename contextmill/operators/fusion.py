"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import top_per_group

RRF_K = 60
SCORE_DIGITS = 12


def vote(rank: Column) -> Column:
    """Contribution of a rank counted from 1."""
    return 1.0 / (RRF_K + rank)


def rrf(lists: list[DataFrame], key: str, limit: int) -> DataFrame:
    """(query_id, key, score, rank) from lists of (query_id, key, rank).

    A key that occurs twice in one list contributes twice. Ties are broken by key.
    """
    votes = reduce(lambda a, b: a.unionByName(b), [
        part.select("query_id", key, vote(F.col("rank")).alias("vote")) for part in lists])
    fused = votes.groupBy("query_id", key).agg(F.round(F.sum("vote"), SCORE_DIGITS).alias("score"))
    return top_per_group(fused, ["query_id"], [F.desc("score"), F.col(key)], limit)


def legs(text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Candidates of both legs, (query_id, id, score, rank, leg): leg 0 is text, leg 1 vectors."""
    cols = ["query_id", "id", "score", "rank"]
    return (text_hits.select(*cols, F.lit(0).alias("leg"))
            .unionByName(vector_hits.select(*cols, F.lit(1).alias("leg"))))


def hybrid(candidates: DataFrame, limit: int) -> DataFrame:
    """(query_id, key, id, leg, similarity, score, rank) from keyed candidates of both legs.

    Requests with vector candidates are fused; the id is that of the best row of the first leg holding
    the key. The others keep the raw scores of their text hits. The candidates of a request are already
    cut per leg, so the window over a request is small, and each leg is evaluated once.
    """
    fuse = F.max("leg").over(Window.partitionBy("query_id")) == 1
    tagged = candidates.withColumn("fuse", fuse).withColumn("part", F.when(F.col("fuse"), 0).otherwise(F.col("rank")))
    best = F.min_by(F.struct("id", "leg"), F.struct("leg", "rank"))
    merged = tagged.groupBy("query_id", "key", "fuse", "part").agg(
        best.alias("best"), F.round(F.sum(vote(F.col("rank"))), SCORE_DIGITS).alias("fused_score"),
        F.max("score").alias("raw_score"), F.max(F.when(F.col("leg") == 1, F.col("score"))).alias("similarity"))
    scored = merged.select(
        "query_id", "key", "best.id", "best.leg", "similarity", "part",
        F.when(F.col("fuse"), F.col("fused_score")).otherwise(F.col("raw_score")).alias("score"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.col("part"), F.col("key")], limit).drop("part")


def stage_counts(requests: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """Candidate counts per request: text leg, vector leg, and distinct keys after fusion (without
    vector hits the text leg cut to the limit)."""
    counts = candidates.groupBy("query_id").agg(
        F.count_if(F.col("leg") == 0).alias("bm25_candidates"),
        F.count_if(F.col("leg") == 1).alias("vector_candidates"),
        F.count_distinct("key").alias("keys"))
    fused = F.when(F.col("vector_candidates") > 0, F.col("keys")).otherwise(
        F.least(F.col("bm25_candidates"), F.lit(limit)))
    out = requests.select("query_id").join(
        counts.select("query_id", "bm25_candidates", "vector_candidates", fused.alias("hybrid_after_fuse")),
        "query_id", "left")
    return out.na.fill(0)
