"""Vectors of documents, notes and memory: one table of several kinds, each entity under a key it can be found by again.

A vector belongs to an entity and the hash of the text it was made from; when that changes, the entity is missing a vector
until the next pass, and the old vector is not found any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import cosine
from . import fusion, knn
from .memory import format_line
from .ordered import top_per_group

# How the keys of a kind begin; a document chunk's own id begins that way already.
KEYS = {"doc": "", "note": "note:", "memory": "mem:"}


def entity_key(kind: str, ident: Column) -> Column:
    return F.concat(F.lit(KEYS[kind]), ident)


def entity_id(kind: str, key: Column) -> Column:
    """Id from a key; null for keys of another form."""
    prefix = KEYS[kind]
    return F.when(F.startswith(key, F.lit(prefix)), F.substr(key, F.lit(len(prefix) + 1)))


def embeddable(kind: str, rows: DataFrame) -> DataFrame:
    """(ident, content_hash, project_path, text) of document chunks, notes or memory entries."""
    if kind == "doc":
        return rows.select(F.col("chunk_id").alias("ident"), "content_hash", F.lit("").alias("project_path"), F.concat_ws("\n", "title", "content").alias("text"))
    if kind == "note":
        return rows.select(F.col("ref").alias("ident"), "content_hash", "project_path", F.concat_ws(" ", "label", "content").alias("text"))
    # the text of an entry never changes, so its reference serves as hash
    return rows.select(F.col("ref").alias("ident"), F.col("ref").alias("content_hash"), "project_path", format_line().alias("text"))


def missing(kind: str, texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """The backlog of a kind: rows of embeddable() without a vector of their current text."""
    have = vectors.where(F.col("doc_type") == kind).select(entity_id(kind, F.col("source_file")).alias("ident"), "content_hash").distinct()
    return texts.join(have, ["ident", "content_hash"], "left_anti")


def vector_rows(kind: str, texts: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Rows of the vectors table for a backlog."""
    return texts.select("content_hash", embed(F.col("text")).alias("embedding"), F.lit(kind).alias("doc_type"),
                        entity_key(kind, F.col("ident")).alias("source_file"), F.lit(kind).alias("kind"), "project_path")


def current_vectors(kind: str, vectors: DataFrame, live: DataFrame) -> DataFrame:
    """(ident, …, embedding): one vector per live entity (ident, content_hash and further columns), of its current text."""
    mine = vectors.where(F.col("doc_type") == kind).select(entity_id(kind, F.col("source_file")).alias("ident"), "content_hash", "embedding")
    once = mine.groupBy("ident", "content_hash").agg(F.min("embedding").alias("embedding"))
    return live.join(once, ["ident", "content_hash"])


def nearest(vectors: DataFrame, requests: DataFrame, k: int, dims: int) -> DataFrame:
    """(query_id, id, score, rank) by cosine similarity among vectors (ident, embedding)."""
    return knn.knn(vectors, requests, k, dims, "ident").select("query_id", F.col("vec_id").alias("id"), F.col("similarity").alias("score"), "rank")


def nearest_in_session(vectors: DataFrame, requests: DataFrame, k: int, dims: int, admit_blank: bool = False) -> DataFrame:
    """As nearest, but a request (query_id, vector, session_id) only meets vectors (ident, session_id, embedding) of its
    session; an empty session meets all. With admit_blank, vectors without a session are met by every request.

    Requests with a session are joined by it, so each compares what its session holds and nothing else.
    """
    asked = requests.withColumn("wanted", F.coalesce("session_id", F.lit("")))
    anywhere = nearest(vectors, asked.where("wanted = ''"), k, dims)
    bound = asked.where((F.col("wanted") != "") & (F.size("vector") == dims)).select("query_id", "vector", "wanted")
    blank = F.coalesce("session_id", F.lit(""))
    sized = vectors.where(F.size("embedding") == dims)
    pairs = sized.withColumn("wanted", blank).join(bound, "wanted")
    scored = pairs.select("query_id", F.col("ident").alias("vec_id"), F.round(cosine("vector", "embedding"), knn.SIM_DIGITS).alias("similarity"))
    if admit_blank:
        scored = scored.unionByName(knn.knn(sized.where(blank == ""), bound, k, dims, "ident").select("query_id", "vec_id", "similarity"))
    best = top_per_group(scored, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)
    return anywhere.unionByName(best.select("query_id", F.col("vec_id").alias("id"), F.col("similarity").alias("score"), "rank"))


def fused(text_hits: DataFrame, vector_hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): both lists (query_id, id, score, rank) fused where a request has vector hits, else its text hits."""
    both = fusion.legs(text_hits, vector_hits).withColumn("key", F.col("id"))
    return fusion.hybrid(both, limit).select("query_id", "id", "score", "rank")
