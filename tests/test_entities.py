"""Vectors of documents, notes and memory: keys, backlog, fusion, the tools that use them."""

import pytest
from pyspark.sql import functions as F

from contextmill.api import ContextEngine
from contextmill.operators import entities
from contextmill.sources.embedders import HashingEmbedder
from contextmill.sources.store import Store


def test_keys(spark):
    row = spark.range(1).select(*[entities.entity_id(k, entities.entity_key(k, F.lit("a:b"))).alias(k) for k in entities.KEYS],
                                entities.entity_id("note", F.lit("mem:x")).alias("other")).first()
    assert row["doc"] == row["note"] == row["memory"] == "a:b" and row["other"] is None


def test_sessions(spark):
    vectors = spark.createDataFrame([("a", "s", [1.0, 0.0]), ("b", "t", [1.0, 0.0]), ("c", "", [0.9, 0.1]), ("d", "s", [0.0, 1.0]), ("e", "s", [1.0])],
                                    "ident string, session_id string, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0], "s"), (1, [1.0, 0.0], ""), (2, [1.0, 0.0], None), (3, None, "s")], "query_id long, vector array<float>, session_id string")
    def got(**more):
        return sorted((r["query_id"], r["rank"], r["id"]) for r in entities.nearest_in_session(vectors, asked, 3, 2, **more).collect())
    anywhere = [(q, n, i) for q in (1, 2) for n, i in ((1, "a"), (2, "b"), (3, "c"))]
    assert got() == [(0, 1, "a"), (0, 2, "d"), *anywhere]
    assert got(admit_blank=True) == [(0, 1, "a"), (0, 2, "c"), (0, 3, "d"), *anywhere]


class Topics:
    """Texts of one topic share a vector although they share no word."""

    dims = 4

    def embed(self, texts):
        import numpy as np
        return np.array([[1.0, 0, 0, 0] if any(w in t.lower() for w in ("car", "vehicle", "engine")) else [0, 1.0, 0, 0] for t in texts], dtype=np.float32)


def test_tools_find_by_vector(spark, tmp_path):
    engine = ContextEngine(spark, Store(spark, str(tmp_path / "store")), Topics, 4)
    body = "# Vehicles\nAbout driving.\n\n# Bread\nAbout baking.\n"
    engine.fetch_doc("Guide", "markdown", "http://x.test/g.md", fetch=lambda url: body)
    engine.store_context(spark.createDataFrame([("s", "an engine is loud", 0), ("s", "bread is soft", 1), ("t", "vehicle tax", 2)], "session_id string, content string, pos long"))
    engine.store_memory(spark.createDataFrame([("fact", "s", "vehicle", "has", "wheels"), ("fact", "s", "bread", "has", "crust")],
                                              "kind string, session_id string, subject string, predicate string, object string"))
    assert engine.search_docs("car").count() == 0
    engine.embed_missing(kinds=("doc", "note", "memory"))
    vectors = engine.store.read("vectors")
    assert {r["doc_type"]: r["count"] for r in vectors.groupBy("doc_type").count().collect()} == {"doc": 2, "note": 3, "memory": 2}
    engine.embed_missing(kinds=("doc", "note", "memory"))
    assert engine.store.read("vectors").count() == 7
    assert engine.search_docs("car").orderBy("rank").first()["title"] == "Vehicles"
    assert engine.search_docs("baking").orderBy("rank").first()["title"] == "Bread"
    assert engine.search_context("car", "s").orderBy("rank").first()["content"] == "an engine is loud"
    assert engine.search_context("car", "t").count() == 1
    assert engine.recall_memory("car", "s", limit=1).first()["line"] == "vehicle has wheels" or engine.recall_memory("car", "s", limit=2).count() == 2
    # a changed text has no vector until the next pass
    engine.fetch_doc("Guide", "markdown", "http://x.test/g.md", force_refresh=True, fetch=lambda url: body.replace("driving", "racing"))
    assert entities.missing("doc", engine._embeddable("doc"), engine.store.read("vectors")).count() == 1
