"""Rewrites of stored tables: what stays, what readers see, what a late append does."""

import datetime as dt

from pyspark.sql import functions as F

from contextmill.api import ContextEngine
from contextmill.sources.store import Store

EDGE = "source_file string, target string, project_path string, version timestamp_ntz"
DAY = [dt.datetime(2024, 1, d) for d in range(1, 10)]


def manifest(spark, rows):
    return spark.createDataFrame(rows, "file string, project_path string, indexed_at timestamp_ntz")


def targets(df):
    return sorted(r["target"] for r in df.collect())


def test_compaction_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    edges = spark.createDataFrame([("a", "old", "/p", DAY[0]), ("a", "new", "/p", DAY[1]), ("b", "gone", "/p", DAY[0]), ("c", "early", "/q", DAY[2])], EDGE)
    store.append("edges", edges)
    store.append("indexed_files", manifest(spark, [("a", "/p", DAY[0]), ("a", "/p", DAY[1]), ("b", "/p", DAY[0]), ("b", "/p", DAY[1])]))
    reader = store.read("edges")
    assert store.compact(("edges", "indexed_files")) == {"edges": True, "indexed_files": True}
    # the reader keeps its version; rows without a manifest yet are no leftovers
    assert targets(reader) == ["early", "gone", "new", "old"]
    assert targets(store.read("edges")) == ["early", "new"] and store.read("indexed_files").count() == 2
    store.append("edges", spark.createDataFrame([("d", "after", "/q", DAY[3])], EDGE))
    assert targets(store.read("edges")) == ["after", "early", "new"] and targets(store.read("edges").where("project_path = '/q'")) == ["after", "early"]
    assert store.compact(("edges",)) == {"edges": True}
    held = store.read("edges")
    store.vacuum()
    assert targets(held) == targets(store.read("edges")) == ["after", "early", "new"]


def test_late_and_concurrent_appends(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = spark.createDataFrame([("a", "x", "/p", DAY[0])], EDGE)
    store.append("edges", row)
    late = store.generations("edges").append_path()

    def with_late_append(rows):
        store._writer("edges", row.withColumn("target", F.lit("late")), "append").parquet(late)
        return rows.where("target <> 'x'")

    assert not store.rewrite("edges", with_late_append)
    assert targets(store.read("edges")) == ["late", "x"]

    def with_new_append(rows):
        store.append("edges", row.withColumn("target", F.lit("beside")))
        return rows.where("target <> 'x'")

    assert store.rewrite("edges", with_new_append)
    assert targets(store.read("edges")) == ["beside", "late"]


def test_empty_table_and_everything_removed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.rewrite("edges", lambda rows: rows) and store.read("edges").count() == 0
    store.append("edges", spark.createDataFrame([("a", "x", "/p", DAY[0])], EDGE))
    assert store.rewrite("edges", lambda rows: rows.where("false")) and store.read("edges").count() == 0
    store.append("edges", spark.createDataFrame([("a", "y", "/p", DAY[0])], EDGE))
    assert targets(store.read("edges")) == ["y"]


def test_links_reset_and_expiry(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    (tree / "a.py").write_text("def outer_one(): pass\n")
    (tree / "sub" / "b.py").write_text("def inner_two(): pass\n")
    engine = ContextEngine(spark, Store(spark, str(tmp_path / "store")))
    root, sub = str(tree), str(tree / "sub")
    engine.index_files(root, root)
    engine.index_files(sub, sub)
    assert engine.store.symbols().count() == 3
    assert [tuple(r)[:2] for r in engine.auto_link().collect()] == [(root, sub)]
    assert sorted((r["project_path"], r["name"]) for r in engine.store.read("symbols").collect()) == [(root, "outer_one"), (sub, "inner_two")]
    found = engine.store.text("code").search(spark.createDataFrame([(1, "inner")], "query_id long, text string"), 5)
    assert found.count() == 1
    engine.compact()
    engine.reset_project(sub)
    assert {r["project_path"] for t in ("symbols", "indexed_files", "edges") for r in engine.store.read(t).collect()} == {root}
    calls = spark.createDataFrame([(1, DAY[0]), (2, None), (3, dt.datetime(2100, 1, 1))], "id long, timestamp timestamp_ntz")
    engine.store.append("queries", calls)
    assert engine.expire_queries() and sorted(r["id"] for r in engine.store.read("queries").collect()) == [2, 3]
