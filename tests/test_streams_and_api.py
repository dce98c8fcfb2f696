"""Streams against their batch twins, and the library facade end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contextmill.api import TOOLS, ContextEngine, visible_tools
from contextmill.operators import changes
from contextmill.sources.embedders import HashingEmbedder
from contextmill.sources.files import log_tail, source_files
from contextmill.sources.store import Store
from contextmill.streaming import changes as streams
from contextmill.streaming.sinks import append_sink, index_stream, split_late


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_debounce_stream_equals_batch(spark, tmp_path):
    t0, rows, at = dt.datetime(2024, 1, 1), [], 0
    for i, gap in enumerate([0, 100, 200, 700, 499, 501, 10, 3000, 400, 400, 400]):
        at += gap
        rows.append((i, "/a" if i % 3 else "/b", "remove" if i == 6 else "write", t0 + dt.timedelta(milliseconds=at)))
    # a late, far row moves the watermark past every burst
    flush = [(99, "/z", "write", t0 + dt.timedelta(days=1))]
    schema = "id long, path string, event string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(flush, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["path"], r["last_ts"]): r["event"] for r in run(streams.debounced(src), "bursts", tmp_path).collect()}
    batch = changes.debounce(spark.createDataFrame(rows, schema), ["path"], "ts", "id", 0.5)
    assert got == {(r["path"], r["ts"]): r["event"] for r in batch.collect()}


def test_session_dedup_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", "f", "n", 1, t), ("s", "f", "n", 1, t), ("s", "f", "n", 2, t), ("u", "f", "n", 1, t)]
    schema = "session_id string, file string, name string, start_line int, returned_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert run(streams.first_returns(src), "firsts", tmp_path).count() == 3


def test_throughput_stream_equals_batch(spark, tmp_path, sf_dir):
    from contextmill.operators.usage import sliding_throughput
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("timestamp timestamp").parquet(str(tmp_path / "in"))
    live = run(streams.throughput(src), "rates", tmp_path, "complete")
    batch = sliding_throughput(events)
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_log_sink_and_late_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, tool_name string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("id long, tool_name string").parquet(str(tmp_path / "in"))
    append_sink(src, store, "queries", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {r["id"] for r in store.read("queries").collect()} == {1, 2}
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 3),)], "ts timestamp")
    good, late = split_late(rows, "ts", F.lit("2024-01-02").cast("timestamp"))
    assert good.count() == late.count() == 1


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    (root / "vendor").mkdir(parents=True)
    (root / "pkg2").mkdir()
    (root / "auth.py").write_text('import os\n\ndef login_user(name):\n    """Log a user in."""\n    return name\n\ndef logout_user(name):\n    if name:\n        return None\n')
    (root / "pkg2" / "main.go").write_text('package main\n\nimport "proj/auth.py"\n\nfunc Main() {\n\tprintln("login")\n}\n')
    (root / "vendor" / "x.py").write_text("def hidden(): pass\n")
    (root / "notes.txt").write_text("plain text about login\n")
    return root


def test_index_stream(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    stream = streams.file_stream(spark, str(tree), str(tree)).where(F.endswith("file", F.lit(".py")))
    index_stream(stream, store, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {"login_user", "logout_user"} <= {r["name"] for r in store.symbols().collect()}


def test_engine(spark, tree, tmp_path):
    root = str(tree)
    engine = ContextEngine(spark, Store(spark, str(tmp_path / "store")), lambda: HashingEmbedder(32), 32)
    assert {r["file"][len(root) + 1:] for r in source_files(spark, root, root).collect()} == {"auth.py", "pkg2/main.go"}
    engine.index_files(root, root)
    engine.embed_missing()
    status = engine.index_status(root).first()
    assert (status["own_nodes"], status["total_files"]) == (3, 2) and engine.index_status().first()["total_nodes"] == 3
    assert {r["status"] for r in engine.reconcile(root, root).collect()} == {"unchanged"}

    packed = engine.get_context_capsule("login user", root, session_id="s1").orderBy("rank").collect()
    assert packed[0]["name"] == "login_user" and packed[0]["effective_mode"] == "full" and "Log a user in" in packed[0]["payload"]
    engine.log_returned(engine.get_context_capsule("login user", root, session_id="s1", kinds="function"), "s1")
    assert engine.get_context_capsule("login user", root, session_id="s1").where("sent").count() == 0
    assert engine.search_semantic("login user", root, language="python").orderBy("rank").first()["name"] == "login_user"
    assert engine.get_context_capsule("login", root, path_prefix="pkg2").select("name").distinct().collect() == [("Main",)]
    assert engine.get_file_context(f"{root}/auth.py", root, mode="auto").where("sent AND effective_mode = 'full'").count() == 2

    engine.cache_summary(f"{root}/auth.py", "logs users in", root, "login_user")
    got = {r["name"]: r["payload"] for r in engine.get_file_context(f"{root}/auth.py", root, mode="summary").collect()}
    assert '"summary":"logs users in"' in got["login_user"] and '"_fallback":"skeleton"' in got["logout_user"]

    assert [r["file"] for r in engine.get_impact_graph("login_user", root).collect()] == ["pkg2/main.go"]
    assert engine.analyze_dead_code(root).count() == 3 and engine.analyze_complexity(root, 2).first()["name"] == "logout_user"
    assert {r["directory"] for r in engine.get_project_map(root, 1).collect()} == {".", "pkg2"}

    body = "# Login\nHow to login a user.\n"
    chunks = engine.fetch_doc("Auth", "markdown", "http://x.test/auth.md", fetch=lambda url: body)
    assert [(r["title"], r["path"]) for r in chunks.collect()] == [("Login", "/auth.md")]
    assert engine.search_docs("logi").first()["title"] == "Login"
    calls = []
    engine.fetch_doc("Auth", "markdown", "http://x.test/auth.md", fetch=lambda url: calls.append(url) or "")
    assert engine.search_docs("logi").count() == 1

    text = engine.retrieve("login user", root, session_id="s2").first()
    assert "login_user" in text["context"] and "Login" in text["context"] and text["doc_results"] == 1
    fact = spark.createDataFrame([("fact", "s2", "login", "needs", "a name")], "kind string, session_id string, subject string, predicate string, object string")
    engine.store_memory(fact)
    with_memory = engine.retrieve("login user", root, session_id="s2", include_memory=True, format="xml").first()
    assert with_memory["context"].startswith("## Agent memory\n- login needs a name") and with_memory["memory_lines"] == 1
    assert engine.recall_memory("login", "s2").count() == 1 and engine.recall_memory("login", "other").count() == 0
    assert engine.forget_memory(subject="login", predicate="needs", session_id="s2").first()["invalidated_refs"] == 1
    assert engine.recall_memory("login", "s2").count() == 0

    new = spark.createDataFrame([("s2", "hello " * 100, 0), ("s2", "FACT: a | b | c", 1)], "session_id string, content string, pos long")
    assert engine.store_context(new, extract_memory=True).where("admitted").count() == 2
    # the greeting counts as a three-word fact
    assert engine.recall_memory("", "s2").count() == 2
    refs = [r["ref"] for r in engine.list_context("s2").collect()]
    assert len(refs) == 2 and all(r.startswith("ctx_") for r in refs)
    assert engine.fetch_context(refs, "other").count() == 0
    engine.record_access(engine.fetch_context(refs[:1], "s2"), "fetch_context", "quality")
    assert engine.store.notes().agg(F.sum("access_count")).first()[0] == 1
    assert engine.search_context("hell", "s2").count() == 1
    assert engine.flush_context("s2").first()["flushed_refs"] == 2 and engine.list_context("s2").count() == 0

    engine.export_bundle(root, str(tmp_path / "bundle"))
    copy = Store(spark, str(tmp_path / "copy"))
    copy.import_bundle(str(tmp_path / "bundle"))
    assert copy.symbols().count() == 3
    # re-indexing replaces a file's rows
    (tree / "auth.py").write_text("def only():\n    pass\n")
    engine.index_files(root, root)
    assert {r["name"] for r in engine.store.symbols().collect()} == {"only", "Main"}
    engine.reset_project(root)
    assert engine.store.symbols().count() == 0


def test_log_tail(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("".join(f"2024/01/02 03:04:05 line {i}\n" for i in range(700)))
    got = [r["message"] for r in log_tail(spark, str(path), 3).collect()]
    assert got == ["line 699", "line 698", "line 697"] and log_tail(spark, str(path), 900).count() == 500


def test_tools():
    assert len(TOOLS) == 29 and len({t for t, _ in TOOLS}) == 29
    assert "execute_code" not in visible_tools("extended") and "execute_code" in visible_tools("complete")
    assert "index_files" not in visible_tools() and "retrieve" in visible_tools("nonsense")
