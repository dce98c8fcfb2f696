"""Search operators on small inputs, against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from contextmill.functions.vectors import cosine, decode_float32
from contextmill.operators import graph, knn, lexical, scripts


def brute_bm25(docs, query):
    toks = {i: t.lower().split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for q in query.lower().split():
        f = {i: sum(w.startswith(q) for w in ws) for i, ws in toks.items()}
        f = {i: c for i, c in f.items() if c}
        idf = max(math.log((n - len(f) + 0.5) / (len(f) + 0.5)), 1e-6)
        for i, c in f.items():
            out[i] = out.get(i, 0) + idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(toks[i]) / avg))
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "alpine", "beta", "bet", "gamma", "delta", "al"]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(50)]


def test_bm25_scan_and_index(spark, tmp_path):
    docs, asks = corpus(), [(0, "alp bet"), (1, "gamma gamma zzz"), (2, "nothing")]
    df = spark.createDataFrame(docs, "id long, text string")
    req = spark.createDataFrame(asks, "query_id long, text string")
    index = lexical.TextIndex.build(df, "id", F.col("text"))
    index.write(str(tmp_path / "ix"), 4)
    stored = lexical.TextIndex.read(spark, str(tmp_path / "ix"))
    for found in (lexical.bm25_search(df, req, "id", F.col("text"), 1000), lexical.bm25_search_index(stored, req, 1000)):
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
        for q, text in asks:
            want = {i: round(s, 9) for i, s in brute_bm25(docs, text).items()}
            assert got.get(q, {}) == want


def test_index_lookup_prunes_by_prefix(spark, tmp_path):
    df = spark.createDataFrame(corpus(), "id long, text string")
    lexical.TextIndex.build(df, "id", F.col("text")).write(str(tmp_path / "ix"))
    stored = lexical.TextIndex.read(spark, str(tmp_path / "ix"))
    req = spark.createDataFrame([(0, "alp")], "query_id long, text string")
    plan = lexical.bm25_search_index(stored, req)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,alp)" in plan


def test_many_requests_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_PINNED_ROWS", 1)
    docs = corpus(2)
    df, req = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(0, "alp bet"), (1, "del")], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.bm25_search(df, req, "id", F.col("text"), 1000).collect()}
    want = {(q, i): round(s, 9) for q, t in ((0, "alp bet"), (1, "del")) for i, s in brute_bm25(docs, t).items()}
    assert got == want


def test_knn(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    vecs = rnd.normal(size=(300, 8)).astype(np.float32)
    vecs[7] = 0
    vecs[100:120] = vecs[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(999, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asks = spark.createDataFrame([(q, [float(x) for x in vecs[q]]) for q in (7, 50, 3)], "query_id long, vector array<float>")
    monkeypatch.setattr(knn, "MAX_MATRIX_BYTES", 8 * 8 * 2)  # two requests per pass
    got = {}
    for r in knn.knn(df, asks, 12, 8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
    for q in (7, 50, 3):
        a = vecs.astype(np.float64)
        norms = np.linalg.norm(a, axis=1) * np.linalg.norm(a[q])
        sims = np.divide(a @ a[q], norms, out=np.zeros(len(a)), where=norms > 0)
        want = sorted(((i, round(s, 9) + 0.0) for i, s in enumerate(sims)), key=lambda t: (-t[1], t[0]))[:12]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want])


def test_cosine_and_blob(spark):
    import struct
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], bytearray(struct.pack("<2f", 1.5, -2.0))), ([0.0, 0.0], [1.0, 1.0], bytearray(b"abc"))],
                               "a array<float>, b array<float>, blob binary")
    got = [(round(r[0], 6), r[1]) for r in df.select(cosine("a", "b"), decode_float32("blob")).collect()]
    assert got == [(round(1 / math.sqrt(2), 6), [1.5, -2.0]), (0.0, None)]


def test_substring_scores(spark):
    df = spark.createDataFrame([(1, "foo", "x"), (2, "foobar", "x"), (3, "afoo", "x"), (4, "z", "has foo"), (5, "z", "none")], "id long, name string, code string")
    req = spark.createDataFrame([(0, "Foo zz")], "query_id long, text string")
    got = [(r["doc_id"], r["score"]) for r in lexical.substring_search(df, req, "id", F.col("name"), [F.col("name"), F.col("code")]).orderBy("rank").collect()]
    assert got == [(1, 11.0), (2, 6.0), (3, 4.0), (4, 2.0)]


def test_contains_join_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab/_%") for _ in range(rnd.randint(0, 9))) for _ in range(120)]
    patterns = ["".join(rnd.choice("ab/_%") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    got = graph.contains_join(spark.createDataFrame([(t,) for t in set(texts)], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((t, p) for t in set(texts) for p in set(patterns) if p in t)


def test_impact_and_unused(spark):
    syms = spark.createDataFrame([("/p/db.go", "Open", "function"), ("/p/db.go", "Close", "function"), ("/p/x.go", "T", "type")], "file string, name string, kind string")
    edges = spark.createDataFrame([("/p/a.go", "lib/db.go", "import", None), ("/p/b.go", "reopen", "import", None), ("/p/b.go", "open", "import", None),
                                   ("/p/db.go", "x", "call", "Open")], "source_file string, target string, kind string, source_symbol string")
    req = spark.createDataFrame([(0, "OPEN")], "query_id long, symbol string")
    assert sorted((r["source_file"], r["target"]) for r in graph.impact(edges, syms, req).collect()) == [("/p/a.go", "lib/db.go"), ("/p/b.go", "open")]
    assert [r["name"] for r in graph.unused_symbols(syms, edges).collect()] == ["Close"]
    assert [r["name"] for r in graph.unused_symbols(syms, edges, "type").collect()] == ["T"]


def test_scripts(spark):
    rows = [(i, n, k, f, 1, 2) for i, (n, k, f) in enumerate([("Foo", "function", "a.go"), ("bar", "", "a.go"), ("_x", "type", None), ("Étoile", "type", "b.go"), ("", "type", "")])]
    df = spark.createDataFrame(rows, "pos long, name string, kind string, file string, start_line int, end_line int")
    reg = scripts.ScriptRegistry()
    assert [r["name"] for r in reg.run("exports-only", df).orderBy("pos").collect()] == ["Foo", "Étoile"]
    assert [r["pos"] for r in reg.run("dedupe-by-file", df).orderBy("pos").collect()] == [0, 2, 3]
    assert {r["kind"]: r["count"] for r in reg.run("filter-by-kind", df).collect()} == {"function": 1, "unknown": 1, "type": 3}
    assert {r["file"]: (r["count"], r["names"]) for r in reg.run("group-by-file", df).collect()} == {"a.go": (2, ["Foo", "bar"]), "?": (1, ["_x"]), "b.go": (1, ["Étoile"])}
    reg.register(scripts.Script("mine", "t", "d", lambda d: d.select("name"), 1), extends="exports-only")
    assert reg.run("mine", df).columns == ["name"]
    asks = spark.createDataFrame([(0, "retrieve", "public api surface", 6, 2, 500), (1, "other", "x", 50, 1, 1), (2, "retrieve", "auth", 12, 3, 900)],
                                 "query_id long, tool string, query string, n_results int, n_files int, data_tokens int")
    got = {}
    for r in scripts.hints(asks).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["script_id"])
    assert got == {0: ["exports-only"], 2: ["compact-symbol-list", "dedupe-by-file"]}


def test_relative_time_and_web_addresses(spark):
    from pyspark.sql import functions as F
    import pytest

    from contextmill.functions.scalars import relative_time
    from contextmill.sources.documents import fetch_bodies, http_get

    ages = [5, 30, 90, 7200, 3 * 86400, 8 * 86400]
    df = spark.createDataFrame([(a,) for a in ages], "age long").withColumn("now", F.expr("timestamp_seconds(1700000000)"))
    got = [r[0] for r in df.select(relative_time(F.expr("timestamp_seconds(1700000000 - age)"), "now")).collect()]
    assert got == ["just now", "30s ago", "1m ago", "2h ago", "3d ago", "Nov 6 22:13"]
    with pytest.raises(ValueError):
        http_get("file:///etc/hostname")
    rows = fetch_bodies(spark.createDataFrame([("1", "html", "no address"), ("2", "html", "file:///x")], "id string, type string, url string")).collect()
    assert [r["body"] for r in rows] == [None, None]


def test_request_without_prefix_hit_falls_back_to_substrings(spark):
    from contextmill.plans import capsule

    rows = [(1, "login_user", "function", "/p/a.py", "a.py.login_user", "def login_user():"), (2, "logout", "function", "/p/b.py", "b.py.logout", "def logout():")]
    syms = spark.createDataFrame(rows, "id long, name string, kind string, file string, fqn string, code string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, "ogin", None), (2, "logout", None), (3, "nowhere", None)], "query_id long, text string, vector array<float>")
    found = capsule.hybrid_search(syms, vectors, asked, 30, 4, fallback=True)
    # a request with a prefix hit keeps its prefix hits only
    assert {(r["query_id"], r["id"], r["score"] > 0) for r in found.collect()} == {(1, 1, True), (2, 2, True)}
