"""The segmented text index: increments, removal, compaction, skipped blocks."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contextmill.operators import lexical, posting_blocks as pb
from contextmill.sources.text_index import TextSegments

DOC = "scope string, unit string, version timestamp_ntz, doc long, text string"
T = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def corpus(seed, n, start=0, vocabulary=60):
    r = random.Random(seed)
    words = [f"{r.choice('abcde')}{r.choice('xyz')}{i}" for i in range(vocabulary)]
    return [(start + i, " ".join(words[min(int(r.expovariate(0.09)), vocabulary - 1)] for _ in range(r.randrange(0, 40)))) for i in range(n)]


def rows(spark, docs, version, units=7, scope="p"):
    return spark.createDataFrame([(scope, f"f{i % units}", version, i, t) for i, t in docs], DOC)


def answers(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def full(spark, docs, req, limit):
    return answers(lexical.bm25_search(spark.createDataFrame(docs, "id long, text string"), req, "id", F.col("text"), limit))


@pytest.fixture
def asked(spark):
    texts = ["ax by", "a", "cz1 cz2 ex d", "ax1 ax1 bz", "nothing", "e" + "x" * 40, "cx3", "b c d e"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_batches_reindex_and_delete_equal_a_full_search(spark, tmp_path, asked):
    index = TextSegments(spark, str(tmp_path / "ix"), home_docs=20, block_rows=4)
    assert index.search(asked, 5).count() == 0
    one, two = corpus(1, 150), corpus(2, 120, 150) + [(500, "e" + "x" * 45), (501, "É ax1 ÀX")]
    index.apply(rows(spark, one, T[0]))
    index.apply(rows(spark, two, T[1], units=5).withColumn("unit", F.concat(F.lit("g"), "unit")))
    for limit in (3, 1000):
        assert answers(index.search(asked, limit)) == full(spark, one + two, asked, limit)
    # unit f3 gets a new version with other documents, unit f5 goes
    again = [(i, t + " cz1 ax9") for i, t in one if i % 7 == 3][:10]
    gone = [x for x in one if x[0] % 7 in (3, 5)]
    index.apply(rows(spark, again, T[2]), rows(spark, gone, T[0]))
    now = [x for x in one if x not in gone] + again + two
    before = index.snapshot()
    assert answers(index.search(asked, 3)) == full(spark, now, asked, 3)
    # compaction: the same answers from one segment; a reader that began before sees what it saw, also after later batches
    index.compact()
    assert len(index.segments()) == 1 and index.snapshot().dead.count() == 0
    index.apply(None, rows(spark, [x for x in two if x[0] % 5 == 0], T[1], units=5).withColumn("unit", F.concat(F.lit("g"), "unit")))
    assert answers(pb.BlockSearch(before, asked, 10).hits()) == full(spark, now, asked, 10)
    assert answers(index.search(asked, 10)) == full(spark, [x for x in now if not (x in two and x[0] % 5 == 0)], asked, 10)
    assert len(index.vacuum()) == 3
    assert answers(index.search(asked, 10)) == full(spark, [x for x in now if not (x in two and x[0] % 5 == 0)], asked, 10)


def test_a_failed_batch_is_not_seen(spark, tmp_path, asked, monkeypatch):
    index = TextSegments(spark, str(tmp_path / "ix"))
    docs = corpus(3, 60)
    index.apply(rows(spark, docs, T[0]))
    monkeypatch.setattr(TextSegments, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.apply(rows(spark, corpus(4, 50, 100), T[1]), rows(spark, docs, T[0]))
    assert answers(index.search(asked, 10)) == full(spark, docs, asked, 10)


def test_scopes_and_allowed_documents(spark, tmp_path, asked):
    index = TextSegments(spark, str(tmp_path / "ix"), home_docs=16, block_rows=4)
    one, two = corpus(5, 80), corpus(6, 80, 100)
    index.apply(rows(spark, one, T[0], scope="/a").unionByName(rows(spark, two, T[0], scope="/b")))
    assert answers(index.search(asked, 10, ["/b"])) == full(spark, two, asked, 10)
    assert answers(index.search(asked, 10, ["/a", "/b"])) == full(spark, one + two, asked, 10)
    allowed = spark.createDataFrame([(i,) for i, _ in one if i % 3 == 0], "doc long")
    want = [x for x in full(spark, one, asked, 1000) if x[2] % 3 == 0]
    got = answers(index.search(asked, 1000, ["/a"], allowed))
    assert [(q, d, s) for q, _, d, s in got] == [(q, d, s) for q, _, d, s in want]


def test_blocks_below_the_kth_score_are_not_read(spark, tmp_path):
    r, common = random.Random(8), ["the", "and", "of"]
    docs = [(i, " ".join(r.choice(common) for _ in range(r.randrange(20, 60))) + (f" rare{i % 40}" if i < 400 else "")) for i in range(3000)]
    index = TextSegments(spark, str(tmp_path / "ix"), home_docs=20, block_rows=8)
    index.apply(rows(spark, docs, T[0]))
    req = spark.createDataFrame([(0, "the rare7"), (1, "rare17 of rare25")], "query_id long, text string")
    search = pb.BlockSearch(index.snapshot(), req, 5)
    assert answers(search.hits()) == full(spark, docs, req, 5)
    read, every = search.postings_read()
    assert 0 < read < 0.25 * every


def test_a_wide_batch_opens_every_posting_once(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(pb, "MAX_PUSHED_PREFIXES", 3)
    monkeypatch.setattr(pb, "WIDE_TOKENS", 300)
    old, docs = corpus(21, 40), corpus(22, 120)
    index = TextSegments(spark, str(tmp_path / "ix"), home_docs=20, block_rows=8)
    index.apply(rows(spark, old, T[0], units=50).unionByName(rows(spark, docs[40:], T[0], units=200)))
    index.apply(rows(spark, docs[:40], T[1], units=50), rows(spark, old, T[0], units=50))
    search = pb.BlockSearch(index.snapshot(), asked, 5)
    found = search.hits()
    assert answers(found) == full(spark, docs, asked, 5)
    # before, a row per request and block was joined with the postings; now groups of documents answer all requests
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "max_tf" not in plan


def test_blocks_are_written_as_they_were_dealt(spark, tmp_path, monkeypatch):
    plans, index = [], TextSegments(spark, str(tmp_path / "ix"), home_docs=20, block_rows=8)
    plain = index._write
    monkeypatch.setattr(index, "_write", lambda segment, part, df: (plans.append((part, df._jdf.queryExecution().executedPlan().toString())), plain(segment, part, df)))
    index.apply(rows(spark, corpus(23, 60), T[0]))
    plan = dict(plans)["blocks"].split("InMemoryTableScan")[0]
    # before, ranges were sampled first, for which every block was made once more
    assert "rangepartitioning" not in plan and plan.count("Exchange") == 1


def test_only_texts_move_and_only_to_their_home(spark, tmp_path, monkeypatch):
    plans, index = [], TextSegments(spark, str(tmp_path / "ix"), home_docs=20, block_rows=8)
    plain = index._write
    monkeypatch.setattr(index, "_write", lambda segment, part, df: (plans.append((part, df._jdf.queryExecution().executedPlan().toString())), plain(segment, part, df)))
    docs = corpus(24, 60)
    index.apply(rows(spark, docs, T[0]))
    index.apply(rows(spark, corpus(25, 60, 100), T[1]), rows(spark, docs[:20], T[0]))
    for part, plan in plans:
        # before, every posting was shuffled with its unit and version, and texts of later batches met the held versions first
        assert "Window" not in plan and "InMemoryTableScan" not in plan
        if part in ("blocks", "ended"):
            assert plan.count("Exchange") <= 1 and "Exchange hashpartitioning(term" not in plan


def test_prefixes_of_a_home_are_counted_once_per_document():
    r = random.Random(26)
    words = ["".join(r.choice("ab\u00e9\U00010400") for _ in range(r.randrange(1, 7))) for _ in range(60)] + ["a" * 40, "a" * 41, "\u00f1"]
    docs = [[r.choice(words) for _ in range(r.randrange(0, 30))] for _ in range(80)]
    rows = pa.table({"unit": [str(i) for i in range(80)], "version": T[:1] * 80, "doc": list(range(80)), "text": [" " + " ".join(d) + " " * (i % 2) for i, d in enumerate(docs)]})
    home = pb.Home.of_texts(rows)
    many, df = home.prefix_counts()
    terms, found, at = home.terms.to_pylist(), {}, 0
    for term, n in zip(terms, many):
        for size in range(min(len(term), pb.PREFIX_LENGTH) - n + 1, min(len(term), pb.PREFIX_LENGTH) + 1):
            assert term[:size] not in found
            found[term[:size]], at = df[at], at + 1
    want = {}
    for d in docs:
        for p in {w[:n] for w in d for n in range(1, min(len(w), pb.PREFIX_LENGTH) + 1)}:
            want[p] = want.get(p, 0) + 1
    assert terms == sorted({w for d in docs for w in d}) and found == want and at == len(df)
    assert sorted(zip(home.term, home.slot, home.tf)) == sorted(
        (terms.index(w), home.first.tolist().index(i), d.count(w)) for i, d in enumerate(docs) for w in set(d))


@pytest.mark.parametrize("pinned", [1000, 0])
def test_a_document_of_several_segments_is_scored_whole(spark, tmp_path, asked, monkeypatch, pinned):
    monkeypatch.setattr(pb, "MAX_PUSHED_PREFIXES", 3)
    monkeypatch.setattr(pb, "MAX_PINNED_ROWS", pinned)
    one, two = corpus(27, 50), [(i, t + " ax1 cz2") for i, t in corpus(28, 10, 45)]
    index = TextSegments(spark, str(tmp_path / "ix"), home_docs=10, block_rows=8)
    index.apply(rows(spark, one + one[:3], T[0]))
    index.apply(rows(spark, two, T[1]).withColumn("unit", F.concat(F.lit("g"), "unit")))
    assert answers(index.search(asked, 7)) == full(spark, one + one[:3] + two, asked, 7)


def test_a_wide_batch_may_find_nothing(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(pb, "MAX_PUSHED_PREFIXES", 3)
    index = TextSegments(spark, str(tmp_path / "ix"))
    for i, text in enumerate(["", "...", "other words", None]):
        index.apply(rows(spark, [(i, text)], T[i]))
    assert index.search(asked, 5).count() == 0 and index.units().count() == 4


def test_search_reads_no_texts_and_prunes_terms(spark, tmp_path):
    index = TextSegments(spark, str(tmp_path / "ix"))
    index.apply(rows(spark, corpus(9, 50), T[0]))
    search = pb.BlockSearch(index.snapshot(), spark.createDataFrame([(0, "ax1")], "query_id long, text string"), 5)
    plan = search.hits()._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,ax1)" in plan and "text:string" not in plan
    bounds = search.candidates._jdf.queryExecution().executedPlan().toString()
    assert "max_tf:int" in bounds and "entries" not in bounds


def test_a_repeated_batch_counts_once(spark, tmp_path, asked):
    index, docs = TextSegments(spark, str(tmp_path / "ix")), corpus(11, 60)
    for _ in range(2):
        index.apply(rows(spark, docs, T[0]))
    gone = [x for x in docs if x[0] % 7 == 2]
    for _ in range(2):
        index.apply(None, rows(spark, gone, T[0]))
    assert answers(index.search(asked, 10)) == full(spark, [x for x in docs if x not in gone], asked, 10)


def test_tools_read_the_index(spark, tmp_path):
    from contextmill.api import ContextEngine
    from contextmill.sources.embedders import HashingEmbedder
    from contextmill.sources.store import Store

    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.py").write_text("def login_user(name):\n    return name\n")
    (root / "b.py").write_text("def login_other():\n    return 1\n")
    engine = ContextEngine(spark, Store(spark, str(tmp_path / "store")), lambda: HashingEmbedder(8), 8)
    engine.index_files(str(root), str(root))
    found = lambda q, **more: {r["name"] for r in engine.get_context_capsule(q, str(root), **more).collect()}
    assert found("login") == {"login_user", "login_other"} and found("ogin_us") == {"login_user"}
    (root / "b.py").write_text("def logout_now():\n    return 1\n")
    engine.index_files(str(root), str(root))
    assert found("login") == {"login_user"} and found("logout") == {"logout_now"} and len(engine.store.text("code").segments()) == 2
    engine.compact_text()
    assert len(engine.store.text("code").segments()) == 1 and found("logout", kinds="function") == {"logout_now"}
    # an index that was lost is built again from the tables
    engine.store.root, old = str(tmp_path / "copy"), engine.store.root
    for name in ("symbols", "indexed_files"):
        spark.read.parquet(f"{old}/{name}").write.parquet(f"{engine.store.root}/{name}")
    assert found("logout", kinds="type") == set()
    engine.store.refresh_text("code")
    assert found("login") == {"login_user"}
