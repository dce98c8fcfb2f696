import datetime as dt

from pyspark.sql import functions as F

from contextmill.operators import memory

T = [dt.datetime(2024, 1, 1, h) for h in range(10)]
COLS = "ref string, kind string, scope string, session_id string, project_path string, subject string, predicate string, object string, rule string, valid_from timestamp_ntz"


def facts(spark, rows):
    return spark.createDataFrame(rows, COLS)


def fact(ref, obj, at, session="s1", subject="user.city", predicate="lives_in", scope="session"):
    return (ref, "fact", scope, session, "/p", subject, predicate, obj, None, at)


def test_extraction(spark):
    text = "FACT: user.stack | prefers | Go errs package\nRULE: Use skeleton mode first\nuser.style: compact functions\n- * a b c d\nnope x\nFACT:\n a:b \nrule:\nx | | y\n"
    got = memory.extract_entries(spark.createDataFrame([(text,)], "t string"), "t", []).orderBy("line_no").collect()
    assert [(r["kind"], r["subject"], r["predicate"], r["object"], r["rule"]) for r in got] == [
        ("fact", "user.stack", "prefers", "Go errs package", None), ("procedure", None, None, None, "Use skeleton mode first"),
        ("fact", "user.style", "is", "compact functions", None), ("fact", "a", "b", "c d", None), ("fact", "a", "is", "b", None),
        ("fact", "x", "|", "| y", None)]


def test_supersession_and_as_of(spark):
    rows = facts(spark, [fact("a", "Mumbai", T[1]), fact("b", "Bangalore", T[3]), fact("c", "Pune", T[2], "s2"),
                         fact("d", "x", T[1], None, "k", "is", "global"), fact("e", "y", T[4], "s9", "k", "is", "global")])
    got = {r["ref"]: (r["valid_until"], r["superseded_by"]) for r in memory.supersede(rows).collect()}
    assert got == {"a": (T[3], "b"), "b": (None, None), "c": (None, None), "d": (T[4], "e"), "e": (None, None)}
    at = lambda t: {r["ref"] for r in memory.supersede(rows).where(memory.valid_at(F.lit(t).cast("timestamp_ntz"))).collect()}
    assert at(T[1]) == {"a", "d"} and at(T[3]) == {"b", "c", "d"} and at(T[0]) == set()


def test_invalidate_previous_flag(spark):
    rows = facts(spark, [fact("a", "1", T[1]), fact("b", "2", T[2]), fact("c", "3", T[3])]).withColumn(
        "invalidate_previous", F.col("ref") != "b")
    got = {r["ref"]: r["superseded_by"] for r in memory.supersede(rows).collect()}
    assert got == {"a": "c", "b": "c", "c": None}


def test_tombstones(spark):
    rows = facts(spark, [fact("a", "1", T[1]), fact("b", "2", T[5])])
    gone = spark.createDataFrame([("a", T[3]), ("b", T[7])], "ref string, forgotten_at timestamp_ntz")
    got = {r["ref"]: (r["valid_until"], r["superseded_by"]) for r in memory.supersede(rows, gone).collect()}
    assert got == {"a": (T[3], None), "b": (T[7], None)}


def entries(spark, rows):
    df = memory.supersede(facts(spark, rows))
    return df.withColumns({"token_est": memory.entry_tokens(), "access_count": F.lit(0), "created_at": F.col("valid_from")})


def test_recall_budget_and_cascade(spark):
    rows = [fact(f"m{i:02d}", "x" * 21, T[1] + dt.timedelta(minutes=i), "s1", f"topic{i}") for i in range(20)]
    rows.append(("p", "procedure", "session", "s1", "/p", None, None, None, "always test", T[2]))
    df = entries(spark, rows)
    ask = lambda t: spark.createDataFrame([(0, t)], "query_id long, text string")
    got = memory.recall(df, ask("topic"), limit=20, budget=80).orderBy("rank").collect()
    assert 0 < len(got) < 20 and got[-1]["cum_tokens"] <= 80
    assert got[0]["ref"] == "m19"
    assert [r["ref"] for r in memory.recall(df, ask("lways te")).collect()] == ["p"]
    assert len(memory.recall(df, ask("topic"), budget=1).collect()) == 1
    assert len(memory.recall(df, ask(""), limit=5).collect()) == 5
    text = memory.recall_text(memory.recall(df, ask("always"))).first()
    assert text["memory_text"] == "- PROC: always test" and text["tokens_saved_est"] == 7 * text["memory_tokens"]


def test_forget_by_subject_counts_tokens(spark):
    df = entries(spark, [fact("a", "Mumbai", T[1]), fact("b", "Pune", T[1], "s2")])
    gone = memory.forget(df, F.lit(T[9]).cast("timestamp_ntz"), subject="user.city", predicate="lives_in", session_id="s1").collect()
    assert [r["ref"] for r in gone] == ["a"] and gone[0]["token_est"] > 0


def test_scope(spark):
    df = facts(spark, [fact("g", "1", T[1], None, scope="global"), fact("s", "1", T[1], "s1"), fact("o", "1", T[1], "s2"), fact("p", "1", T[1], None, scope="project")])
    refs = lambda c: {r["ref"] for r in df.where(c).collect()}
    assert refs(memory.in_scope()) == {"g", "s", "o", "p"}
    assert refs(memory.in_scope("", "s1")) == {"g", "s"} and refs(memory.in_scope("", "s1", "/p")) == {"g", "s", "p"}
    assert refs(memory.in_scope("project", "s1", "/p")) == {"p"}


def test_recall_by_vector(spark):
    """The vector stage answers where words and phrases find nothing; only entries in question compete."""
    from pyspark.sql import functions as F

    base = dict(kind="fact", scope="global", session_id=None, project_path=None, owner_id=None, subject="s", predicate="is", object="o", rule="", source="",
                access_count=0)
    rows = spark.range(1).select(*[F.lit(v).cast("long" if k == "access_count" else "string").alias(k) for k, v in base.items()])
    entries = rows.crossJoin(spark.createDataFrame([("mem_a",), ("mem_b",), ("mem_c",)], "ref string")).withColumns(
        {"created_at": F.lit("2024-01-01").cast("timestamp_ntz"), "valid_from": F.lit("2024-01-01").cast("timestamp_ntz"), "valid_until": F.lit(None).cast("timestamp_ntz")})
    entries = entries.withColumn("object", F.concat(F.lit("about "), "ref"))
    vectors = spark.createDataFrame([("mem_a", [1.0, 0.0]), ("mem_b", [0.0, 1.0]), ("gone", [1.0, 0.1])], "vec_ref string, embedding array<float>")
    asked = spark.createDataFrame([(1, "zzz", [1.0, 0.2])], "query_id long, text string, vector array<float>")
    got = memory.recall(entries, asked, limit=2, budget=1000, vectors=vectors, dims=2).collect()
    assert {r["ref"] for r in got} == {"mem_a", "mem_b"}
