import json
import re

import __spark_entry__ as entry
from contextmill.llm.tool_calls import SCHEMAS, calls_of_conversations, levels, link_tool_calls

from .helpers import clashing

CALL = "conv_id long, turn long, call_id string, tool string, arguments string"


def tables(spark, calls, results=(), needs=()):
    return (clashing(spark.createDataFrame(list(calls), CALL)), clashing(spark.createDataFrame(list(results), "conv_id long, turn long, call_id string, content string")),
            clashing(spark.createDataFrame(list(needs), "conv_id long, call_id string, needed string")))


def test_statuses_problems_and_json(spark):
    calls = [(1, 0, "a", "answer", '{"turn": 1, "prompt": "é\\"\\n"}'), (1, 1, "b", "answer", '{"prompt": 5, "more": {"z": 1, "y": [2]}}'), (1, 2, "a", "answer", "{}"),
             (1, 3, "c", "nobody", "[1]"), (1, 4, "d", "configure", "not json"), (1, 5, "e", None, None), (None, 6, "f", "configure", '{"rules": ""}'), (1, 7, None, "configure", '{"rules": "r"}')]
    results = [(1, 9, "a", "late"), (1, 8, "a", "first"), (2, 1, "a", "other"), (1, 1, "b", None), (None, 7, "f", "x")]
    got = {(r.conv_id, r.turn): r for r in link_tool_calls(*tables(spark, calls, results), SCHEMAS).collect()}
    assert {k: r.status for k, r in got.items()} == {
        (1, 0): "linked", (1, 1): "linked", (1, 2): "repeated", (1, 3): "unanswered", (1, 4): "unanswered", (1, 5): "unanswered", (None, 6): "unanswered", (1, 7): "unanswered",
        (1, 9): "orphan", (2, 1): "orphan", (None, 7): "orphan"}
    assert got[1, 0].json == '{"arguments":{"prompt":"é\\"\\n","turn":1},"id":"a","result":"first","tool":"answer"}' and got[1, 0].problems == []
    assert got[1, 1].problems == ["more is unknown", "prompt is not string", "turn is missing"]
    assert json.loads(got[1, 1].json)["arguments"] == {"more": {"y": [2], "z": 1}, "prompt": 5}
    assert got[1, 3].problems == ["unknown tool nobody"] and got[1, 4].problems == ["not an object"] and got[1, 5].problems == ["unknown tool null"]
    assert len(got) == len(calls) + 3


def test_levels(spark):
    calls, _, _ = tables(spark, [(1, i, x, "answer", "{}") for i, x in enumerate("abcdefg")])
    needs = [(1, "b", "a"), (1, "c", "a"), (1, "c", "b"), (1, "d", "gone"), (1, "e", "f"), (1, "f", "e"), (1, "g", "f"), (2, "a", "b"), (1, "b", "a")]
    got = {r.call_id: r.level for r in levels(calls, spark.createDataFrame(needs, "conv_id long, call_id string, needed string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": None}


def test_conversations_with_odd_rows(spark):
    chats = spark.createDataFrame([(1, 0, "system", None), (1, 1, "user", ""), (1, 2, "assistant", None), (1, 3, "user", "q"), (1, 3, "user", "q"), (1, 5, "assistant", "lost"), (2, 0, None, "x"),
                                   (3, None, "user", "x"), (None, 0, "user", "y" * 100_000)], "conv_id long, turn long, role string, text string")
    got = link_tool_calls(*calls_of_conversations(clashing(chats)), SCHEMAS).collect()
    assert sorted(r.status for r in got) == ["linked", "orphan", "repeated", "unanswered", "unanswered", "unanswered", "unanswered"]
    assert link_tool_calls(*calls_of_conversations(chats.limit(0)), SCHEMAS).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = entry.queries()["op6_tool_calls"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_levels_of_random_graphs(spark):
    import random

    r = random.Random(5)
    needs, want = [], {}
    for conv in range(12):
        size = 25
        edges = {i: {j for j in range(i) if r.random() < (0.06 if conv % 2 else 0.02) or j == i - 1 and r.random() < 0.8} for i in range(size)}
        if conv == 3:
            edges[4].add(9)
        level = {}
        for _ in range(size):
            level.update({i: max((level[j] + 1 for j in e), default=0) for i, e in edges.items() if i not in level and all(j in level for j in e)})
        want |= {(conv, f"c{i}"): level.get(i) for i in range(size)}
        needs += [(conv, f"c{i}", f"c{j}") for i, e in edges.items() for j in e]
    calls = spark.createDataFrame(list(want), "conv_id long, call_id string")
    got = levels(calls, spark.createDataFrame(needs, "conv_id long, call_id string, needed string")).collect()
    assert {(x.conv_id, x.call_id): x.level for x in got} == want and len(got) == len(want)
