"""Embedding backlog: lanes, retries, dead letters, freshness."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextmill.api import ContextEngine
from contextmill.operators import backlog
from contextmill.sources.store import Store

T0 = dt.datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_states_and_order(spark):
    missing = spark.createDataFrame([("code", u, "p", at(-1000)) for u in "abcdef"] + [("code", "x", "q", at(-2000)), ("code", "y", "q", at(-3000))],
                                    "kind string, unit string, project_path string, changed_at timestamp_ntz")
    tries = [("a", False, -10)] * 1 + [("b", False, -500), ("b", False, -400), ("b", False, -61)] + [("c", False, -n) for n in (5, 6, 7)] \
        + [("d", False, -1500)] + [("e", False, -300), ("e", True, -200), ("e", False, -100)]
    attempts = spark.createDataFrame([("code", u, "p", ok, at(s)) for u, ok, s in tries], "kind string, unit string, project_path string, ok boolean, attempted_at timestamp_ntz")
    requests = spark.createDataFrame([("code", "f", "p", 0, at(-119)), ("code", "d", "p", 0, at(-121)), ("code", "", "q", 1, at(-1))],
                                     "kind string, unit string, project_path string, lane int, requested_at timestamp_ntz")
    todo = backlog.backlog(missing, requests, attempts, F.lit(T0).cast("timestamp_ntz"), backlog.Retries(3, 30, 120))
    got = {r["unit"]: (r["lane"], r["failures"], r["state"]) for r in todo.collect()}
    assert got == {"a": (2, 1, "waiting"), "b": (2, 3, "dead"), "c": (2, 3, "dead"), "d": (2, 0, "ready"), "e": (2, 1, "ready"), "f": (0, 0, "ready"),
                   "x": (1, 0, "ready"), "y": (1, 0, "ready")}
    assert [r["unit"] for r in backlog.take(todo, 4).orderBy("lane", "changed_at", "unit").collect()] == ["f", "y", "x", "d"]
    units = missing.select("kind", "unit", "project_path")
    fresh = {r["project_path"]: (r["units"], r["missing"], r["waiting"], r["dead"], r["fresh"]) for r in backlog.freshness(units, todo).collect()}
    assert fresh == {"p": (6, 6, 1, 2, False), "q": (2, 2, 0, 0, False)}


class Fragile:
    """Refuses texts with a word on its list, which a file holds so that it can change between passes."""

    dims = 2

    def __init__(self, path):
        self.path = path

    def embed(self, texts):
        bad = open(self.path).read().split()
        if any(w in t for t in texts for w in bad):
            raise RuntimeError("refused")
        return np.ones((len(texts), 2), dtype=np.float32)


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "bad").write_text("poison")
    root = tmp_path / "proj"
    root.mkdir()
    for name in ("good", "poison", "other"):
        (root / f"{name}.py").write_text(f"def {name}_call(a):\n    return '{'x' * 120}'\n")
    path = str(tmp_path / "bad")
    made = ContextEngine(spark, Store(spark, str(tmp_path / "store")), lambda: Fragile(path), 2)
    made.index_files(str(root), str(root))
    return made, str(root), tmp_path


def test_a_failing_text_is_retried_and_then_dead(engine):
    made, root, tmp_path = engine
    rules = backlog.Retries(max_attempts=2, first_delay_seconds=0)
    assert made.embed_pass("code", rules=rules) == 3
    state = lambda: [(r["unit"].rsplit("/", 1)[1], r["failures"], r["state"]) for r in made.embed_status("code", rules).collect()]
    assert state() == [("poison.py", 1, "ready")] and made.store.read("vectors").count() == 2
    assert made.store.read("embed_attempts").where("NOT ok").first()["error"] == "RuntimeError: refused"
    assert made.embed_pass("code", rules=rules) == 1 and state() == [("poison.py", 2, "dead")]
    assert made.embed_pass("code", rules=rules) == 0
    # a new version of the file starts anew
    (tmp_path / "bad").write_text("nothing")
    made.index_files(root, root)
    assert state() == [("poison.py", 0, "ready")] and made.embed_pass("code", rules=rules) == 1 and state() == []


def test_a_scope_is_made_fresh_before_a_search(engine):
    made, root, tmp_path = engine
    got = made.ensure_fresh(root, rules=backlog.Retries(first_delay_seconds=600)).first()
    assert (got["units"], got["missing"], got["waiting"], got["fresh"]) == (3, 1, 1, False)
    (tmp_path / "bad").write_text("nothing")
    got = made.ensure_fresh(root, rules=backlog.Retries(first_delay_seconds=0)).first()
    assert (got["missing"], got["fresh"]) == (0, True) and made.store.read("embed_requests").count() == 2
