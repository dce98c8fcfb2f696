"""What is left to embed: lanes, retries after failures, dead letters, and how fresh a scope is.

There is no queue to lose: what is missing follows from the tables, and two logs say what was asked for and what was tried.
A unit (a file, a document chunk, a note, a memory entry) is ready, waiting for its next try, or dead after too many
failures since its text last changed or was last embedded. Lanes order the ready ones; a request for a unit or for a whole
project raises it for a limited time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.embedders import BATCH, Embedder

UNIT = ["kind", "unit", "project_path"]
HIGH, RAISED, NORMAL = 0, 1, 2
ATTEMPT = "struct<embedding:array<float>,error:string>"


@dataclass(frozen=True)
class Retries:
    """How often a unit is tried, how long it waits (doubling), and how long a request raises it."""

    max_attempts: int = 5
    first_delay_seconds: int = 30
    request_seconds: int = 120


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def backlog(missing: DataFrame, requests: DataFrame, attempts: DataFrame, now: Column, rules: Retries = Retries()) -> DataFrame:
    """missing (kind, unit, project_path, changed_at) with lane, failures, next_at and state (ready, waiting or dead).

    requests: kind, unit ('' for all of a project), project_path, lane, requested_at. attempts: kind, unit,
    project_path, ok, attempted_at. Both are logs; each is aggregated by its key before it is joined.
    """
    recent = requests.where(F.col("requested_at") > now - _seconds(F.lit(rules.request_seconds)))
    of_unit = recent.where("unit <> ''").groupBy(*UNIT).agg(F.min("lane").alias("unit_lane"))
    of_project = recent.where("unit = ''").groupBy("kind", "project_path").agg(F.min("lane").alias("project_lane"))
    settled = attempts.where("ok").groupBy(*UNIT).agg(F.max("attempted_at").alias("settled_at"))
    since = attempts.where("NOT ok").join(settled, UNIT, "left").join(missing.select(*UNIT, "changed_at"), UNIT)
    start = F.greatest(F.coalesce("settled_at", "changed_at"), "changed_at")
    failed = since.where(F.col("attempted_at") >= start).groupBy(*UNIT).agg(F.count("*").alias("failures"), F.max("attempted_at").alias("failed_at"))
    rows = missing.join(failed, UNIT, "left").join(of_unit, UNIT, "left").join(of_project, ["kind", "project_path"], "left")
    failures = F.coalesce("failures", F.lit(0))
    delay = F.lit(rules.first_delay_seconds) * F.pow(F.lit(2), F.least(failures, F.lit(rules.max_attempts)) - 1)
    next_at = F.when(failures > 0, F.col("failed_at") + _seconds(delay))
    state = (F.when(failures >= rules.max_attempts, "dead").when(next_at > now, "waiting").otherwise("ready"))
    lane = F.least(F.coalesce("unit_lane", F.lit(NORMAL)), F.coalesce("project_lane", F.lit(NORMAL)))
    return rows.select(*UNIT, "changed_at", lane.alias("lane"), failures.alias("failures"), next_at.alias("next_at"), state.alias("state"))


def take(todo: DataFrame, units: int | None = None) -> DataFrame:
    """The ready units of one pass: by lane, then the longest unchanged first."""
    ready = todo.where("state = 'ready'")
    return ready if units is None else ready.orderBy("lane", "changed_at", *UNIT).limit(units)


def freshness(units: DataFrame, todo: DataFrame) -> DataFrame:
    """(kind, project_path, units, missing, waiting, dead, fresh) per kind and project. Dead units do not make a scope stale:
    they will not come."""
    every = units.groupBy("kind", "project_path").agg(F.count("*").alias("units"))
    state = lambda s: F.count_if(F.col("state") == s)
    left = todo.groupBy("kind", "project_path").agg(F.count("*").alias("missing"), state("waiting").alias("waiting"), state("dead").alias("dead"))
    out = every.join(left, ["kind", "project_path"], "left").na.fill(0, ["missing", "waiting", "dead"])
    return out.withColumn("fresh", F.col("missing") == F.col("dead"))


def try_embed(make: Callable[[], Embedder], text: Column) -> Column:
    """(embedding, error) per text. A batch that fails is tried again row by row, so one bad text costs only itself."""
    @F.pandas_udf(ATTEMPT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()

        def one(texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
            try:
                found = model.embed(texts)
                if found.shape != (len(texts), model.dims):
                    raise ValueError(f"expected {model.dims} dimensions, got {found.shape[1]}")
                return [(v.astype(np.float32), None) for v in found]
            except Exception as error:  # whatever a model or service raises is an attempt that failed
                return [x for t in texts for x in one([t])] if len(texts) > 1 else [(None, f"{type(error).__name__}: {error}"[:500])]

        for batch in batches:
            texts = batch.fillna("").tolist()
            rows = [x for i in range(0, len(texts), BATCH) for x in one(texts[i:i + BATCH])]
            yield pd.DataFrame({"embedding": [v for v, _ in rows], "error": [e for _, e in rows]}, dtype=object)

    return run(text)
