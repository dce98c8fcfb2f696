"""Event sequences at rest: debounce, idle sessions, first sightings. The batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import micros
from .ordered import first_per_group, neighbour, running_sum


def debounce(events: DataFrame, by: list[str], ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """Events not followed by another of the same group within the gap: the last one wins."""
    placed = events.withColumn("__t", micros(ts))
    out = neighbour(placed, by, F.col("__t"), ["__t", tie], ["__t"], "__n")
    quiet = F.col("__n").isNull() | (F.col("__n.__t") - F.col("__t") >= int(gap_seconds * 1_000_000))
    return out.where(quiet).drop("__t", "__n")


def is_removal(event: Column) -> Column:
    """A renamed file is gone under its old path."""
    return event.isin("remove", "rename")


def idle_sessions(events: DataFrame, by: list[str], ts: str, tie: str, gap: Column) -> DataFrame:
    """(by…, session_no, session_start, session_end, events): a session ends after an idle gap, given
    in seconds and possibly different per row (a pinned project waits longer)."""
    placed = events.withColumn("__t", micros(ts)).withColumn("__gap", gap.cast("long") * 1_000_000)
    prev = neighbour(placed, by, F.col("__t"), ["__t", tie], ["__t", "__gap"], "__p", following=False)
    starts = F.col("__p").isNull() | (F.col("__t") - F.col("__p.__t") > F.col("__p.__gap"))
    marked = prev.withColumn("__s", starts.cast("long")).drop("__p", "__gap")
    numbered = running_sum(marked, by, F.col("__t"), [F.col("__t"), F.col(tie)], F.col("__s"), "session_no")
    return numbered.groupBy(*by, "session_no").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events"))


def first_seen(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first event per key; everything later in the session is a repeat."""
    return first_per_group(events, by, order)
