"""Packing of ranked hits into a token budget: representation, session dedup, prefix stop, savings.

The running state of a packing loop has a closed form. Hits are sorted by score, so the ratio to the
best score never rises; the number of hits already sent in full is then below the threshold exactly
when the number of hits kept so far is. Token estimates are not negative, so "stop at the first hit
that would overflow" is "cumulative tokens within the budget".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import (blank_to_null, json_token_estimate, saved_vs_files, token_estimate,
                                 tokens_saved)
from .ordered import running_sum

# Thresholds of mode 'auto'.
FULL_RATIO, SKELETON_RATIO = 0.5, 0.2
ALWAYS_FULL, ALWAYS_FULL_UNSCORED = 2, 3


def effective_mode(mode: Column, score: Column, max_score: Column, kept_before: Column) -> Column:
    """Representation of a hit; kept_before counts the earlier hits of the list that are sent."""
    ratio = score / max_score
    scored = (F.when((ratio >= FULL_RATIO) | (kept_before < ALWAYS_FULL), F.lit("full"))
              .when(ratio >= SKELETON_RATIO, F.lit("skeleton")).otherwise(F.lit("summary")))
    unscored = F.when(kept_before < ALWAYS_FULL_UNSCORED, F.lit("full")).otherwise(F.lit("skeleton"))
    return F.when(mode != "auto", mode).when(max_score > 0, scored).otherwise(unscored)


def mark_returned(hits: DataFrame, returned: DataFrame) -> DataFrame:
    """Adds `already`: the session has seen (file, name, start_line) before. Hits need session_id."""
    keys = ["session_id", "file", "name", "start_line"]
    seen = (returned.where((F.col("session_id") != "") & (F.col("file") != "") & (F.col("name") != ""))
            .select(*keys).distinct().withColumn("already", F.lit(True)))
    return hits.join(seen, keys, "left").withColumn("already", F.coalesce("already", F.lit(False)))


def drop_returned(hits: DataFrame, returned: DataFrame) -> DataFrame:
    """Only hits the session has not seen yet."""
    keys = ["session_id", "file", "name", "start_line"]
    return hits.join(returned.select(*keys).distinct(), keys, "left_anti")


def attach_summaries(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    """Adds `summary`: the symbol's cached text, else its file's; dropped when stored for other code.

    summaries has (file, name, project_path, summary_text, content_hash), name '' for file level.
    """
    s = summaries.select("file", F.coalesce("name", F.lit("")).alias("name"), "project_path",
                         "summary_text", "content_hash")
    own = s.where((F.col("name") != "") & (F.col("summary_text") != "")).select(
        "file", "name", "project_path", F.struct("summary_text", "content_hash").alias("__own"))
    whole = s.where(F.col("name") == "").select(
        "file", "project_path", F.struct("summary_text", "content_hash").alias("__file"))
    joined = (hits.join(own, ["file", "name", "project_path"], "left")
              .join(whole, ["file", "project_path"], "left"))
    chosen = F.coalesce("__own", "__file")
    current = F.when(F.col("code") != "", F.substring(F.sha2("code", 256), 1, 32))
    fresh = (chosen["content_hash"] == "") | current.isNull() | (chosen["content_hash"] == current)
    return (joined.withColumn("summary", F.when(fresh, blank_to_null(chosen["summary_text"])))
            .drop("__own", "__file"))


def full_tokens() -> Column:
    """Tokens of the whole source of a hit, else of its stored code line."""
    return F.when(F.coalesce("source", F.lit("")) != "", token_estimate("source")).otherwise(
        token_estimate("code"))


def payload_json() -> Column:
    """The row sent to the caller, keys in alphabetical order, absent content left out."""
    mode = F.col("effective_mode")
    skeleton, source, summary = (blank_to_null(c) for c in ("skeleton", "source", "summary"))
    falls_back = (mode == "summary") & summary.isNull()
    fields = {
        "_fallback": F.when(falls_back & skeleton.isNotNull(), F.lit("skeleton")),
        "end_line": F.col("end_line"), "file": F.col("out_file"), "kind": F.col("kind"), "name": F.col("name"),
        "skeleton": F.when((mode == "skeleton") | falls_back, skeleton),
        "source": F.when(~mode.isin("skeleton", "summary"), source),
        "start_line": F.col("start_line"),
        "summary": F.when(mode == "summary", summary),
    }
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"})


def pack(hits: DataFrame) -> DataFrame:
    """Every considered hit with its representation, size and fate (`sent`, `skipped`).

    Needs query_id, rank, score, mode, token_budget (0 = unlimited), already, file, out_file, name,
    kind, start_line, end_line, code, source, skeleton, summary, extra_bytes.
    """
    ordered = Window.partitionBy("query_id").orderBy("rank")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    kept = (~F.col("already")).cast("int")
    sized = (hits
             .withColumn("max_score", F.max("score").over(Window.partitionBy("query_id")))
             .withColumn("kept_before", F.coalesce(F.sum(kept).over(before), F.lit(0)))
             .withColumn("effective_mode", effective_mode(F.col("mode"), F.col("score"),
                                                          F.col("max_score"), F.col("kept_before")))
             .withColumn("payload", payload_json())
             .withColumn("tokens", json_token_estimate(F.col("payload"), F.col("extra_bytes")))
             .withColumn("baseline", full_tokens()))
    running = F.sum(F.when(~F.col("already"), F.col("tokens")).otherwise(0)).over(so_far)
    reached = (F.col("token_budget") <= 0) | (F.col("used_so_far") <= F.col("token_budget"))
    return (sized.withColumn("used_so_far", running)
            .withColumn("sent", reached & ~F.col("already"))
            .withColumn("skipped", reached & F.col("already")))


def pack_savings(packed: DataFrame, files: DataFrame, by: str = "query_id") -> DataFrame:
    """Token accounting per request. files has (file, file_tokens)."""
    sent_files = (packed.where("sent").select(by, "file").distinct().join(files, "file")
                  .groupBy(by).agg(F.sum("file_tokens").alias("file_baseline_tokens")))
    zero = F.lit(0)
    totals = packed.groupBy(by).agg(
        F.count_if("sent").alias("results"),
        F.count_if("skipped").alias("deduped"),
        F.coalesce(F.sum(F.when(F.col("sent"), F.col("tokens"))), zero).alias("tokens_used"),
        F.coalesce(F.sum(F.when(F.col("sent"), F.col("baseline"))), zero).alias("symbol_baseline_tokens"),
        F.coalesce(F.sum(F.when(F.col("skipped"), F.col("tokens"))), zero).alias("dedup_tokens_saved"))
    used, dedup = F.col("tokens_used"), F.col("dedup_tokens_saved")
    return (totals.join(sent_files, by, "left")
            .withColumn("file_baseline_tokens", F.coalesce("file_baseline_tokens", zero))
            .withColumn("tokens_saved", tokens_saved(used, F.col("symbol_baseline_tokens"), dedup))
            .withColumn("savings_vs_files", saved_vs_files(used, F.col("file_baseline_tokens"), dedup)))


# --- budgets -----------------------------------------------------------------------------------

def budget_prefix(ranked: DataFrame, by: str, tokens: Column, budget: Column,
                  keep_first: bool = False) -> DataFrame:
    """Longest prefix of a short ranked list whose tokens fit; optionally the first row regardless."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = ranked.withColumn("cum_tokens", F.sum(tokens).over(w))
    fits = F.col("cum_tokens") <= budget
    return cum.where(fits | (F.col("rank") == 1) if keep_first else fits)


def budget_prefix_unbounded(df: DataFrame, by: list[str], axis: Column, order: list[Column],
                            tokens: Column, budget: int) -> DataFrame:
    """As budget_prefix for lists of any length: the list is cut over many tasks by its order."""
    return (running_sum(df, by, axis, order, tokens, "cum_tokens")
            .where(F.col("cum_tokens") <= budget))
