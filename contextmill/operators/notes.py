"""Context notes: listing, search, quotas."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import tokens
from . import fusion
from .lexical import Asked, expand_prefixes, first_non_empty, phrase_matches
from .ordered import bucket_of, running_sum, top_per_group

LIST_LIMIT, SEARCH_LIMIT = 20, 5


@dataclass(frozen=True)
class Limits:
    """Default caps per session and overall."""

    session_notes: int = 50
    session_tokens: int = 32_000
    global_notes: int = 500
    global_tokens: int = 200_000


def list_notes(notes: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Latest notes of every session without their content, and the session's total."""
    head = top_per_group(notes.drop("content"), ["session_id"], [F.desc("created_at"), F.desc("ref")], limit)
    return head.join(notes.groupBy("session_id").agg(F.count("*").alias("total")), "session_id")


def search_notes(notes: DataFrame, requests: DataFrame, limit: int = SEARCH_LIMIT, vector_hits: DataFrame | None = None) -> DataFrame:
    """(query_id, ref, score, rank). Notes of the request's session with a word that starts with a query
    term, newest first, score 1; without any, notes containing the whole text, score 0.5. With vector
    hits (query_id, ref, rank) both lists are fused. requests: query_id, text, session_id ('' = all)."""
    asked = Asked.of(requests)
    newest = [F.desc("created_at"), F.desc("ref")]
    body = F.concat_ws(" ", F.coalesce("label", F.lit("")), "content")
    words = notes.select("ref", "session_id", "created_at", F.explode_outer(F.array_distinct(tokens(body))).alias("term"))
    hits = (expand_prefixes(words, asked.lengths).join(asked.prefixes, "prefix")
            .select("ref", "session_id", "created_at", "prefix").distinct()
            .join(asked.terms.select("query_id", "prefix"), "prefix"))
    sessions = requests.select("query_id", F.coalesce("session_id", F.lit("")).alias("wanted"))
    mine = hits.join(F.broadcast(sessions) if asked.few else sessions, "query_id").where(
        (F.col("wanted") == "") | (F.col("wanted") == F.col("session_id")))
    mine = mine.select("query_id", "ref", "created_at").distinct()
    text = top_per_group(mine, ["query_id"], newest, 2 * limit).select("query_id", "ref", F.lit(1.0).alias("score"), "rank")
    found = phrase_matches(notes, requests, [F.coalesce("label", F.lit("")), F.col("content")]).join(sessions, "query_id")
    found = found.where((F.col("wanted") == "") | (F.col("wanted") == F.col("session_id")))
    like = top_per_group(found.select("query_id", "ref", "created_at"), ["query_id"], newest, 2 * limit)
    ranked = first_non_empty(text, like.select("query_id", "ref", F.lit(0.5).alias("score"), "rank")).drop("stage")
    if vector_hits is None:
        return ranked.where(F.col("rank") <= limit)
    return fusion.rrf([ranked, vector_hits], "ref", limit)


# --- quotas ------------------------------------------------------------------------------------

def keep_newest(notes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Survivors of least-recently-used eviction: per session the newest notes that fit both caps.

    A note larger than the token cap was never stored. The note cap comes first, so at most that many
    rows per session reach the running total.
    """
    fitting = notes.where(F.col("token_est") <= limits.session_tokens)
    head = top_per_group(fitting, ["session_id"], [F.desc("created_at"), F.desc("access_count"), F.desc("ref")],
                         limits.session_notes, "age_rank")
    w = Window.partitionBy("session_id").orderBy("age_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = head.withColumn("kept_tokens", F.sum("token_est").over(w))
    return cum.where(F.col("kept_tokens") <= limits.session_tokens)


def _admit_session(limits: Limits):
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        count, used, admitted = 0, 0, []
        for size in rows["token_est"]:
            ok = count < limits.session_notes and used + size <= limits.session_tokens
            count, used = (count + 1, used + size) if ok else (count, used)
            admitted.append(ok)
        return rows.assign(admitted=admitted)

    return fold


def admit(notes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Admission in order of arrival under the session caps: adds admitted and the limit that refused.

    notes: ref, session_id, pos (order of arrival, long), token_est. A refused note changes nothing, so
    every decision depends on the earlier ones. But a session's free room only shrinks: of the notes of
    one size, the admitted ones are the first few. Keeping per (session, size) only as many as could
    ever fit leaves a bounded number of rows per session (about 160,000 by default) for the sequential
    step, whatever the session's length; all other notes are refused.
    """
    size, room = F.col("token_est"), limits.session_tokens
    sized = notes.select("ref", "session_id", F.col("pos").cast("long").alias("pos"), size.cast("long").alias("token_est"))
    able = top_per_group(sized.where(F.col("token_est") <= room), ["session_id", "token_est"], [F.col("pos")],
                         limits.session_notes, "nth").where(F.col("nth") * F.col("token_est") <= room).drop("nth")
    decided = able.groupBy("session_id").applyInPandas(
        _admit_session(limits), "ref string, session_id string, pos long, token_est long, admitted boolean")
    full = decided.where("admitted").groupBy("session_id").agg(
        F.count("*").alias("n"), F.max("pos").alias("last_pos"))
    full = full.where(F.col("n") >= limits.session_notes).select("session_id", F.col("last_pos").alias("full_at"))
    out = notes.join(decided.select("ref", "admitted"), "ref", "left").join(full, "session_id", "left")
    admitted = F.coalesce("admitted", F.lit(False))
    reason = (F.when(admitted, F.lit(None)).when(size > room, "single_note_tokens")
              .when(F.col("pos") > F.col("full_at"), "session_notes").otherwise("session_tokens"))
    return out.withColumn("refused_by", reason).withColumn("admitted", admitted).drop("full_at")


def admit_globally(notes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Admission in one order of arrival under the caps of every session and of all sessions together: adds admitted and
    refused_by, the first cap in the order single note, session notes, session tokens, global notes, global tokens.

    notes: ref, session_id, pos (order of arrival; equal ones by session and ref), token_est, and held (already stored, never
    refused, before all others). The caps of all sessions decide only at few places: until they refuse a note, each session
    decides alone. So the sessions decide by themselves, the driver follows the first admitted notes of all sessions, never
    more than the global cap of notes, up to the first that does not fit, and the sessions decide anew about later notes that
    fit what room is left. That room is less than the refused note, and only notes that fit it stay in play, so every later
    round but the last admits one; rounds are few, and never more than the global cap of notes. A session's first note that fits is admitted by its session;
    where sessions are many, notes behind enough of those first notes cannot be reached in a round and are not looked at,
    so at most about twice the global cap of sessions take part in it.
    """
    room, order = limits.session_tokens, "__order"
    held = notes.where("held").select("ref", "session_id", "token_est")
    arriving = running_sum(notes.where("NOT held"), [], F.col("pos"), [F.col("pos"), F.col("session_id"), F.col("ref")], F.lit(1).cast("long"), order)
    stored = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("token_est"), F.lit(0)).alias("t")).first()
    count, used, taken, after, left = stored["n"], stored["t"], [], 0, room
    spark, shape = notes.sparkSession, "ref string, session_id string, pos long, token_est long"
    busy = held.select("session_id").distinct()
    while count < limits.global_notes:
        need = limits.global_notes - count + 1
        ahead = arriving.where((F.col(order) > after) & (F.col("token_est") <= min(room, left)))
        mine = spark.createDataFrame([(ref, session, 0, size) for ref, session, _, size in taken], shape)
        fresh = ahead.join(busy, "session_id", "left_anti").join(mine.select("session_id").distinct(), "session_id", "left_anti")
        firsts = fresh.groupBy("session_id").agg(F.min(order).alias("o")).orderBy("o").limit(need).agg(F.count("*").alias("n"), F.max("o").alias("o")).first()
        if firsts["n"] == need:
            ahead = ahead.where(F.col(order) <= firsts["o"])
        known = held.select("ref", "session_id", F.lit(-1).cast("long").alias("pos"), F.col("token_est").cast("long").alias("token_est")).unionByName(mine)
        rows = known.withColumn("new", F.lit(False)).unionByName(ahead.select(
            "ref", "session_id", F.col(order).alias("pos"), F.col("token_est").cast("long").alias("token_est"), F.lit(True).alias("new")))
        head = admit(rows, limits).where("new AND admitted").select("ref", "session_id", "pos", "token_est").orderBy("pos").limit(need).collect()
        refused = False
        for r in head:
            if count >= limits.global_notes:
                break
            if used + r["token_est"] > limits.global_tokens:
                after, left, refused = r["pos"], limits.global_tokens - used, True
                break
            count, used = count + 1, used + r["token_est"]
            taken.append((r["ref"], r["session_id"], r["pos"], r["token_est"]))
        if not refused:
            break
    out = _with_reasons(arriving, held, taken, limits, order)
    stored_rows = notes.where("held").select("*", F.lit(True).alias("admitted"), F.lit(None).cast("string").alias("refused_by"))
    return out.select(*stored_rows.columns).unionByName(stored_rows)


def _with_reasons(arriving: DataFrame, held: DataFrame, taken: list, limits: Limits, order: str) -> DataFrame:
    """taken has the admitted notes (ref, session_id, place, size), at most as many as the global cap of notes."""
    spark = arriving.sparkSession
    before = held.groupBy("session_id").agg(F.count("*").alias("held_n"), F.sum("token_est").alias("held_t"))
    totals = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("token_est"), F.lit(0)).alias("t")).first()
    of_session: dict[str, list[tuple[int, int]]] = {}
    for _, session, place, size in taken:
        of_session.setdefault(session, []).append((place, size))
    mine = spark.createDataFrame([(k, v) for k, v in of_session.items()], "session_id string, own array<struct<place:long,size:long>>")
    places = sorted((place, size) for _, _, place, size in taken)
    running = [totals["t"]]
    for _, size in places:
        running.append(running[-1] + size)
    nth = bucket_of(F.col(order), [p for p, _ in places])
    tokens_then = F.split(F.lit(",".join(map(str, running))), ",").cast("array<long>")[nth]
    earlier = F.filter(F.coalesce("own", F.array().cast("array<struct<place:bigint,size:bigint>>")), lambda x: x["place"] < F.col(order))
    rows = arriving.join(before, "session_id", "left").join(F.broadcast(mine), "session_id", "left").withColumns({
        "__n": F.coalesce("held_n", F.lit(0)) + F.size(earlier),
        "__t": F.coalesce("held_t", F.lit(0)) + F.aggregate(earlier, F.lit(0).cast("long"), lambda acc, x: acc + x["size"])})
    admitted = F.array_contains(F.transform(F.coalesce("own", F.array().cast("array<struct<place:bigint,size:bigint>>")), lambda x: x["place"]), F.col(order))
    size = F.col("token_est")
    reason = (F.when(F.col("admitted"), F.lit(None)).when(size > limits.session_tokens, "single_note_tokens")
              .when(F.col("__n") >= limits.session_notes, "session_notes").when(F.col("__t") + size > limits.session_tokens, "session_tokens")
              .when(nth + totals["n"] >= limits.global_notes, "global_notes").when(tokens_then + size > limits.global_tokens, "global_tokens"))
    return rows.withColumn("admitted", admitted).withColumn("refused_by", reason)


def flush(notes: DataFrame, session_id: str = "", refs: list[str] | None = None, project_path: str = "",
          everything: bool = False) -> DataFrame:
    """Tombstones (ref, token_est) for the notes to delete; their sum is the freed amount."""
    if everything:
        chosen: Column = F.lit(True)
    elif refs:
        chosen = F.col("ref").isin(*refs) & ((F.lit(session_id) == "") | (F.col("session_id") == session_id))
    elif session_id:
        chosen = (F.col("session_id") == session_id) & ((F.lit(project_path) == "") | (F.col("project_path") == project_path))
    else:
        raise ValueError("session_id, refs or everything needed")
    return notes.where(chosen).select("ref", "token_est")
