"""Usage analytics over the call log and the note tables. `now` is always a parameter.

Windows are half-open ranges of real timestamps, so they can be pruned by a time-partitioned log. All
aggregates combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.languages import language_label
from ..functions.scalars import argument, basename, percent_of, quota_text, share_label

# Window lengths and the tool that stands for background indexing.
WINDOW_DAYS = 30
WATCHER = "file_watcher"
NOTE_TOOLS = ("store_context", "fetch_context", "search_context", "flush_context")
MAX_RECENT = 500


def since(now: Column, days: int) -> Column:
    return F.col("timestamp") >= now - F.make_dt_interval(F.lit(days))


def today(now: Column) -> Column:
    start = F.date_trunc("day", now)
    return (F.col("timestamp") >= start) & (F.col("timestamp") < start + F.make_dt_interval(F.lit(1)))


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _tool_total(name: str) -> Column:
    """Sum over calls of tools, background indexing counted as 0."""
    return _total(F.when(F.col("tool_name") != WATCHER, F.col(name)).otherwise(0))


def headline(log: DataFrame, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    return log.where(since(now, days)).agg(
        F.count("*").alias("total_queries"), F.count_distinct("session_id").alias("total_sessions"),
        _total(F.col("result_chars")).alias("total_chars"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        _tool_total("tokens_saved").alias("total_tokens_saved"),
        _tool_total("dedup_tokens_saved").alias("dedup_tokens_saved"),
        _tool_total("savings_vs_files").alias("savings_vs_files"))


def today_stats(log: DataFrame, now: Column) -> DataFrame:
    return log.where(today(now)).agg(
        F.count("*").alias("today_queries"), F.count_distinct("session_id").alias("today_sessions"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("today_avg_duration_ms"),
        _tool_total("tokens_saved").alias("today_tokens_saved"))


def tool_stats(log: DataFrame, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Per tool, background indexing left out, most calls first."""
    stats = log.where((F.col("tool_name") != WATCHER) & since(now, days)).groupBy("tool_name").agg(
        F.count("*").alias("calls"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        _total(F.col("cpu_ms")).alias("total_cpu_ms"), F.coalesce(F.avg("cpu_ms"), F.lit(0.0)).alias("avg_cpu_ms"),
        _total(F.col("tokens_saved")).alias("tokens_saved"),
        _total(F.col("dedup_tokens_saved")).alias("dedup_tokens_saved"),
        _total(F.col("savings_vs_files")).alias("savings_vs_files"),
        _total(F.col("symbol_baseline_tokens")).alias("symbol_baseline_tokens"),
        F.coalesce(F.avg("output_tokens"), F.lit(0.0)).alias("avg_output_tokens"),
        F.coalesce(F.avg("result_chars"), F.lit(0.0)).alias("avg_result_chars"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))
    rate = percent_of(F.col("tokens_saved"), F.col("symbol_baseline_tokens"))
    return stats.withColumn("savings_rate_pct", rate).orderBy(F.desc("calls"), "tool_name")


def time_series(log: DataFrame, now: Column, interval: str = "daily", days: int = WINDOW_DAYS) -> DataFrame:
    days = min(max(days, 1), 365)
    pattern = "yyyy-MM-dd'T'HH:00" if interval == "hourly" else "yyyy-MM-dd"
    points = log.where(since(now, days)).groupBy(F.date_format("timestamp", pattern).alias("period")).agg(
        F.count("*").alias("queries"), _tool_total("tokens_saved").alias("tokens_saved"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"))
    return points.orderBy("period")


def recent(log: DataFrame, limit: int = 60, tie: str = "id") -> DataFrame:
    """Latest calls: two thirds tools and one third background indexing, at least 10 of each."""
    tools, watcher = max(limit * 2 // 3, 10), max(limit // 3, 10)
    newest = [F.desc("timestamp"), F.desc(tie)]
    a = log.where(F.col("tool_name") != WATCHER).orderBy(*newest).limit(min(tools, MAX_RECENT))
    b = log.where(F.col("tool_name") == WATCHER).orderBy(*newest).limit(min(watcher, MAX_RECENT))
    both = a.withColumn("section", F.lit("tools")).unionByName(b.withColumn("section", F.lit("indexing")))
    project = F.when(F.coalesce("project_path", F.lit("")) != "", F.col("project_path")).otherwise(
        argument("arguments", "project_path"))
    file = F.when(F.col("tool_name") == WATCHER, argument("arguments", "file"))
    return both.select("section", tie, "timestamp", "tool_name", project.alias("project_path"), "duration_ms", "error",
                       "tokens_saved", argument("arguments", "query").alias("query"),
                       argument("arguments", "mode").alias("mode"), basename(file).alias("file"))


# --- index statistics --------------------------------------------------------------------------

def project_symbol_counts(symbols: DataFrame) -> DataFrame:
    return symbols.where("project_path IS NOT NULL").groupBy("project_path").agg(
        F.count("*").alias("symbol_count"), F.count_distinct("file").alias("file_count"))


def scope_index_stats(symbols: DataFrame, scope: DataFrame) -> DataFrame:
    """Own and total (own plus linked) symbols and files per root; scope is (root, project_path)."""
    counts = project_symbol_counts(symbols)
    own = F.col("root") == F.col("project_path")
    joined = scope.join(counts, "project_path", "left").na.fill(0, ["symbol_count", "file_count"])
    return joined.groupBy("root").agg(
        F.sum(F.when(own, F.col("symbol_count")).otherwise(0)).alias("own_nodes"),
        F.sum(F.when(own, F.col("file_count")).otherwise(0)).alias("own_files"),
        F.sum("symbol_count").alias("total_nodes"), F.sum("file_count").alias("total_files"))


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "kind")


def language_stats(symbols: DataFrame) -> DataFrame:
    stats = symbols.groupBy(language_label("file").alias("language")).agg(
        F.count_distinct("file").alias("files"), F.count("*").alias("symbols"))
    return stats.orderBy(F.desc("symbols"), "language")


def top_imports(edges: DataFrame, limit: int = 20) -> DataFrame:
    return edges.groupBy("target").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "target").limit(limit)


def vector_stats(vectors: DataFrame, dims: int) -> DataFrame:
    n = F.count("*")
    return vectors.agg(n.alias("total_vectors"), (n * dims * 4 / (1 << 20)).alias("memory_mb"))


def index_health(symbols: DataFrame, edges: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """One row: symbols, files, edges, vectors, their memory. The counts are scalar subqueries."""
    n_edges = edges.agg(F.count("*").alias("n")).scalar()
    n_vectors = vectors.agg(F.count("*").alias("n")).scalar()
    own = symbols.agg(F.count("*").alias("total_symbols"), F.count_distinct("file").alias("total_files"))
    return own.select("*", n_edges.alias("total_edges"), n_vectors.alias("total_vectors"),
                      (n_vectors * dims * 4 / (1 << 20)).alias("vector_memory_mb"))


def project_overview(symbols: DataFrame, log: DataFrame, discovered: DataFrame) -> DataFrame:
    """Every path known from symbols, calls or discovery, with its counts, by label."""
    calls = log.where(F.col("project_path").isNotNull() & ~F.col("project_path").isin("", ".")).groupBy("project_path").agg(
        F.count("*").alias("query_count"))
    full = (project_symbol_counts(symbols).join(calls, "project_path", "full")
            .join(discovered.select("project_path").distinct(), "project_path", "full"))
    out = full.na.fill(0, ["symbol_count", "file_count", "query_count"]).withColumn("label", basename("project_path"))
    return out.orderBy(F.lower("label"), "project_path")


def called_projects(symbols: DataFrame, log: DataFrame) -> DataFrame:
    """Projects with calls, with their symbol counts if indexed."""
    calls = log.where("project_path IS NOT NULL").groupBy("project_path").agg(F.count("*").alias("query_count"))
    out = calls.join(project_symbol_counts(symbols), "project_path", "left").na.fill(0)
    return out.withColumn("name", basename("project_path"))


def indexed_projects(symbols: DataFrame) -> DataFrame:
    return symbols.select("project_path").where(
        F.col("project_path").isNotNull() & ~F.col("project_path").isin("", ".")).distinct()


def chart_shares(counts: DataFrame, label: str, value: str) -> DataFrame:
    """Share of the total per bar, with its printed form. A chart has few bars."""
    total = counts.agg(F.sum(value).alias("t")).scalar()
    pct = percent_of(F.col(value), total)
    return counts.select(label, value, pct.alias("pct"), share_label(pct).alias("pct_label"))


def cache_hit_ratio(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.avg("cache_hit"), F.lit(0.0)).alias("hit_ratio"))


# --- notes and repairs -------------------------------------------------------------------------

def note_inventory(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count("*").alias("active_notes_count"), _total(F.col("token_est")).alias("active_inventory_tokens"),
                     F.count_if(F.col("access_count") == 0).alias("orphan_notes_count"))


def session_quota(notes: DataFrame, max_notes: int, max_tokens: int) -> DataFrame:
    """Per session: notes, tokens and the quota strings."""
    per = notes.groupBy("session_id").agg(F.count("*").alias("notes_count"), F.sum("token_est").alias("tokens_stored"))
    return per.select("*", quota_text(F.col("notes_count"), max_notes).alias("notes_quota"),
                      quota_text(F.col("tokens_stored"), max_tokens).alias("tokens_quota"))


def _note_tokens() -> Column:
    """The token column that counts for a note tool."""
    return (F.when(F.col("tool_name").isin("fetch_context", "search_context"), F.col("tokens_used"))
            .when(F.col("tool_name") == "flush_context", F.col("file_baseline_tokens"))
            .otherwise(F.col("tokens_saved")))


def note_tool_window(log: DataFrame, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Calls and virtual tokens per note tool from the start of the first day of the window."""
    start = F.date_trunc("day", now - F.make_dt_interval(F.lit(days)))
    rows = log.where((F.col("timestamp") >= start) & F.col("tool_name").isin(*NOTE_TOOLS))
    return rows.groupBy("tool_name").agg(F.count("*").alias("calls"), _total(_note_tokens()).alias("virtual_tokens"))


def note_dashboard(log: DataFrame, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    start = F.date_trunc("day", now - F.make_dt_interval(F.lit(days)))
    rows = log.where((F.col("timestamp") >= start) & F.col("tool_name").isin(*NOTE_TOOLS))
    read = F.col("tool_name").isin("fetch_context", "search_context")
    stored = F.when(F.col("tool_name") == "store_context", F.col("tokens_saved")).otherwise(0)
    accessed = F.when(read, F.col("tokens_used")).otherwise(0)
    flushed = F.when(F.col("tool_name") == "flush_context", F.col("file_baseline_tokens")).otherwise(0)
    out = rows.agg(
        _total(stored).alias("virtual_tokens_stored"), _total(accessed).alias("virtual_tokens_accessed"),
        _total(flushed).alias("flushed_tokens"),
        _total(F.when(today(now), stored)).alias("today_stored"), _total(F.when(today(now), accessed)).alias("today_accessed"))
    return out.withColumn("utilization_pct", percent_of(F.col("virtual_tokens_accessed"), F.col("virtual_tokens_stored")))


def is_repair_note() -> Column:
    """Repair archive by kind or tag; tags are comma-separated, blanks around them ignored."""
    tags = F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t))
    return (F.trim(F.coalesce("kind", F.lit(""))) == "kv_repair") | F.array_contains(tags, "kv_repair")


def repair_rollup(notes: DataFrame, accesses: DataFrame, events: DataFrame, now: Column,
                  days: int = WINDOW_DAYS) -> DataFrame:
    """One row of repair metrics. notes: kind, tags, access_count, created_at. accesses: repair_reason,
    virtual_tokens, accessed_at. events: repair_reason, outcome, created_at."""
    start = F.date_trunc("day", now - F.make_dt_interval(F.lit(days)))
    day = F.date_trunc("day", now)
    nights = F.make_dt_interval(F.lit(1))

    def on_day(c: str) -> Column:
        return (F.col(c) >= day) & (F.col(c) < day + nights)

    archives = notes.where(is_repair_note()).agg(
        F.count("*").alias("archives_active"), F.count_if(F.col("access_count") == 0).alias("repair_orphans"),
        F.count_if(F.col("created_at") >= start).alias("archives_stored"),
        F.count_if(on_day("created_at")).alias("today_archives"))
    reason = F.coalesce("repair_reason", F.lit(""))
    repairs = accesses.where((reason != "") & (F.col("accessed_at") >= start)).agg(
        F.count("*").alias("n"), _total(F.col("virtual_tokens")).alias("tokens"),
        F.count_if(on_day("accessed_at")).alias("today"),
        *[F.count_if(F.col("repair_reason") == r).alias(r) for r in ("cache_miss", "quality", "manual")])
    signals = events.where(F.col("created_at") >= start).agg(
        *[F.count_if(F.col("repair_reason") == r).alias(r) for r in ("cache_miss", "quality", "manual")],
        F.count_if(F.col("outcome") == "success").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("bad"))
    r = repairs.select(F.struct("*")).scalar()
    s = signals.select(F.struct("*")).scalar()
    return archives.select(
        "*", r["n"].alias("repairs_total"), r["tokens"].alias("tokens_repaired"), r["today"].alias("today_repairs"),
        r["cache_miss"].alias("repairs_cache_miss"), r["quality"].alias("repairs_quality"), r["manual"].alias("repairs_manual"),
        s["quality"].alias("quality_signals"), s["cache_miss"].alias("cache_miss_signals"), s["manual"].alias("manual_signals"),
        percent_of(r["n"], F.col("archives_stored")).alias("repair_utilization_pct"),
        percent_of(s["ok"], s["ok"] + s["bad"]).alias("repair_success_rate"))


# --- logs and throughput -----------------------------------------------------------------------

def log_level(line: Column) -> Column:
    low = F.lower(line)

    def any_of(*words: str) -> Column:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        return test

    return (F.when(any_of("error", "fatal", "timeout", "deadline exceeded", " failed"), "error")
            .when(any_of("warn", "throttl", "locked", "busy=1"), "warn").otherwise("info"))


def log_fields(line: Column) -> Column:
    """(level, timestamp, message) of a log line; the timestamp is the prefix 'yyyy/mm/dd hh:mm:ss'."""
    stamped = (F.octet_length(line) >= 20) & F.rlike(line, F.lit(r"^.{4}/.{2}/"))
    return F.struct(
        log_level(line).alias("level"), F.when(stamped, F.trim(F.substring(line, 1, 19))).otherwise("").alias("timestamp"),
        F.when(stamped, F.trim(F.substr(line, F.lit(21)))).otherwise(line).alias("message"))


def sliding_throughput(log: DataFrame, window: str = "5 seconds", slide: str = "500 milliseconds") -> DataFrame:
    """Events per second in every sliding window that holds any."""
    seconds = F.window("timestamp", window, slide)
    return log.groupBy(seconds.alias("w")).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), "events", (F.col("events") / 5.0).alias("per_second"))
