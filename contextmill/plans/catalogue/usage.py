"""Usage analytics queries; events stand in for the call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...functions.scalars import micros
from ...operators import upkeep, usage
from . import Catalogue
from .views import table

CATALOGUE = Catalogue()
register = CATALOGUE.register

# averages and sums of doubles depend on the order of addition in their last digits
DIGITS = 10


def call_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tool = (F.when(F.col("event_type") == "view", "get_context_capsule").when(F.col("event_type") == "click", "fetch_context")
            .when(F.col("event_type") == "purchase", "store_context").when(F.col("event_type") == "signup", "file_watcher")
            .otherwise("flush_context"))
    whole = F.floor("value").cast("int")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), tool.alias("tool_name"),
        F.col("props").alias("arguments"), F.length("props").alias("result_chars"), F.col("value").alias("duration_ms"),
        (F.col("value") / 2).alias("cpu_ms"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"),
        F.concat(F.lit("/src/src"), F.floor(k / 10).cast("string")).alias("project_path"),
        whole.alias("tokens_saved"), F.floor(whole / 10).cast("int").alias("dedup_tokens_saved"), (whole * 2).alias("savings_vs_files"),
        (whole * 3).alias("symbol_baseline_tokens"), k.alias("output_tokens"), (k + 1).alias("tokens_used"),
        (whole * 4).alias("file_baseline_tokens"), (k > 50).cast("int").alias("cache_hit"))


LOG_SQL = """
log AS (SELECT event_id AS id, ts AS timestamp,
  CASE event_type WHEN 'view' THEN 'get_context_capsule' WHEN 'click' THEN 'fetch_context' WHEN 'purchase' THEN 'store_context'
                  WHEN 'signup' THEN 'file_watcher' ELSE 'flush_context' END AS tool_name,
  props AS arguments, length(props) AS result_chars, value AS duration_ms, value / 2 AS cpu_ms, 's' || user_id AS session_id,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS error, '/src/src' || (k // 10) AS project_path,
  floor(value)::INT AS tokens_saved, (floor(value)::INT // 10) AS dedup_tokens_saved, floor(value)::INT * 2 AS savings_vs_files,
  floor(value)::INT * 3 AS symbol_baseline_tokens, k AS output_tokens, k + 1 AS tokens_used,
  floor(value)::INT * 4 AS file_baseline_tokens, (k > 50)::INT AS cache_hit
  FROM (SELECT *, (props->>'k')::INT AS k FROM events)),
clock AS (SELECT max(ts) AS now FROM events)"""


def now_of(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "events").agg(F.max("ts").alias("now")).scalar()


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


_HEAD = """count(*) AS total_queries, count(DISTINCT session_id) AS total_sessions, coalesce(sum(result_chars), 0)::BIGINT AS total_chars,
  round(coalesce(avg(duration_ms), 0), 10) AS avg_duration_ms,
  coalesce(sum(tokens_saved) FILTER (tool_name <> 'file_watcher'), 0)::BIGINT AS total_tokens_saved,
  coalesce(sum(dedup_tokens_saved) FILTER (tool_name <> 'file_watcher'), 0)::BIGINT AS dedup_tokens_saved,
  coalesce(sum(savings_vs_files) FILTER (tool_name <> 'file_watcher'), 0)::BIGINT AS savings_vs_files"""


@register("usage_headline_30d", f"WITH {LOG_SQL} SELECT {_HEAD} FROM log, clock WHERE timestamp >= now - INTERVAL 30 DAY")
def usage_headline_30d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.headline(call_log(spark, sf), now_of(spark, sf)), "avg_duration_ms")


@register("usage_headline_7d", f"WITH {LOG_SQL} SELECT {_HEAD} FROM log, clock WHERE timestamp >= now - INTERVAL 7 DAY")
def usage_headline_7d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.headline(call_log(spark, sf), now_of(spark, sf), 7), "avg_duration_ms")


@register("usage_today", f"""
WITH {LOG_SQL} SELECT count(*) AS today_queries, count(DISTINCT session_id) AS today_sessions,
  round(coalesce(avg(duration_ms), 0), 10) AS today_avg_duration_ms,
  coalesce(sum(tokens_saved) FILTER (tool_name <> 'file_watcher'), 0)::BIGINT AS today_tokens_saved
FROM log, clock WHERE timestamp >= date_trunc('day', now) AND timestamp < date_trunc('day', now) + INTERVAL 1 DAY""")
def usage_today(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.today_stats(call_log(spark, sf), now_of(spark, sf)), "today_avg_duration_ms")


@register("tool_stats", f"""
WITH {LOG_SQL}, s AS (SELECT tool_name, count(*) AS calls, round(avg(duration_ms), 10) AS avg_duration_ms,
  round(sum(cpu_ms), 6) AS total_cpu_ms, round(avg(cpu_ms), 10) AS avg_cpu_ms, sum(tokens_saved)::BIGINT AS tokens_saved,
  sum(dedup_tokens_saved)::BIGINT AS dedup_tokens_saved, sum(savings_vs_files)::BIGINT AS savings_vs_files,
  sum(symbol_baseline_tokens)::BIGINT AS symbol_baseline_tokens, round(avg(output_tokens), 10) AS avg_output_tokens,
  round(avg(result_chars), 10) AS avg_result_chars, count(*) FILTER (error <> '') AS errors
  FROM log, clock WHERE tool_name <> 'file_watcher' AND timestamp >= now - INTERVAL 30 DAY GROUP BY ALL)
SELECT *, round(CASE WHEN symbol_baseline_tokens > 0 THEN tokens_saved / symbol_baseline_tokens * 100 ELSE 0 END, 10) AS savings_rate_pct FROM s""")
def tool_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.tool_stats(call_log(spark, sf), now_of(spark, sf))
    out = rounded(out, "avg_duration_ms", "avg_cpu_ms", "avg_output_tokens", "avg_result_chars", "savings_rate_pct")
    return out.withColumn("total_cpu_ms", F.round("total_cpu_ms", 6))


def _series(fmt: str, days: int) -> str:
    return f"""
WITH {LOG_SQL} SELECT strftime(timestamp, '{fmt}') AS period, count(*) AS queries,
  coalesce(sum(tokens_saved) FILTER (tool_name <> 'file_watcher'), 0)::BIGINT AS tokens_saved,
  round(avg(duration_ms), 10) AS avg_duration_ms
FROM log, clock WHERE timestamp >= now - INTERVAL {days} DAY GROUP BY ALL"""


@register("timeseries_daily", _series("%Y-%m-%d", 30))
def timeseries_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.time_series(call_log(spark, sf), now_of(spark, sf)), "avg_duration_ms")


@register("timeseries_hourly", _series("%Y-%m-%dT%H:00", 7))
def timeseries_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.time_series(call_log(spark, sf), now_of(spark, sf), "hourly", 7), "avg_duration_ms")


@register("recent_split", f"""
WITH {LOG_SQL},
a AS (SELECT 'tools' AS section, * FROM log WHERE tool_name <> 'file_watcher' ORDER BY timestamp DESC, id DESC LIMIT 40),
b AS (SELECT 'indexing' AS section, * FROM log WHERE tool_name = 'file_watcher' ORDER BY timestamp DESC, id DESC LIMIT 20)
SELECT section, id, epoch_us(timestamp) AS ts_us, tool_name, project_path, duration_ms, error, tokens_saved
FROM (FROM a UNION ALL FROM b)""")
def recent_split(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.recent(call_log(spark, sf), 60)
    return out.select("section", "id", micros("timestamp").alias("ts_us"), "tool_name", "project_path", "duration_ms",
                      "error", "tokens_saved")


@register("cache_hit_ratio", f"WITH {LOG_SQL} SELECT round(avg(cache_hit), 10) AS hit_ratio FROM log")
def cache_hit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.cache_hit_ratio(call_log(spark, sf)), "hit_ratio")


@register("tool_chart_shares", f"""
WITH {LOG_SQL}, c AS (SELECT tool_name, count(*) AS calls FROM log GROUP BY ALL)
SELECT tool_name, calls, round(calls / sum(calls) OVER () * 100, 6) AS pct FROM c""")
def tool_chart_shares(spark: SparkSession, sf: str) -> DataFrame:
    calls = call_log(spark, sf).groupBy("tool_name").agg(F.count("*").alias("calls"))
    return usage.chart_shares(calls, "tool_name", "calls").select("tool_name", "calls", F.round("pct", 6).alias("pct"))


@register("context_tool_window", f"""
WITH {LOG_SQL} SELECT tool_name, count(*) AS calls, coalesce(sum(CASE WHEN tool_name = 'fetch_context' THEN tokens_used
  WHEN tool_name = 'flush_context' THEN file_baseline_tokens ELSE tokens_saved END), 0)::BIGINT AS virtual_tokens
FROM log, clock WHERE tool_name IN ('store_context', 'fetch_context', 'search_context', 'flush_context')
  AND timestamp >= date_trunc('day', now - INTERVAL 7 DAY) GROUP BY ALL""")
def context_tool_window(spark: SparkSession, sf: str) -> DataFrame:
    return usage.note_tool_window(call_log(spark, sf), now_of(spark, sf), 7)


@register("context_dashboard", f"""
WITH {LOG_SQL}, w AS (SELECT *, timestamp >= date_trunc('day', now) AS td FROM log, clock
  WHERE tool_name IN ('store_context', 'fetch_context', 'search_context', 'flush_context') AND timestamp >= date_trunc('day', now - INTERVAL 7 DAY)),
s AS (SELECT coalesce(sum(tokens_saved) FILTER (tool_name = 'store_context'), 0)::BIGINT AS virtual_tokens_stored,
  coalesce(sum(tokens_used) FILTER (tool_name = 'fetch_context'), 0)::BIGINT AS virtual_tokens_accessed,
  coalesce(sum(file_baseline_tokens) FILTER (tool_name = 'flush_context'), 0)::BIGINT AS flushed_tokens,
  coalesce(sum(tokens_saved) FILTER (tool_name = 'store_context' AND td), 0)::BIGINT AS today_stored,
  coalesce(sum(tokens_used) FILTER (tool_name = 'fetch_context' AND td), 0)::BIGINT AS today_accessed FROM w)
SELECT *, round(virtual_tokens_accessed / virtual_tokens_stored * 100, 10) AS utilization_pct FROM s""")
def context_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(usage.note_dashboard(call_log(spark, sf), now_of(spark, sf), 7), "utilization_pct")


@register("kv_repair_rollup", """
WITH clock AS (SELECT max(ts) AS now FROM events),
e AS (SELECT *, (props->>'k')::INT AS k FROM events),
notes AS (SELECT ts AS created_at, k AS access_count, CASE WHEN event_type = 'purchase' THEN 'kv_repair' ELSE '' END AS kind,
            CASE WHEN event_type = 'signup' AND k > 50 THEN 'a, kv_repair' ELSE 'b' END AS tags FROM e),
acc AS (SELECT ts AS accessed_at, k AS virtual_tokens, CASE event_type WHEN 'view' THEN 'cache_miss' WHEN 'click' THEN 'quality'
            WHEN 'error' THEN 'manual' ELSE '' END AS reason FROM e),
sig AS (SELECT ts AS created_at, CASE event_type WHEN 'view' THEN 'cache_miss' WHEN 'click' THEN 'quality' ELSE 'manual' END AS reason,
            CASE WHEN k < 60 THEN 'success' WHEN k < 90 THEN 'failed' ELSE 'skipped' END AS outcome FROM e),
ar AS (SELECT count(*) AS archives_active, count(*) FILTER (access_count = 0) AS repair_orphans,
         count(*) FILTER (created_at >= date_trunc('day', now - INTERVAL 7 DAY)) AS archives_stored,
         count(*) FILTER (created_at >= date_trunc('day', now)) AS today_archives
       FROM notes, clock WHERE kind = 'kv_repair' OR tags LIKE '%kv_repair%'),
re AS (SELECT count(*) AS repairs_total, sum(virtual_tokens)::BIGINT AS tokens_repaired,
         count(*) FILTER (accessed_at >= date_trunc('day', now)) AS today_repairs,
         count(*) FILTER (reason = 'cache_miss') AS repairs_cache_miss, count(*) FILTER (reason = 'quality') AS repairs_quality,
         count(*) FILTER (reason = 'manual') AS repairs_manual
       FROM acc, clock WHERE reason <> '' AND accessed_at >= date_trunc('day', now - INTERVAL 7 DAY)),
si AS (SELECT count(*) FILTER (reason = 'quality') AS quality_signals, count(*) FILTER (reason = 'cache_miss') AS cache_miss_signals,
         count(*) FILTER (reason = 'manual') AS manual_signals, count(*) FILTER (outcome = 'success') AS ok,
         count(*) FILTER (outcome = 'failed') AS bad FROM sig, clock WHERE created_at >= date_trunc('day', now - INTERVAL 7 DAY))
SELECT * EXCLUDE (ok, bad), round(repairs_total / archives_stored * 100, 10) AS repair_utilization_pct,
       round(ok / (ok + bad) * 100, 10) AS repair_success_rate FROM ar, re, si""")
def kv_repair_rollup(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").withColumn("k", k)
    t = F.col("event_type")
    notes = e.select(F.col("ts").alias("created_at"), F.col("k").alias("access_count"),
                     F.when(t == "purchase", "kv_repair").otherwise("").alias("kind"),
                     F.when((t == "signup") & (F.col("k") > 50), "a, kv_repair").otherwise("b").alias("tags"))
    reason = F.when(t == "view", "cache_miss").when(t == "click", "quality")
    accesses = e.select(F.col("ts").alias("accessed_at"), F.col("k").alias("virtual_tokens"),
                        reason.when(t == "error", "manual").otherwise("").alias("repair_reason"))
    signals = e.select(F.col("ts").alias("created_at"), reason.otherwise("manual").alias("repair_reason"),
                       F.when(F.col("k") < 60, "success").when(F.col("k") < 90, "failed").otherwise("skipped").alias("outcome"))
    out = usage.repair_rollup(notes, accesses, signals, now_of(spark, sf), 7)
    return rounded(out, "repair_utilization_pct", "repair_success_rate")


@register("throughput_sliding", """
WITH s AS (SELECT unnest(range((epoch_us(ts) // 500000 - 9) * 500000, (epoch_us(ts) // 500000) * 500000 + 1, 500000)) AS start_us FROM events)
SELECT start_us, count(*) AS events, count(*) / 5.0::DOUBLE AS per_second FROM s GROUP BY ALL""")
def throughput_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.sliding_throughput(call_log(spark, sf))
    return out.select(micros("window_start").alias("start_us"), "events", "per_second")


@register("log_levels", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, CASE WHEN lower(line) LIKE '%error%' OR lower(line) LIKE '%fatal%' OR lower(line) LIKE '%timeout%'
   OR lower(line) LIKE '%deadline exceeded%' OR lower(line) LIKE '% failed%' THEN 'error'
   WHEN lower(line) LIKE '%warn%' OR lower(line) LIKE '%throttl%' OR lower(line) LIKE '%locked%' OR lower(line) LIKE '%busy=1%' THEN 'warn'
   ELSE 'info' END AS level FROM l)
SELECT level, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM c GROUP BY ALL""")
def log_levels(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(usage.log_fields(F.col("line"))["level"].alias("level")).agg(
        F.count("*").alias("lines"), F.count_distinct("doc_id").alias("docs"))


@register("retention", """
SELECT event_id FROM events WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 10 DAY) FROM events)""")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    log = call_log(spark, sf)
    return log.where(upkeep.expired(log, now_of(spark, sf), 10)).select(F.col("id").alias("event_id"))


@register("retention_by_size", """
WITH f AS (SELECT event_id, ts, floor(value)::BIGINT AS size, ts < (SELECT max(ts) - INTERVAL 20 DAY FROM events) AS old FROM events),
s AS (SELECT *, sum(size) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - size AS freed_before, sum(size) OVER () AS total
      FROM f WHERE NOT old)
SELECT event_id, true AS drop FROM f WHERE old UNION ALL
SELECT event_id, freed_before < total - total_cap FROM s, (SELECT 30000 AS total_cap)""")
def retention_by_size(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("path"), F.floor("value").alias("size"), F.col("ts").alias("mtime"))
    out = upkeep.retention(files, now_of(spark, sf), 20, 30000)
    return out.select(F.col("path").cast("long").alias("event_id"), "drop")
