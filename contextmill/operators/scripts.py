"""Compact views of search results, hints which to use, and a registry for user-defined ones.

Results are rows with pos (their order), name, kind, file, start_line, end_line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clamp_zero, token_estimate
from .ordered import first_per_group, top_per_group

Transform = Callable[[DataFrame], DataFrame]
FIELDS = ["name", "kind", "file", "start_line", "end_line"]

# List lengths of the compact views and the number of hints.
KIND_SAMPLES, FILE_SAMPLES, IMPACT_ROWS, MAX_HINTS = 15, 12, 20, 2


def compact_symbol_list(results: DataFrame) -> DataFrame:
    return results.select("pos", *FIELDS)


def dedupe_by_file(results: DataFrame) -> DataFrame:
    """First result per file; results without a file count as one file."""
    keyed = results.withColumn("__f", F.coalesce(F.nullif("file", F.lit("")), F.lit("?")))
    return first_per_group(keyed.select("__f", "pos", *FIELDS), ["__f"], ["pos"]).drop("__f")


def exports_only(results: DataFrame) -> DataFrame:
    first = F.substring("name", 1, 1)
    return results.where((first == F.upper(first)) & (first != F.lower(first))).select("pos", "name", "kind", "file")


def _sampled(results: DataFrame, by: str, sample: Column, k: int, out: str, counted: Column) -> DataFrame:
    """Count per group and its first k samples in result order."""
    counts = results.groupBy(by).agg(counted.alias("count"))
    head = top_per_group(results.where(sample.isNotNull()).select(by, "pos", sample.alias("__s")), [by], [F.col("pos")], k)
    lists = head.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "__s"))).alias("l"))
    return counts.join(lists.select(by, F.transform("l", lambda r: r["__s"]).alias(out)), by, "left")


def filter_by_kind(results: DataFrame) -> DataFrame:
    keyed = results.withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("unknown")))
    return _sampled(keyed, "kind", F.struct("name", "file"), KIND_SAMPLES, "symbols", F.count("*"))


def group_by_file(results: DataFrame) -> DataFrame:
    keyed = results.withColumn("file", F.coalesce(F.nullif("file", F.lit("")), F.lit("?")))
    name = F.nullif("name", F.lit(""))
    return _sampled(keyed, "file", name, FILE_SAMPLES, "names", F.count(name))


def impact_candidates(results: DataFrame) -> DataFrame:
    return results.orderBy("pos").limit(IMPACT_ROWS).select("pos", "name", "kind", "file")


@dataclass(frozen=True)
class Script:
    """A named view with the rules that suggest it."""

    id: str
    title: str
    description: str
    run: Transform
    min_results: int = 0
    query_pattern: str = ""
    tools: tuple[str, ...] = ("get_context_capsule", "search_semantic", "retrieve")


# Ids, patterns and thresholds of the built-in views. Titles and descriptions are our own.
BUILTIN = (
    Script("compact-symbol-list", "Short list", "One line per symbol: where it is and what it is", compact_symbol_list, 10),
    Script("group-by-file", "By file", "How many symbols each file has, with examples", group_by_file, 8,
           "(?i)(overview|structure|files|project map|layout)"),
    Script("filter-by-kind", "By kind", "How many symbols of each kind were found", filter_by_kind, 6,
           "(?i)(function|method|class|interface|type)"),
    Script("exports-only", "Public names", "Symbols whose names look public", exports_only, 5,
           "(?i)(export|public|api surface|entry point)"),
    Script("dedupe-by-file", "Best per file", "The first result of every file", dedupe_by_file, 12),
    Script("impact-candidates", "Starting points", "Symbols to ask the impact graph about",
           impact_candidates, 5, "(?i)(impact|depend|blast|refactor|change)"),
)


@dataclass
class ScriptRegistry:
    """Views by id; a later registration under the same id replaces the earlier one."""

    scripts: dict[str, Script] = field(default_factory=lambda: {s.id: s for s in BUILTIN})

    def register(self, script: Script, extends: str | None = None) -> None:
        """With extends, the new view runs on the output of the named one."""
        if extends is not None:
            base, own = self.scripts[extends].run, script.run
            script = Script(script.id, script.title, script.description, lambda df: own(base(df)),
                            script.min_results, script.query_pattern, script.tools)
        self.scripts[script.id] = script

    def run(self, script_id: str, results: DataFrame) -> DataFrame:
        return self.scripts[script_id].run(results)


def result_tokens(results: DataFrame, columns: list[str]) -> DataFrame:
    """One row: tokens of the rows written as one JSON list."""
    row = F.octet_length(F.to_json(F.struct(*columns)))
    return results.agg(F.floor((F.coalesce(F.sum(row + 1), F.lit(0)) + 1) / 4).cast("long").alias("tokens"))


def script_savings(results: DataFrame, output: DataFrame) -> DataFrame:
    """(data_count, data_baseline_tokens, tokens_used, tokens_saved) of running a view on results."""
    base = result_tokens(results, FIELDS).scalar()
    used = result_tokens(output, [c for c in output.columns if c != "pos"]).scalar()
    return results.agg(F.count("*").alias("data_count")).select(
        "data_count", base.alias("data_baseline_tokens"), used.alias("tokens_used"), clamp_zero(base - used).alias("tokens_saved"))


def _output_tokens(script_id: Column, n: Column, files: Column) -> Column:
    """Expected output size per view."""
    return (F.when(script_id == "compact-symbol-list", n * 25).when(script_id == "group-by-file", files * 45 + 40)
            .when(script_id == "filter-by-kind", n * 8 + 120).when(script_id == "exports-only", n * 18)
            .when(script_id == "dedupe-by-file", files * 30)
            .when(script_id == "impact-candidates", F.least(n, F.lit(IMPACT_ROWS)) * 22).otherwise(n * 20))


def hints(summaries: DataFrame, registry: ScriptRegistry | None = None) -> DataFrame:
    """At most two suggested views per request.

    summaries: query_id, tool, query, n_results, n_files, data_tokens. A view scores 10 when its query
    pattern matches and 5 plus the surplus over its minimum; ties by id.
    """
    scripts = (registry or ScriptRegistry()).scripts.values()
    n, candidates = F.col("n_results"), []
    for s in scripts:
        fits = n > 0
        score = F.lit(0)
        if s.tools:
            fits = fits & F.lower("tool").isin(*[t.lower() for t in s.tools])
        if s.min_results > 0:
            fits = fits & (n >= s.min_results)
            score = score + 5 + (n - s.min_results)
        if s.query_pattern:
            fits = fits & F.rlike("query", F.lit(s.query_pattern))
            score = score + 10
        candidates.append(F.when(fits, F.struct(
            F.lit(s.id).alias("script_id"), F.lit(s.title).alias("title"), F.lit(s.description).alias("description"),
            score.cast("long").alias("hint_score"))))
    rows = summaries.select("*", F.explode(F.filter(F.array(*candidates), lambda c: c.isNotNull())).alias("c"))
    best = top_per_group(rows.select(*summaries.columns, "c.*"), ["query_id"], [F.desc("hint_score"), F.col("script_id")], MAX_HINTS)
    out = _output_tokens(F.col("script_id"), n, F.col("n_files"))
    why = F.concat(F.col("description"), F.lit("; "), n.cast("string"), F.lit(" results — script returns ~"), out.cast("string"),
                   F.lit(" tokens vs ~"), F.col("data_tokens").cast("string"), F.lit(" in DATA"))
    return best.select("query_id", "rank", "script_id", "title", "hint_score", why.alias("why"),
                       F.col("data_tokens").alias("est_data_tokens"), out.alias("est_output_tokens"),
                       clamp_zero(F.col("data_tokens") - out).alias("est_tokens_saved"))


def result_summaries(results: DataFrame) -> DataFrame:
    """(query_id, n_results, n_files, data_tokens) of result rows."""
    row = F.octet_length(F.to_json(F.struct(*FIELDS)))
    return results.groupBy("query_id").agg(
        F.count("*").alias("n_results"), F.count_distinct(F.nullif("file", F.lit(""))).alias("n_files"),
        F.floor((F.sum(row + 1) + 1) / 4).cast("long").alias("data_tokens"))


__all__ = ["BUILTIN", "Script", "ScriptRegistry", "hints", "result_summaries", "script_savings", "token_estimate"]
