"""Dependency analysis, project maps and result scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.text import tokens
from ...operators import graph, scripts
from . import Catalogue
from .index import EDGES_SQL, page_edges, page_file
from .views import SYMBOLS_SQL, TOKENS_SQL, symbols, table

CATALOGUE = Catalogue()
register = CATALOGUE.register


@register("dead_symbols", f"""
WITH {SYMBOLS_SQL} SELECT name, file, kind FROM symbols s WHERE kind IN ('function', 'method') AND NOT EXISTS (
  SELECT 1 FROM symbols c WHERE c.file = s.file AND c.name = s.name AND c.id IN (SELECT doc_id FROM labels WHERE quality = 1))""")
def dead_symbols(spark: SparkSession, sf: str) -> DataFrame:
    syms = symbols(spark, sf)
    callers = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    calls = syms.join(callers, "id", "left_semi").select(
        F.col("file").alias("source_file"), F.col("name").alias("source_symbol"), F.lit("call").alias("kind"))
    return graph.unused_symbols(syms, calls)


# --- every link of a page and every word of a request ------------------------------------------

# one symbol per link; a page without links keeps one without a name
PAGE_SYMBOLS_SQL = """
hrefs AS (SELECT page_id, '/web/' || regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS file,
                 regexp_extract_all(html, 'href="/([^"]*)"', 1) AS names FROM pages),
psym AS (SELECT page_id, file, unnest(CASE WHEN len(names) = 0 THEN [''] ELSE names END) AS name, 'function' AS kind, page_id::INT AS start_line FROM hrefs)"""
ASKED_SQL = f"""
asked AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS symbol FROM benchmark)"""


def page_symbols(pages: DataFrame) -> DataFrame:
    names = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    return pages.select(page_file().alias("file"), F.explode_outer(names).alias("name"), "page_id").select(
        "file", F.coalesce("name", F.lit("")).alias("name"), F.lit("function").alias("kind"), F.col("page_id").cast("int").alias("start_line"))


def asked_symbols(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(tokens("text"))).alias("symbol"))


def _links_and_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return page_symbols(table(spark, sf, "pages")), asked_symbols(table(spark, sf, "benchmark"))


def _per_word(asked: DataFrame) -> DataFrame:
    """Each word as a request of its own."""
    return asked.select("symbol").distinct().select(F.col("symbol").alias("query_id"), "symbol")


_IMPACT = f"""
WITH {EDGES_SQL}, {PAGE_SYMBOLS_SQL}, {ASKED_SQL},
sym AS (SELECT DISTINCT lower(name) AS nm, file FROM psym),
pat AS (SELECT query_id, symbol AS pattern FROM asked UNION
        SELECT query_id, lower(regexp_extract(file, '[^/]*$')) FROM asked JOIN sym ON nm = symbol),
tgt AS (SELECT DISTINCT lower(target) AS text FROM edges), dpat AS (SELECT DISTINCT pattern FROM pat WHERE pattern <> '')"""


@register("impact_contains", f"""{_IMPACT},
pair AS (SELECT text, pattern FROM tgt JOIN dpat ON contains(text, pattern)),
reached AS (SELECT DISTINCT query_id, text FROM pair JOIN pat USING (pattern))
SELECT query_id, source_file, min(target) AS target, 'import' AS kind FROM edges JOIN reached ON lower(target) = text GROUP BY ALL""")
def impact_contains(spark: SparkSession, sf: str) -> DataFrame:
    syms, asked = _links_and_words(spark, sf)
    return graph.impact(page_edges(spark, sf), syms, asked)


# counted per word, so that each has its own totals
@register("impact_summary", f"""
WITH {EDGES_SQL}, {PAGE_SYMBOLS_SQL}, {ASKED_SQL}, words AS (SELECT DISTINCT symbol FROM asked),
sym AS (SELECT DISTINCT lower(name) AS nm, file FROM psym),
pat AS (SELECT symbol, symbol AS pattern FROM words UNION
        SELECT symbol, lower(regexp_extract(file, '[^/]*$')) FROM words JOIN sym ON nm = symbol),
tgt AS (SELECT DISTINCT lower(target) AS text FROM edges), dpat AS (SELECT DISTINCT pattern FROM pat WHERE pattern <> ''),
reached AS (SELECT DISTINCT symbol, text FROM (SELECT text, pattern FROM tgt JOIN dpat ON contains(text, pattern)) JOIN pat USING (pattern)),
t AS (SELECT symbol, count(DISTINCT source_file) AS total_files FROM edges JOIN reached ON lower(target) = text GROUP BY ALL),
d AS (SELECT symbol, count(*) AS defined_in FROM words JOIN sym ON nm = symbol GROUP BY ALL)
SELECT symbol, coalesce(defined_in, 0) AS defined_in, coalesce(total_files, 0) AS total_files FROM words LEFT JOIN d USING (symbol) LEFT JOIN t USING (symbol)""")
def impact_summary(spark: SparkSession, sf: str) -> DataFrame:
    syms, asked = _links_and_words(spark, sf)
    words = _per_word(asked)
    return graph.impact_summary(graph.impact(page_edges(spark, sf), syms, words), syms, words).drop("query_id")


@register("impact_basename", f"""{_IMPACT}
SELECT query_id, source_file, min(target) AS target, 'import' AS kind FROM edges JOIN pat ON pattern = regexp_extract(lower(target), '[^/]*$') GROUP BY ALL""")
def impact_basename(spark: SparkSession, sf: str) -> DataFrame:
    syms, asked = _links_and_words(spark, sf)
    return graph.impact(page_edges(spark, sf), syms, asked, exact=True)


_MAP = f"""
WITH {PAGE_SYMBOLS_SQL},
m AS (SELECT *, substr(file, 6) AS rel FROM psym),
p AS (SELECT *, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS directory, regexp_extract(rel, '[^/]*$') AS file_name FROM m)"""


@register("project_map_depth1", f"{_MAP} SELECT DISTINCT directory FROM p")
def project_map_depth1(spark: SparkSession, sf: str) -> DataFrame:
    return graph.project_map(_links_and_words(spark, sf)[0], "/web", 1)


@register("project_map_depth2", f"{_MAP} SELECT directory, file_name, count(*) AS symbols FROM p GROUP BY ALL")
def project_map_depth2(spark: SparkSession, sf: str) -> DataFrame:
    return graph.project_map(_links_and_words(spark, sf)[0], "/web", 2)


@register("project_map_depth3", f"""{_MAP}
SELECT directory, file_name, row_number() OVER (PARTITION BY directory, file ORDER BY start_line, name, kind) AS seq, name, kind FROM p""")
def project_map_depth3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.project_map(_links_and_words(spark, sf)[0], "/web", 3)


# --- scripts over result rows ------------------------------------------------------------------

# the sources stand for files, so that a file has many results; the first word keeps its case
RESULTS_SQL = r"""
res AS (SELECT doc_id AS pos, regexp_extract(text, '[\p{L}\p{N}]+') AS name, lang AS kind, source AS file, 1 AS start_line,
               len(string_split(text, chr(10)))::INT AS end_line FROM documents)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), F.regexp_extract("text", r"[\p{L}\p{N}]+", 0).alias("name"), F.col("lang").alias("kind"),
        F.col("source").alias("file"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))


@register("script_compact_list", f"WITH {RESULTS_SQL} SELECT * FROM res")
def script_compact_list(spark: SparkSession, sf: str) -> DataFrame:
    return scripts.ScriptRegistry().run("compact-symbol-list", results(spark, sf))


@register("script_dedupe_by_file", f"WITH {RESULTS_SQL} SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY file ORDER BY pos) = 1")
def script_dedupe_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return scripts.ScriptRegistry().run("dedupe-by-file", results(spark, sf))


@register("script_exports_only", f"""
WITH {RESULTS_SQL} SELECT pos, name, kind, file FROM res WHERE name <> '' AND upper(name[1]) = name[1] AND lower(name[1]) <> name[1]""")
def script_exports_only(spark: SparkSession, sf: str) -> DataFrame:
    return scripts.ScriptRegistry().run("exports-only", results(spark, sf))


@register("script_filter_by_kind", f"""
WITH {RESULTS_SQL}, n AS (SELECT kind, count(*) AS count FROM res GROUP BY ALL),
h AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY kind ORDER BY pos) <= 15)
SELECT kind, count, string_agg(name || '@' || file, ',' ORDER BY pos) AS symbols FROM h JOIN n USING (kind) GROUP BY ALL""")
def script_filter_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    out = scripts.ScriptRegistry().run("filter-by-kind", results(spark, sf))
    joined = F.array_join(F.transform("symbols", lambda s: F.concat(s["name"], F.lit("@"), s["file"])), ",")
    return out.withColumn("symbols", joined)


@register("script_group_by_file", f"""
WITH {RESULTS_SQL}, n AS (SELECT file, count(*) FILTER (name <> '') AS count FROM res GROUP BY ALL),
h AS (SELECT * FROM res WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY file ORDER BY pos) <= 12)
SELECT file, count, string_agg(name, ',' ORDER BY pos) AS names FROM n LEFT JOIN h USING (file) GROUP BY ALL""")
def script_group_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return scripts.ScriptRegistry().run("group-by-file", results(spark, sf)).withColumn("names", F.array_join("names", ","))


@register("script_impact_candidates", f"WITH {RESULTS_SQL} SELECT pos, name, kind, file FROM res ORDER BY pos LIMIT 20")
def script_impact_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return scripts.ScriptRegistry().run("impact-candidates", results(spark, sf))


_JSON = """'{"name":' || to_json(name) || ',"kind":' || to_json(kind) || ',"file":' || to_json(file) || ',"start_line":' || start_line || ',"end_line":' || end_line || '}'"""


@register("script_savings", f"""
WITH {RESULTS_SQL}, b AS (SELECT count(*) AS n, (sum(strlen({_JSON}) + 1)::BIGINT + 1) // 4 AS base FROM res),
u AS (SELECT (sum(strlen({_JSON}) + 1)::BIGINT + 1) // 4 AS used FROM (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY file ORDER BY pos) = 1))
SELECT n AS data_count, base AS data_baseline_tokens, used AS tokens_used, greatest(base - used, 0) AS tokens_saved FROM b, u""")
def script_savings(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf)
    return scripts.script_savings(rows, scripts.ScriptRegistry().run("dedupe-by-file", rows))


@register("script_hints", f"""
WITH {RESULTS_SQL}, g AS (SELECT kind, count(*) AS n, count(DISTINCT file) AS files, (sum(strlen({_JSON}) + 1)::BIGINT + 1) // 4 AS dt FROM res GROUP BY ALL),
q AS (SELECT item_id AS query_id, text || CASE WHEN contains(text, 'th') THEN ' overview of the api surface' ELSE ' function impact' END AS query,
             CASE WHEN contains(text, 'th') THEN 'en' ELSE 'fr' END AS kind FROM benchmark),
j AS (SELECT query_id, query, n, files, dt FROM q JOIN g USING (kind)),
c AS (SELECT *, unnest([{{'id': 'compact-symbol-list', 'm': 10, 'p': '', 'o': n * 25}}, {{'id': 'group-by-file', 'm': 8, 'p': '(?i)(overview|structure|files|project map|layout)', 'o': files * 45 + 40}},
   {{'id': 'filter-by-kind', 'm': 6, 'p': '(?i)(function|method|class|interface|type)', 'o': 120 + n * 8}}, {{'id': 'exports-only', 'm': 5, 'p': '(?i)(export|public|api surface|entry point)', 'o': n * 18}},
   {{'id': 'dedupe-by-file', 'm': 12, 'p': '', 'o': files * 30}}, {{'id': 'impact-candidates', 'm': 5, 'p': '(?i)(impact|depend|blast|refactor|change)', 'o': least(n, 20) * 22}}]) AS s FROM j),
r AS (SELECT query_id, s.id AS script_id, 5 + n - s.m + CASE WHEN s.p <> '' THEN 10 ELSE 0 END AS hint_score, dt, s.o AS o
      FROM c WHERE n >= s.m AND (s.p = '' OR regexp_matches(query, s.p)))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hint_score DESC, script_id) AS rank, script_id, hint_score,
       dt AS est_data_tokens, o AS est_output_tokens, greatest(dt - o, 0) AS est_tokens_saved FROM r QUALIFY rank <= 2""")
def script_hints(spark: SparkSession, sf: str) -> DataFrame:
    sizes = scripts.result_summaries(results(spark, sf).withColumn("query_id", F.col("kind"))).withColumnRenamed("query_id", "kind")
    th = F.contains("text", F.lit("th"))
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("retrieve").alias("tool"),
        F.concat("text", F.when(th, " overview of the api surface").otherwise(" function impact")).alias("query"),
        F.when(th, "en").otherwise("fr").alias("kind"))
    return scripts.hints(asked.join(sizes, "kind").drop("kind")).drop("title", "why")
