"""Index statistics, consistency joins, scopes, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...functions.globs import DEFAULT_IGNORES, any_glob, excluded_project, walkable
from ...functions.languages import language_of
from ...functions.scalars import embed_hash, micros
from ...functions.text import line_range
from ...operators import backlog, filters, upkeep, usage
from ...operators import symbols as extraction
from ...operators.chunking import url_path
from ...session import scratch_dir, spread_small
from ...sources.store import Store
from . import Catalogue
from .usage import LOG_SQL, call_log
from .views import SYMBOLS_SQL, symbols, table

CATALOGUE = Catalogue()
register = CATALOGUE.register

HASH_SQL = "substr(sha256(encode(kind || ' ' || name || ': ') || array_slice(encode(source), 1, 500)), 1, 32)"
HASHED_SQL = f"""{SYMBOLS_SQL},
hashed AS (SELECT *, CASE WHEN strlen(source) < 100 THEN '' ELSE {HASH_SQL} END AS embed_hash FROM symbols)"""
EDGES_SQL = """
edges AS (SELECT '/web/' || regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS source_file,
                 unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, 'import' AS kind FROM pages)"""


def hashed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    h = F.when(F.octet_length("source") < 100, "").otherwise(embed_hash("kind", "name", "source"))
    return symbols(spark, sf).withColumn("embed_hash", h)


def page_file(url: str = "url"):
    host = F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)
    return F.concat(F.lit("/web/"), host, url_path(url))


def page_edges(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select(page_file().alias("source_file"), F.explode(hrefs).alias("target"),
                                            F.lit("import").alias("kind"), F.lit(None).cast("string").alias("source_symbol"),
                                            F.lit("/web").alias("project_path"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the first 500 documents; those with a high label were computed from older text."""
    v = table(spark, sf, "embeddings")
    syms = hashed_symbols(spark, sf).select(F.col("id").alias("vec_id"), "embed_hash", "project_path")
    joined = v.select("vec_id", "label").join(syms, "vec_id")
    return joined.select(F.col("vec_id").alias("symbol_id"), "project_path", F.lit("code").alias("doc_type"),
                         F.when(F.col("label") < 7, F.col("embed_hash")).otherwise("old").alias("content_hash"))


@register("kind_counts", f"WITH {SYMBOLS_SQL} SELECT kind, count(*) AS count FROM symbols GROUP BY ALL")
def kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return usage.kind_counts(symbols(spark, sf))


@register("language_stats", f"""
WITH {SYMBOLS_SQL} SELECT CASE WHEN file ILIKE '%.py' THEN 'Python' WHEN file ILIKE '%.go' THEN 'Go'
  WHEN file ILIKE '%.ts' THEN 'TypeScript' WHEN file ILIKE '%.sh' THEN 'Bash' ELSE 'Other' END AS language,
  count(DISTINCT file) AS files, count(*) AS symbols FROM symbols GROUP BY ALL""")
def language_stats(spark: SparkSession, sf: str) -> DataFrame:
    return usage.language_stats(symbols(spark, sf))


@register("top_imports", f"WITH {EDGES_SQL} SELECT target, count(*) AS count FROM edges GROUP BY ALL ORDER BY count DESC, target LIMIT 20")
def top_imports(spark: SparkSession, sf: str) -> DataFrame:
    return usage.top_imports(page_edges(spark, sf))


@register("index_stats", f"""
WITH {SYMBOLS_SQL}, {EDGES_SQL} SELECT count(*) AS total_symbols, count(DISTINCT file) AS total_files, (SELECT count(*) FROM edges) AS total_edges,
  (SELECT count(*) FROM embeddings) AS total_vectors, (SELECT count(*) * 64 * 4 / 1048576 FROM embeddings) AS vector_memory_mb FROM symbols""")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return usage.index_health(symbols(spark, sf), page_edges(spark, sf), table(spark, sf, "embeddings"), 64)


@register("vector_stats", "SELECT count(*) AS total_vectors, count(*) * 64 * 4 / 1048576 AS memory_mb FROM embeddings")
def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return usage.vector_stats(table(spark, sf, "embeddings"), 64)


@register("project_full_outer", f"""
WITH {SYMBOLS_SQL}, {LOG_SQL},
s AS (SELECT project_path, count(*) AS sc, count(DISTINCT file) AS fc FROM symbols GROUP BY ALL),
q AS (SELECT project_path, count(*) AS qc FROM log WHERE project_path NOT IN ('', '.') GROUP BY ALL),
d AS (SELECT DISTINCT '/found/' || n_name AS project_path FROM nation)
SELECT project_path, coalesce(sc, 0) AS symbol_count, coalesce(fc, 0) AS file_count, coalesce(qc, 0) AS query_count,
       regexp_extract(project_path, '[^/]*$') AS label
FROM s FULL JOIN q USING (project_path) FULL JOIN d USING (project_path)""")
def project_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "nation").select(F.concat(F.lit("/found/"), "n_name").alias("project_path"))
    return usage.project_overview(symbols(spark, sf), call_log(spark, sf), found)


@register("called_projects", f"""
WITH {SYMBOLS_SQL}, {LOG_SQL}, s AS (SELECT project_path, count(*) AS sc, count(DISTINCT file) AS fc FROM symbols GROUP BY ALL)
SELECT project_path, count(*) AS query_count, coalesce(any_value(sc), 0) AS symbol_count, coalesce(any_value(fc), 0) AS file_count,
       regexp_extract(project_path, '[^/]*$') AS name FROM log LEFT JOIN s USING (project_path) GROUP BY project_path""")
def called_projects(spark: SparkSession, sf: str) -> DataFrame:
    return usage.called_projects(symbols(spark, sf), call_log(spark, sf))


@register("scope_index_stats", f"""
WITH {SYMBOLS_SQL}, links AS (SELECT '/src/src' || n_regionkey AS parent, '/src/src' || (n_nationkey - 5) AS child FROM nation WHERE n_nationkey > 9),
roots AS (SELECT '/src/src' || r_regionkey AS root FROM region),
scope AS (SELECT root, root AS project_path FROM roots UNION SELECT root, child FROM roots JOIN links ON parent = root),
c AS (SELECT project_path, count(*) AS sc, count(DISTINCT file) AS fc FROM symbols GROUP BY ALL)
SELECT root, coalesce(sum(sc) FILTER (root = project_path), 0)::BIGINT AS own_nodes, coalesce(sum(fc) FILTER (root = project_path), 0)::BIGINT AS own_files,
       coalesce(sum(sc), 0)::BIGINT AS total_nodes, coalesce(sum(fc), 0)::BIGINT AS total_files FROM scope LEFT JOIN c USING (project_path) GROUP BY root""")
def scope_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    def path(n):
        return F.concat(F.lit("/src/src"), n.cast("string"))

    links = table(spark, sf, "nation").where("n_nationkey > 9").select(
        path(F.col("n_regionkey")).alias("parent_path"), path(F.col("n_nationkey") - 5).alias("child_path"))
    roots = table(spark, sf, "region").select(path(F.col("r_regionkey")).alias("root"))
    return usage.scope_index_stats(symbols(spark, sf), filters.scope_paths(links, roots))


@register("missing_vectors", f"""
WITH {HASHED_SQL},
v AS (SELECT vec_id AS symbol_id, project_path, CASE WHEN label < 7 THEN embed_hash ELSE 'old' END AS content_hash
      FROM embeddings JOIN hashed ON id = vec_id)
SELECT DISTINCT file, project_path FROM hashed h WHERE embed_hash <> '' AND NOT EXISTS (
  SELECT 1 FROM v WHERE v.project_path = h.project_path AND v.content_hash = h.embed_hash)
UNION SELECT file, project_path FROM hashed h WHERE embed_hash = '' AND NOT EXISTS (
  SELECT 1 FROM v WHERE v.project_path = h.project_path AND v.symbol_id = h.id)""")
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.missing_vectors(hashed_symbols(spark, sf), vectors(spark, sf))


@register("orphan_vectors", "SELECT vec_id AS symbol_id, label FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)")
def orphan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("symbol_id"), "label")
    return upkeep.orphan_vectors(vecs, table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@register("stale_pending", f"""
WITH {SYMBOLS_SQL}, kept AS (SELECT file, project_path FROM symbols WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 0)),
pending AS (SELECT file, project_path FROM symbols WHERE kind = 'class')
SELECT file, project_path FROM pending p WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.file = p.file AND k.project_path = p.project_path)""")
def stale_pending(spark: SparkSession, sf: str) -> DataFrame:
    syms = symbols(spark, sf)
    clean = table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("id"))
    return upkeep.stale_pending(syms.where("kind = 'class'").select("file", "project_path"), syms.join(clean, "id", "left_semi"))


@register("catchup_diff", f"""
WITH {SYMBOLS_SQL},
disk AS (SELECT file, length(source) AS mtime FROM symbols),
indexed AS (SELECT file, 900 AS indexed_at FROM symbols WHERE id IN (SELECT doc_id FROM labels)
            UNION ALL SELECT '/src/page_' || page_id, 900 FROM pages)
SELECT file, CASE WHEN indexed_at IS NULL THEN 'new' WHEN mtime IS NULL THEN 'deleted' WHEN mtime > indexed_at THEN 'modified' ELSE 'unchanged' END AS status
FROM disk FULL JOIN indexed USING (file)""")
def catchup_diff(spark: SparkSession, sf: str) -> DataFrame:
    syms = symbols(spark, sf)
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    indexed = syms.join(known, "id", "left_semi").select("file", F.lit(900).alias("indexed_at")).unionByName(
        table(spark, sf, "pages").select(F.concat(F.lit("/src/page_"), F.col("page_id").cast("string")).alias("file"), F.lit(900).alias("indexed_at")))
    return upkeep.catch_up(syms.select("file", F.length("source").alias("mtime")), indexed)


@register("upsert_latest", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return upkeep.latest_by_key(log, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@register("links_scope", f"""
WITH {EDGES_SQL}, p AS (SELECT DISTINCT project_path FROM (
   SELECT regexp_replace(source_file, '/[^/]*$', '') AS project_path FROM edges UNION ALL
   SELECT regexp_extract(source_file, '^/web/[^/]*') FROM edges) WHERE project_path NOT IN ('', '.'))
SELECT a.project_path AS parent_path, b.project_path AS child_path FROM p a JOIN p b ON starts_with(b.project_path, a.project_path || '/')""")
def links_scope(spark: SparkSession, sf: str) -> DataFrame:
    file = page_edges(spark, sf).select("source_file").distinct()
    paths = file.select(F.regexp_replace("source_file", "/[^/]*$", "").alias("project_path")).unionByName(
        file.select(F.regexp_extract("source_file", "^/web/[^/]*", 0).alias("project_path")))
    return filters.auto_links(paths)


@register("purge_links", f"""
WITH {EDGES_SQL}, f AS (SELECT DISTINCT source_file AS file, regexp_extract(source_file, '^/web/[^/]*') AS site FROM edges),
r AS (SELECT '/web' AS project_path, file, length(site) % 2 = 0 AS gone FROM f UNION SELECT site, file, false FROM f)
SELECT project_path, file FROM r WHERE NOT gone""")
def purge_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every page is kept under /web and under its site; half of the sites (names of even length) are linked below /web."""
    site = F.regexp_extract("source_file", "^/web/[^/]*", 0)
    files = page_edges(spark, sf).select(F.col("source_file").alias("file"), site.alias("site")).distinct()
    rows = files.select(F.explode(F.array(F.lit("/web"), "site")).alias("project_path"), "file").distinct()
    links = files.where(F.length("site") % 2 == 0).select(F.lit("/web").alias("parent_path"), F.col("site").alias("child_path")).distinct()
    return filters.purge_parent_duplicates(rows, links)


@register("compacted_latest", """
SELECT user_id::VARCHAR AS project_path, event_type AS name, max(event_id)::VARCHAR AS summary_text, ts AS created_at FROM events
GROUP BY user_id, event_type, ts QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1""")
def compacted_latest(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of a stored log of events after two batches, a compaction between and one after them."""
    store = Store(spark, scratch_dir(spark, "compacted"))
    events = table(spark, sf, "events").groupBy("user_id", "event_type", "ts").agg(F.max("event_id").alias("event_id"))
    rows = events.select(F.lit("calls").alias("file"), F.col("user_id").cast("string").alias("project_path"), F.col("event_type").alias("name"),
                         F.col("event_id").cast("string").alias("summary_text"), F.col("ts").alias("created_at"), "event_id")
    for batch in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        store.append("summaries", rows.where(batch))
        store.compact(("summaries",))
    return store.read("summaries").select("project_path", "name", "summary_text", "created_at")


@register("owning_project", """
WITH f AS (SELECT page_id, url, '/web/' || regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS file FROM pages),
c AS (SELECT DISTINCT regexp_extract(file, '^/web/[^/]*') AS child FROM f UNION
      SELECT regexp_extract(file, '^/web/[^/]*/[^/]*') FROM f WHERE starts_with(url, 'https'))
SELECT page_id, file, coalesce(max_by(child, length(child)), '/web') AS owner
FROM f LEFT JOIN c ON file = child OR starts_with(file, child || '/') GROUP BY page_id, file""")
def owning_project(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select("page_id", "url", page_file().alias("file"))
    child = files.select(F.regexp_extract("file", "^/web/[^/]*", 0).alias("child_path")).unionByName(
        files.where(F.startswith("url", F.lit("https"))).select(F.regexp_extract("file", "^/web/[^/]*/[^/]*", 0).alias("child_path")))
    links = child.distinct().select(F.lit("/web").alias("parent_path"), "child_path")
    return filters.owning_project(files, links, "/web").select("page_id", "file", "owner")


@register("glob_filter", r"""
WITH f AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://(.*)$', 1) AS rel FROM pages)
SELECT page_id, rel FROM f WHERE NOT (contains('/' || rel || '/', '/en/') OR regexp_matches(rel, '(^|/)[^/]*\.html$'))""")
def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    rel = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-zA-Z]+://(.*)$", 1).alias("rel"))
    return rel.where(~any_glob("rel", ["**/en/**", "*.html", *DEFAULT_IGNORES]) & walkable("rel"))


@register("exclude_filter", r"""
WITH f AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+:/(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM f WHERE NOT (regexp_extract(path, '[^/]*$') = '' OR starts_with(path, '/spam-farm.example.org/'))""")
def exclude_filter(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-zA-Z]+:/(/[^?#]*)", 1).alias("path"))
    return paths.where(~excluded_project("path", ["basename:", "/spam-farm.example.org"]))


@register("source_range", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) >= 4 THEN array_to_string(ls[2:4], chr(10)) ELSE '' END AS piece FROM l""")
def source_range(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", line_range("text", F.lit(2), F.lit(4)).alias("piece"))


@register("file_languages", f"""
WITH {SYMBOLS_SQL} SELECT id, CASE regexp_extract(file, '\\.[^.]+$') WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' ELSE 'bash' END AS language FROM symbols""")
def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("id", language_of("file").alias("language"))


# --- extraction from files that Spark writes out of the documents ------------------------------

QUOTES = '"' * 3


def _escaped(line: Column) -> Column:
    """Text for a place between double quotes: backslashes and quotes get a backslash in Python and YAML alike."""
    return F.regexp_replace(line, r'(["\\])', r"\\$1")


def _python_files(docs: DataFrame, written=lambda line: line) -> DataFrame:
    block = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.when(i % 2 == 1, F.lit("@cached\n")).otherwise(F.lit("")), F.lit("def fn_"), (i + 1).cast("string"),
        F.lit(f"(arg):\n    {QUOTES}"), written(line), F.lit(f"{QUOTES}\n    return arg\n")))
    content = F.concat(F.lit("import "), "source", F.lit(", sys\nfrom ."), "lang", F.lit(" import x\n\n"), F.array_join(block, "\n"))
    return docs.select(F.concat(F.lit("/gen/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"),
                       F.lit("/gen").alias("project_path"), content.alias("content"))


@register("symbols_python", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
b AS (SELECT *, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS deco FROM l),
s AS (SELECT *, 4 + coalesce(sum(4 + deco) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_line FROM b)
SELECT '/gen/doc_' || doc_id || '.py' AS file, 'fn_' || n AS name, 'function' AS kind, start_line, start_line + 2 + deco AS end_line,
       'doc_' || doc_id || '.py.fn_' || n AS fqn,
       CASE WHEN deco = 1 THEN '@cached' ELSE 'def fn_' || n || '(arg):' || chr(10) || '    ' || repeat(chr(34), 3)
         || replace(replace(line, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || repeat(chr(34), 3) END AS skeleton
FROM s""")
def symbols_python(spark: SparkSession, sf: str) -> DataFrame:
    return python_symbols(spread_small(table(spark, sf, "documents")))


def python_symbols(docs: DataFrame) -> DataFrame:
    """One function for every line of documents, quotes and backslashes escaped."""
    return extraction.extract_symbols(_python_files(docs, _escaped)).select(
        "file", "name", "kind", "start_line", "end_line", "fqn", "skeleton")


@register("import_edges", """
SELECT '/gen/doc_' || doc_id || '.py' AS source_file, unnest([source, 'sys', '.' || lang]) AS target, 'import' AS kind FROM documents""")
def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract_imports(_python_files(spread_small(table(spark, sf, "documents")))).select("source_file", "target", "kind")


@register("yaml_symbols", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n,
                  len(string_split(text, chr(10))) AS total FROM documents),
tasks AS (SELECT doc_id, CASE WHEN n % 2 = 0 THEN 'line ' || n ELSE 'tasks[' || (n - 1) || ']' END AS name, 'task' AS kind,
                 (4 + (n - 1) // 2 * 4 + (n - 1) % 2 * 2 )::INT AS start_line, n FROM l),
plays AS (SELECT DISTINCT doc_id, 'doc ' || doc_id AS name, 'play' AS kind, 1 AS start_line, 0 AS n FROM l)
SELECT '/gen/doc_' || doc_id || '.yml' AS file, name, kind, start_line FROM tasks UNION ALL
SELECT '/gen/doc_' || doc_id || '.yml', name, kind, start_line FROM plays""")
def yaml_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract_symbols(_yaml_files(spread_small(table(spark, sf, "documents")))).select("file", "name", "kind", "start_line")


def _yaml_files(docs: DataFrame) -> DataFrame:
    """A play per document with a task per line, named or not, whose message is the line."""
    task = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.when(
        i % 2 == 1, F.concat(F.lit("    - name: line "), (i + 1).cast("string"), F.lit('\n      debug: {msg: "'), _escaped(line), F.lit('"}')))
        .otherwise(F.concat(F.lit('    - debug:\n        msg: "'), _escaped(line), F.lit('"')))))
    content = F.concat(F.lit("- name: doc "), F.col("doc_id").cast("string"), F.lit("\n  hosts: all\n  tasks:\n"), F.array_join(task, "\n"))
    return docs.select(F.concat(F.lit("/gen/doc_"), F.col("doc_id").cast("string"), F.lit(".yml")).alias("file"),
                       F.lit("/gen").alias("project_path"), content.alias("content"))


# one declaration of four lines per line of text, by language; brackets in its strings and comments do not count
_BLOCKS = (
    ("go", "type S_{n} struct {\n\tA string // } \"{line}\"\n\tB struct{ C int }\n}"),
    ("ts", "export class K_{n} {\n  a = \"} {line}\";\n  b() { return \"{\"; }\n}"),
    ("js", "function g_{n}(x) {\n  const a = \"} {line}\";\n  return /[{]/;\n}"),
    ("sh", "f_{n}() {\n  echo \"} {line}\"\n  cat <<< \"{\" # {\n}"),
    ("tf", "resource \"k\" \"{n}\" {\n  a = \"} {line}\"\n  b { c = \"{\" }\n}"),
)


@register("skeletons", r"""
WITH l AS (SELECT doc_id, doc_id % 5 AS k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
q AS (SELECT *, '"} ' || replace(replace(line, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS s FROM l)
SELECT '/gen/doc_' || doc_id || '.' || ['go', 'ts', 'js', 'sh', 'tf'][k + 1] AS file, ['S_', 'K_', 'g_', 'f_', 'k.'][k + 1] || n AS name,
       ['struct', 'class', 'function', 'function', 'resource'][k + 1] AS kind, (4 * n - 3)::INT AS start_line, (4 * n)::INT AS end_line,
       CASE k WHEN 0 THEN 'type S_' || n || ' struct {' || chr(10) || chr(9) || 'A string // } "' || s[4:] || chr(10) || '}'
              WHEN 1 THEN 'export class K_' || n || ' {' || chr(10) || '  a = ' || s || ';' || chr(10) || '}'
              WHEN 2 THEN 'function g_' || n || '(x)' WHEN 3 THEN 'f_' || n || '() {'
              ELSE 'resource "k" "' || n || '" {' || chr(10) || '  a' || chr(10) || '}' END AS skeleton FROM q""")
def skeletons(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_small(table(spark, sf, "documents"))

    def written(template: str) -> Column:
        before, rest = template.split("{n}")
        middle, after = rest.split("{line}")
        return F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(
            F.lit(before), (i + 1).cast("string"), F.lit(middle), _escaped(line), F.lit(after))), "\n")

    turn = F.pmod("doc_id", F.lit(len(_BLOCKS)))
    ending = content = F.lit(None).cast("string")
    for i, (suffix, template) in enumerate(_BLOCKS):
        ending = F.when(turn == i, suffix).otherwise(ending)
        content = F.when(turn == i, written(template)).otherwise(content)
    files = docs.select(F.concat(F.lit("/gen/doc_"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("file"),
                        F.lit("/gen").alias("project_path"), content.alias("content"))
    return extraction.extract_symbols(files).select("file", "name", "kind", "start_line", "end_line", "skeleton")


@register("fish_symbols", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT '/gen/doc_' || doc_id || '.fish' AS file, 'f_' || n AS name, (1 + (n - 1) * 5)::INT AS start_line, (5 + (n - 1) * 5)::INT AS end_line FROM l""")
def fish_symbols(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_small(table(spark, sf, "documents"))
    block = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.lit("function f_"), (i + 1).cast("string"), F.lit("\n  if true\n    # "), line, F.lit("\n  end\nend")))
    files = docs.select(F.concat(F.lit("/gen/doc_"), F.col("doc_id").cast("string"), F.lit(".fish")).alias("file"),
                        F.lit("/gen").alias("project_path"), F.array_join(block, "\n").alias("content"))
    return extraction.extract_symbols(files).select("file", "name", "start_line", "end_line")


@register("analyze_complexity", f"""
WITH {SYMBOLS_SQL}, c AS (SELECT name, file, kind, 1 + len(regexp_extract_all(source, '\\b(?:if|elif|for|while|case|catch|except|when|switch)\\b|&&|\\|\\||\\?\\s')) AS complexity FROM symbols)
SELECT * FROM c WHERE complexity >= 2 ORDER BY complexity DESC, file, name LIMIT 20""")
def analyze_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.analyze_complexity(symbols(spark, sf), 2, 20)


# --- backlog of embeddings ---------------------------------------------------------------------

_BACKLOG_SQL = """
WITH clock AS (SELECT max(ts) AS now FROM events),
units AS (SELECT 'code' AS kind, 'doc' || doc_id AS unit, source AS project_path, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS changed_at, doc_id FROM documents),
missing AS (SELECT kind, unit, project_path, changed_at FROM units WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) OR doc_id % 3 = 0),
requests AS (SELECT 'doc' || doc_id AS unit, project_path, 0 AS lane, now - to_seconds(doc_id % 300) AS requested_at FROM labels JOIN units USING (doc_id), clock WHERE quality = 1
    UNION ALL SELECT '', source, 1, now - to_seconds(100) FROM (SELECT min(source) AS source FROM documents), clock),
attempts AS (SELECT u.unit, u.project_path, event_type = 'purchase' AS ok, ts AS attempted_at FROM events e JOIN units u ON u.doc_id = e.user_id),
settled AS (SELECT unit, project_path, max(attempted_at) AS settled_at FROM attempts WHERE ok GROUP BY ALL),
failed AS (SELECT a.unit, a.project_path, count(*) AS failures, max(attempted_at) AS failed_at FROM attempts a JOIN missing m USING (unit, project_path)
           LEFT JOIN settled s USING (unit, project_path) WHERE NOT ok AND attempted_at >= greatest(coalesce(settled_at, changed_at), changed_at) GROUP BY ALL),
lanes AS (SELECT unit, project_path, min(lane) AS lane FROM requests, clock WHERE requested_at > now - INTERVAL 120 SECOND GROUP BY ALL),
todo AS (SELECT m.kind, m.unit, m.project_path, least(coalesce(u.lane, 2), coalesce(p.lane, 2)) AS lane, coalesce(failures, 0) AS failures,
                CASE WHEN failures > 0 THEN failed_at + to_seconds(86400 * (1 << (least(failures, 4) - 1)::INT)) END AS next_at
         FROM missing m LEFT JOIN failed f USING (unit, project_path) LEFT JOIN lanes u ON u.unit = m.unit AND u.project_path = m.project_path
         LEFT JOIN lanes p ON p.unit = '' AND p.project_path = m.project_path),
stated AS (SELECT todo.*, CASE WHEN failures >= 4 THEN 'dead' WHEN next_at > now THEN 'waiting' ELSE 'ready' END AS state FROM todo, clock)"""


def _backlog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents stand for files: a third of them changed since, some were asked for, events of a number are attempts."""
    docs, events = table(spark, sf, "documents"), table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now")).scalar()
    key = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("unit")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
    units = docs.select(F.lit("code").alias("kind"), key, F.col("source").alias("project_path"), at.alias("changed_at"), "doc_id")
    have = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")).where(F.col("doc_id") % 3 != 0)
    back = lambda n: now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))
    asked = table(spark, sf, "labels").where("quality = 1").join(units, "doc_id").select("kind", "unit", "project_path", F.lit(0).alias("lane"), back(F.col("doc_id") % 300).alias("requested_at"))
    whole = docs.agg(F.min("source").alias("project_path")).select(F.lit("code").alias("kind"), F.lit("").alias("unit"), "project_path", F.lit(1).alias("lane"), back(F.lit(100)).alias("requested_at"))
    tried = events.join(units, events["user_id"] == units["doc_id"]).select("kind", "unit", "project_path", (F.col("event_type") == "purchase").alias("ok"), F.col("ts").alias("attempted_at"))
    missing = units.join(have, "doc_id", "left_anti").drop("doc_id")
    return units, backlog.backlog(missing, asked.unionByName(whole), tried, now, backlog.Retries(4, 86_400, 120))


@register("embed_backlog", f"{_BACKLOG_SQL} SELECT unit, project_path, lane, failures, epoch_us(next_at) AS next_us, state FROM stated")
def embed_backlog(spark: SparkSession, sf: str) -> DataFrame:
    return _backlog(spark, sf)[1].select("unit", "project_path", "lane", "failures", micros("next_at").alias("next_us"), "state")


@register("scope_freshness", f"""{_BACKLOG_SQL},
e AS (SELECT project_path, count(*) AS units FROM units GROUP BY ALL),
l AS (SELECT project_path, count(*) AS missing, count_if(state = 'waiting') AS waiting, count_if(state = 'dead') AS dead FROM stated GROUP BY ALL)
SELECT project_path, units, coalesce(missing, 0) AS missing, coalesce(waiting, 0) AS waiting, coalesce(dead, 0) AS dead, coalesce(missing, 0) = coalesce(dead, 0) AS fresh
FROM e LEFT JOIN l USING (project_path)""")
def scope_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return backlog.freshness(*_backlog(spark, sf)).drop("kind")
