"""Document cleaning, chunking, scalar functions and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.scalars import content_hash, token_estimate
from ...functions.vectors import l2_normalize
from ...operators import chunking, packing
from ...session import spread_small
from .. import retrieve as plan
from . import Catalogue
from .search import CAPSULE_SESSION, DIMS, capsule_inputs, hybrid_sql
from .views import bm25_sql, table

CATALOGUE = Catalogue()
register = CATALOGUE.register

STRIP_SQL = r"regexp_replace(regexp_replace({0}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
TEXT_SQL = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_RE = r"'(?is)<h([1-4])[^>]*>(.*?)</h([1-4])>'"

SECTIONS_SQL = rf"""
stripped AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, {STRIP_SQL.format('html')} AS h FROM pages),
heads AS (SELECT page_id, path, h, regexp_extract_all(h, {_RE}, 1) AS os, regexp_extract_all(h, {_RE}, 2) AS ts,
                 regexp_extract_all(h, {_RE}, 3) AS cs, regexp_split_to_array(h, {_RE}) AS bs FROM stripped),
cut AS (SELECT page_id, path, unnest(range(1, len(os) + 1)) AS i, os, ts, cs, bs FROM heads),
named AS (SELECT page_id, path, i, {TEXT_SQL.format('ts[i]')} AS t, os[i] AS o, {TEXT_SQL.format('bs[i + 1]')} AS content
          FROM cut WHERE os[i] = cs[i]),
found AS (SELECT page_id, path, row_number() OVER (PARTITION BY page_id ORDER BY i) AS section_no,
                 t || ' (h' || o || ')' AS title, content FROM named WHERE t <> '' AND content <> ''),
sections AS (SELECT * FROM found UNION ALL BY NAME
             SELECT page_id, path, 1 AS section_no, content, CASE WHEN regexp_matches(h, '(?is)<title[^>]*>(.*?)</title>')
               THEN {TEXT_SQL.format("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} ELSE path END AS title
             FROM (SELECT *, {TEXT_SQL.format('h')} AS content FROM stripped)
             WHERE page_id NOT IN (SELECT page_id FROM found) AND content <> '')"""

def _cut_sql(text: str, at: str) -> str:
    """Byte offset moved back to the start of the character it would split."""
    def inside(offset: str) -> str:
        return f"hex(array_slice(encode({text}), {offset} + 1, {offset} + 1)) BETWEEN '80' AND 'BF'"

    tries = " ".join(f"WHEN NOT ({inside(f'({at} - {k})')}) THEN {at} - {k}" for k in range(3))
    return f"CASE WHEN {at} >= strlen({text}) THEN strlen({text}) {tries} ELSE {at} - 3 END"


def _piece_sql(text: str) -> str:
    """Piece j of a text cut every 2000 bytes, as a blob."""
    return f"array_slice(encode({text}), {_cut_sql(text, '(j * 2000)')} + 1, {_cut_sql(text, '(j * 2000 + 2000)')})"


# a cleaned HTML section holds no line break, so it is one paragraph: hard cuts only
CHUNKS_SQL = SECTIONS_SQL + rf""",
pieces AS (SELECT *, unnest(range(0, greatest((strlen(content) - 1) // 2000 + 1, 1))) AS j FROM sections),
chunks AS (SELECT page_id, path, section_no, j + 1 AS part_no,
             trim(title) || CASE WHEN strlen(content) > 2000 THEN ' (part ' || (j + 1) || ')' ELSE '' END AS title,
             {_piece_sql('content')} AS piece
           FROM pieces)"""


@register("html_clean", f"SELECT page_id, {TEXT_SQL.format(STRIP_SQL.format('html'))} AS text FROM pages")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", chunking.html_text("html").alias("text"))


@register("html_sections", f"WITH {SECTIONS_SQL} SELECT page_id, path, section_no, title, content FROM sections")
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread_small(table(spark, sf, "pages")).select("page_id", chunking.url_path("url").alias("path"), "html")
    out = pages.select("page_id", "path", F.posexplode(chunking.page_sections("html", "path")).alias("i", "s"))
    return out.select("page_id", "path", (F.col("i") + 1).alias("section_no"), "s.title", "s.content").where("content <> ''")


@register("page_chunks", f"WITH {CHUNKS_SQL} SELECT page_id, section_no, part_no, title, octet_length(piece) AS bytes, sha256(piece) AS hash FROM chunks")
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.page_chunks(spread_small(table(spark, sf, "pages")))
    return chunks.select("page_id", "section_no", "part_no", "title", F.octet_length("content").alias("bytes"),
                         F.sha2("content", 256).alias("hash"))


@register("chunk_long", rf"""
WITH body AS (SELECT doc_id, 'doc ' || doc_id AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
pieces AS (SELECT *, unnest(range(0, (strlen(t) - 1) // 2000 + 1)) AS j FROM body
           WHERE t <> '' AND NOT regexp_matches(t, '\n\s*\n'))
SELECT doc_id, j + 1 AS part_no, title || CASE WHEN strlen(t) > 2000 THEN ' (part ' || (j + 1) || ')' ELSE '' END AS title,
       octet_length(piece) AS bytes, sha256(piece) AS hash
FROM (SELECT *, {_piece_sql('t')} AS piece FROM pieces)""")
def chunk_long(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_small(table(spark, sf, "documents"))
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    out = docs.select("doc_id", F.posexplode(chunking.split_long(title, F.col("text"))).alias("j", "c"))
    return out.select("doc_id", (F.col("j") + 1).alias("part_no"), "c.title",
                      F.octet_length("c.content").alias("bytes"), F.sha2("c.content", 256).alias("hash"))


@register("markdown_sections", r"""
WITH md AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
-- every line becomes a section: heading with the line number, the line as its text
sec AS (SELECT doc_id, n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS body FROM md)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS section_no, 'Line ' || n AS title, body AS content
FROM sec WHERE body <> ''""")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_small(table(spark, sf, "documents"))
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.when(i % 2 == 0, F.lit("# Line ")).otherwise(F.lit("  ## Line ")), (i + 1).cast("string"), F.lit("\n"), line))
    md = docs.select("doc_id", F.array_join(numbered, "\n").alias("md"))
    out = md.select("doc_id", F.posexplode(chunking.markdown_sections("md", F.lit("none"))).alias("i", "s"))
    return out.select("doc_id", (F.col("i") + 1).alias("section_no"), "s.title", "s.content")


@register("json_chunks", """
SELECT event_id, 'k' AS title, props->>'k' AS content FROM events""")
def json_chunks(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "props", F.lit("props").alias("path"))
    return chunking.json_sections(events, "props", "path").select("event_id", "title", "content")


@register("content_hash", "SELECT doc_id, substr(sha256(text), 1, 32) AS hash FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", content_hash("text").alias("hash"))


@register("token_estimate", "SELECT doc_id, strlen(text) // 4 AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", token_estimate("text").alias("tokens"))


@register("l2_normalize", """
SELECT vec_id, unnest(range(1, len(v) + 1)) - 1 AS dim, round(unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS x
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def l2_normalized(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings").select("vec_id", F.posexplode(l2_normalize("embedding")).alias("dim", "x"))
    return vecs.select("vec_id", "dim", F.round("x", 9).alias("x"))


@register("budget_prefix", """
SELECT lang, doc_id, cum_tokens FROM (
  SELECT lang, doc_id, sum(strlen(text) // 4) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum_tokens FROM documents)
WHERE cum_tokens <= 40000""")
def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "doc_id", "n_chars", token_estimate("text").alias("tokens"))
    out = packing.budget_prefix_unbounded(docs, ["lang"], -F.col("n_chars"), [F.desc("n_chars"), F.col("doc_id")],
                                          F.col("tokens"), 40000)
    return out.select("lang", "doc_id", "cum_tokens")


@register("budget_first_admitted", """
SELECT conv_id, turn, cum_tokens FROM (
  SELECT conv_id, turn, row_number() OVER w AS rn, sum(strlen(text) // 4) OVER (w
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum_tokens
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
WHERE cum_tokens <= 100 OR rn = 1""")
def budget_first_admitted(spark: SparkSession, sf: str) -> DataFrame:
    from ...operators.ordered import first_per_group, running_sum
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", (-F.col("turn")).alias("pos"), token_estimate("text").alias("tokens"))
    cum = running_sum(turns, ["conv_id"], F.col("pos"), [F.col("pos")], F.col("tokens"), "cum_tokens")
    first = first_per_group(turns.select("conv_id", "pos"), ["conv_id"], ["pos"]).withColumnRenamed("pos", "first_pos")
    out = cum.join(first, "conv_id").where((F.col("cum_tokens") <= 100) | (F.col("pos") == F.col("first_pos")))
    return out.select("conv_id", "turn", "cum_tokens")


@register("savings_by_mode", r"""
WITH m AS (SELECT source, strlen(text) // 4 AS full_tokens,
                  strlen(regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g')) // 4 AS skeleton_tokens FROM documents)
SELECT source, sum(full_tokens)::BIGINT AS full_tokens, sum(skeleton_tokens)::BIGINT AS skeleton_tokens,
       sum(greatest(full_tokens - skeleton_tokens, 0))::BIGINT AS saved FROM m GROUP BY source""")
def savings_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    from ...functions.scalars import clamp_zero, trim_space
    docs = table(spark, sf, "documents").select(
        "source", token_estimate("text").alias("f"), token_estimate(trim_space(F.get(F.split("text", "\n"), F.lit(0)))).alias("s"))
    return docs.groupBy("source").agg(F.sum("f").alias("full_tokens"), F.sum("s").alias("skeleton_tokens"),
                                      F.sum(clamp_zero(F.col("f") - F.col("s"))).alias("saved"))


_RETRIEVE_SQL = f"""
WITH {hybrid_sql(20)}, {CHUNKS_SQL},
dchunks AS (SELECT page_id || '#' || section_no || '#' || part_no AS chunk_id, path, title, decode(piece) AS content FROM chunks),
{bm25_sql('dchunks', 'chunk_id', "concat_ws(' ', title, content)", 5, 'dbm')},
code AS (SELECT r.query_id, 'code' AS type, name, kind, substr(file, 6) AS file, score, rank, skeleton, code,
                s.id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS already
         FROM ranked r JOIN symbols s USING (id) WHERE r.rank <= 10),
moded AS (SELECT *, CASE WHEN score / top >= 0.5 OR kept_before < 2 THEN code
                         ELSE coalesce(nullif(skeleton, ''), code) END AS content
          FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top,
                       coalesce(sum((NOT already AND code <> '')::INT) OVER (PARTITION BY query_id ORDER BY rank
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept_before FROM code)),
parts AS (SELECT query_id, type, name, kind, file, score, content, rank, strlen(code) // 4 AS baseline
          FROM moded WHERE NOT already AND content <> ''
          UNION ALL
          SELECT query_id, 'doc', title, 'documentation', path, score, content, rank, strlen(content) // 4
          FROM dbm JOIN dchunks ON chunk_id = doc_id),
uniq AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY query_id, type, file, name ORDER BY rank) = 1),
ord AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, type, rank, file, name) AS rank),
               strlen(content) // 4 AS tokens FROM uniq),
fit AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 4000 AS fits FROM ord),
stats AS (SELECT query_id, count(*) FILTER (type = 'code') AS code_results, count(*) FILTER (type = 'doc') AS doc_results,
                 count(*) AS after_dedup, count(*) FILTER (fits) AS chunks_in_budget, sum(tokens)::BIGINT AS tokens_est_all_chunks,
                 coalesce(sum(tokens) FILTER (fits), 0)::BIGINT AS total_tokens,
                 coalesce(sum(baseline) FILTER (fits), 0)::BIGINT AS symbol_baseline_tokens FROM fit GROUP BY ALL),
skipped AS (SELECT query_id, count(*) AS deduped_count, sum(strlen(content) // 4)::BIGINT AS dedup_tokens_saved FROM moded WHERE already GROUP BY ALL),
texts AS (SELECT query_id, '# Retrieved Context' || chr(10) || chr(10) || string_agg(
    '## ' || rank || '. ' || name || ' (' || type || ')' || chr(10) || chr(10) ||
    CASE WHEN type = 'code' THEN '**File:** `' || file || '` | **Kind:** `' || kind || '` | **Score:** ' || printf('%.3f', score) || chr(10) || chr(10) ||
      '```' || CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.go' THEN 'go' WHEN file LIKE '%.ts' THEN 'typescript' ELSE 'bash' END
      || chr(10) || content || chr(10) || '```' || chr(10) || chr(10)
    ELSE '**Source:** Documentation | **Score:** ' || printf('%.3f', score) || chr(10) || chr(10) || content || chr(10) || chr(10) END,
    '' ORDER BY rank) AS context FROM fit WHERE fits GROUP BY ALL),
final AS (
  SELECT item_id AS query_id, coalesce(context, 'No relevant context found.') AS context,
         coalesce(code_results, 0) AS code_results, coalesce(doc_results, 0) AS doc_results,
         coalesce(after_dedup, 0) AS after_dedup, coalesce(chunks_in_budget, 0) AS chunks_in_budget,
         coalesce(tokens_est_all_chunks, 0) AS tokens_est_all_chunks, coalesce(total_tokens, 0) AS total_tokens,
         coalesce(symbol_baseline_tokens, 0) AS symbol_baseline_tokens, coalesce(deduped_count, 0) AS deduped_count,
         coalesce(dedup_tokens_saved, 0) AS dedup_tokens_saved
  FROM benchmark LEFT JOIN stats ON stats.query_id = item_id LEFT JOIN skipped ON skipped.query_id = item_id
  LEFT JOIN texts ON texts.query_id = item_id)
SELECT *, greatest(symbol_baseline_tokens - total_tokens, 0) + dedup_tokens_saved AS tokens_saved,
       greatest(tokens_est_all_chunks - total_tokens, 0) AS budget_tokens_saved FROM final"""


@register("retrieve_context", _RETRIEVE_SQL)
def retrieve_context(spark: SparkSession, sf: str) -> DataFrame:
    inputs = capsule_inputs(spark, sf)
    out = plan.retrieve(inputs["symbols"], inputs["vectors"], chunking.page_chunks(spread_small(table(spark, sf, "pages"))),
                        inputs["requests"], inputs["returned"], dims=DIMS)
    return out.drop("memory_tokens", "memory_lines")
