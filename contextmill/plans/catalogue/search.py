"""Text, vector and hybrid search; capsules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.scalars import content_hash
from ...operators import entities, fusion, knn, lexical, packing
from ...operators.filters import SearchFilters
from ...session import pin_small, scratch_dir, spread_small
from ...sources.text_index import TextSegments
from .. import capsule as plan
from . import Catalogue
from .views import (SYMBOLS_SQL, bm25_sql, knn_sql, request_terms_sql, requests, symbols, table, texts)

CATALOGUE = Catalogue()
register = CATALOGUE.register
DIMS = 64
CAPSULE_SESSION = "s-returned"


@register("bm25_batch_topk", f"""
WITH {request_terms_sql()}, {bm25_sql('documents', 'doc_id', 'text')}
SELECT query_id, doc_id, score, rank FROM bm25""")
def bm25_batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return lexical.bm25_search(spread_small(docs), texts(spark, sf), "doc_id", F.col("text"))


@register("bm25_index_topk", f"""
WITH {request_terms_sql()}, {bm25_sql('documents', 'doc_id', 'text')}
SELECT query_id, doc_id, score, rank FROM bm25""")
def bm25_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The answers of bm25_batch_topk from a stored index with a history: drafts of a tenth of the documents and copies under
    negative ids come with the first of two batches; later the drafts get their texts, and the copies are deleted."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    index = TextSegments(spark, scratch_dir(spark, "bm25-index"))

    def batch(rows: DataFrame, version: str) -> DataFrame:
        return rows.select(F.lit("corpus").alias("scope"), F.concat(F.lit("unit"), F.col("doc").cast("string")).alias("unit"),
                           F.lit(version).cast("timestamp_ntz").alias("version"), "doc", "text")

    part = F.pmod("doc", F.lit(10))
    drafted = docs.where(part == 0)
    drafts = batch(drafted.withColumn("text", F.concat_ws(" ", "source", "lang", "source")), "2024-01-01")
    copies = batch(docs.where(part == 3).withColumn("doc", -F.col("doc") - 1), "2024-01-01")
    index.apply(drafts.unionByName(copies).unionByName(batch(docs.where((part > 0) & (part < 5)), "2024-01-01")))
    index.apply(batch(docs.where(part >= 5), "2024-01-02"))
    index.apply(batch(drafted, "2024-01-03"), drafts)
    index.apply(None, copies)
    return index.search(texts(spark, sf), lexical.CANDIDATES)


@register("bm25_prefix_topk", f"""
WITH one AS (SELECT 0 AS query_id, 'th ion* er, the' AS text),
{request_terms_sql('one', 'query_id')}, {bm25_sql('documents', 'doc_id', 'text')}
SELECT doc_id, score, rank FROM bm25""")
def bm25_prefix_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    one = spark.range(1).select(F.col("id").alias("query_id"), F.lit("th ion* er, the").alias("text"))
    found = lexical.bm25_search(spread_small(docs), one, "doc_id", F.col("text"))
    return found.select("doc_id", "score", "rank")


@register("like_fallback_score", rf"""
WITH {SYMBOLS_SQL},
terms AS (SELECT item_id AS query_id,
                 list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS ts FROM benchmark),
hits AS (SELECT query_id, id AS doc_id, lower(name) AS nm, ts
         FROM symbols, terms
         WHERE len(list_filter(ts, lambda t: contains(lower(name || chr(1) || fqn || chr(1) || code), t))) > 0),
scored AS (SELECT query_id, doc_id, list_sum(list_transform(ts, lambda t:
             CASE WHEN nm = t THEN 10.0::DOUBLE WHEN starts_with(nm, t) THEN 5 WHEN contains(nm, t) THEN 3 ELSE 1 END)) AS score
           FROM hits)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM scored QUALIFY rank <= 100""")
def like_fallback_score(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.substring_search(symbols(spark, sf), texts(spark, sf), "id", F.col("name"),
                                    [F.col("name"), F.col("fqn"), F.col("code")])


@register("fts_like_cascade", f"""
WITH asked AS (SELECT item_id AS query_id, text FROM benchmark
               UNION ALL SELECT 100000 + n_nationkey, lower(substr(n_name, 2, 3)) FROM nation),
{request_terms_sql('asked', 'query_id')}, {bm25_sql('documents', 'doc_id', 'text', 10)},
likes AS (SELECT query_id, doc_id, 0.5::DOUBLE AS score,
                 row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank
          FROM documents JOIN asked ON contains(lower(documents.text), lower(asked.text)) QUALIFY rank <= 10),
staged AS (SELECT *, 0 AS stage FROM bm25 UNION ALL BY NAME SELECT *, 1 AS stage FROM likes)
SELECT query_id, doc_id, score, rank, stage FROM staged
WHERE stage = (SELECT min(s.stage) FROM staged s WHERE s.query_id = staged.query_id)""")
def fts_like_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_small(table(spark, sf, "documents"))
    asked = texts(spark, sf).unionByName(
        table(spark, sf, "nation").select((F.col("n_nationkey") + 100000).cast("long").alias("query_id"),
                                          F.lower(F.substring("n_name", 2, 3)).alias("text")))
    ranked = pin_small(lexical.bm25_search(docs, asked, "doc_id", F.col("text"), 10))
    # only requests without a ranked hit are looked up in the texts
    unanswered = asked.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    likes = lexical.phrase_search(docs, unanswered, "doc_id", [F.col("text")], [F.desc("doc_id")], 10)
    return lexical.first_non_empty(ranked, likes)


@register("vector_topk_batch", f"""
WITH {knn_sql(20)} SELECT query_id, vec_id, similarity, rank FROM near""")
def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return knn.knn(table(spark, sf, "embeddings"), requests(spark, sf), 20, DIMS)


@register("vector_topk", """
SELECT vec_id, round(list_cosine_similarity(
         (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7), embedding::DOUBLE[]), 9) AS similarity
FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings")
    one = vecs.where(F.col("vec_id") == 7).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.knn(vecs, one, 10, DIMS).select("vec_id", "similarity")


@register("vector_topk_filtered", f"""
WITH {knn_sql(10, "e.label IN (1, 3, 5) AND e.vec_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")}
SELECT query_id, vec_id, similarity, rank FROM near""")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    clean = table(spark, sf, "labels").where(F.col("toxic") == 0)
    vecs = table(spark, sf, "embeddings").where(F.col("label").isin(1, 3, 5))
    vecs = vecs.join(clean, F.col("vec_id") == F.col("doc_id"), "left_semi")
    return knn.knn(vecs, requests(spark, sf), 10, DIMS)


def hybrid_sql(limit: int) -> str:
    """CTEs up to ranked(query_id, key, id, leg, score, rank), with the legs tx and vx."""
    return f"""
{SYMBOLS_SQL}, {request_terms_sql()}, {bm25_sql('symbols', 'id', "concat_ws(' ', name, fqn, code)")}, {knn_sql(2 * limit)},
keyed AS (SELECT id, file || '|' || name || '|' || kind AS key FROM symbols),
tx AS (SELECT query_id, key, id, score, rank FROM bm25 JOIN keyed ON id = doc_id),
vx AS (SELECT query_id, key, id, similarity AS score, rank FROM near JOIN keyed ON id = vec_id),
votes AS (SELECT *, 0 AS leg FROM tx WHERE query_id IN (SELECT query_id FROM vx)
          UNION ALL BY NAME SELECT *, 1 AS leg FROM vx),
fused AS (SELECT query_id, key, round(sum(1.0 / (60 + rank)), 12) AS score,
                 arg_min(id, leg * 1000 + rank) AS id, min(leg) AS leg FROM votes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank
           FROM fused QUALIFY rank <= {limit}
           UNION ALL BY NAME SELECT query_id, key, score, id, 0 AS leg, rank FROM tx
           WHERE rank <= {limit} AND query_id NOT IN (SELECT query_id FROM vx))"""


_HYBRID_SQL = hybrid_sql(30)


@register("rrf_hybrid", f"WITH {_HYBRID_SQL} SELECT query_id, key, id, leg, score, rank FROM ranked")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    ranked = plan.hybrid_search(symbols(spark, sf), table(spark, sf, "embeddings"), pin_small(requests(spark, sf)), 30, DIMS)
    return ranked.select("query_id", "key", "id", "leg", "score", "rank")


@register("hybrid_metrics", f"""
WITH {_HYBRID_SQL},
legs AS (SELECT query_id, key, 0 AS leg FROM tx UNION ALL SELECT query_id, key, 1 FROM vx),
counted AS (SELECT query_id, count(*) FILTER (leg = 0) AS b, count(*) FILTER (leg = 1) AS v,
                   count(DISTINCT key) AS k FROM legs GROUP BY ALL)
SELECT item_id AS query_id, coalesce(b, 0) AS bm25_candidates, coalesce(v, 0) AS vector_candidates,
       coalesce(CASE WHEN v > 0 THEN k ELSE least(b, 30) END, 0) AS hybrid_after_fuse
FROM benchmark LEFT JOIN counted ON query_id = item_id""")
def hybrid_metrics(spark: SparkSession, sf: str) -> DataFrame:
    req = pin_small(requests(spark, sf))
    found = plan.hybrid_candidates(symbols(spark, sf), table(spark, sf, "embeddings"), req, 30, DIMS)
    return fusion.stage_counts(req, found, 30)


def capsule_inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Requests of one session that has already been sent the documents labelled toxic; documents
    labelled good have a cached summary (their first line), some stored for other code."""
    syms = symbols(spark, sf)
    labels = table(spark, sf, "labels")
    req = requests(spark, sf).select(
        "query_id", "text", "vector", F.lit(CAPSULE_SESSION).alias("session_id"), F.lit("auto").alias("mode"),
        F.lit(4000).alias("token_budget"), F.lit("/src").alias("root"))
    flagged = labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    returned = (syms.join(flagged, "id", "left_semi")
                .select(F.lit(CAPSULE_SESSION).alias("session_id"), "file", "name", "start_line"))
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    summaries = syms.join(good, "id", "left_semi").select(
        "file", "name", "project_path", F.col("skeleton").alias("summary_text"),
        F.when(F.col("kind") == "type", F.lit("stale")).otherwise(content_hash("code")).alias("content_hash"))
    return {"symbols": syms, "vectors": table(spark, sf, "embeddings"), "requests": req,
            "returned": returned, "summaries": summaries}


def capsule_rows(spark: SparkSession, sf: str) -> DataFrame:
    return plan.capsule(**capsule_inputs(spark, sf), dims=DIMS)


_CAPSULE_SQL = _HYBRID_SQL + r""",
hits AS (
  SELECT r.query_id, r.rank, r.score, r.leg, s.*, v.score AS similarity,
         s.id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS already,
         CASE WHEN s.id IN (SELECT doc_id FROM labels WHERE quality = 1) AND s.kind <> 'type'
              THEN nullif(s.skeleton, '') END AS summary,
         CASE WHEN starts_with(s.file, '/src/') THEN substr(s.file, 6) ELSE s.file END AS out_file
  FROM ranked r JOIN symbols s ON s.id = r.id
  LEFT JOIN vx v ON v.query_id = r.query_id AND v.id = r.id),
moded AS (
  SELECT *, CASE WHEN score / top >= 0.5 OR kept_before < 2 THEN 'full'
                 WHEN score / top >= 0.2 THEN 'skeleton' ELSE 'summary' END AS effective_mode
  FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top,
               coalesce(sum((NOT already)::INT) OVER (PARTITION BY query_id ORDER BY rank
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept_before FROM hits)),
payloads AS (
  SELECT *, '{' ||
    CASE WHEN effective_mode = 'summary' AND summary IS NULL AND skeleton <> '' THEN '"_fallback":"skeleton",' ELSE '' END ||
    '"end_line":' || end_line || ',"file":' || to_json(out_file)::VARCHAR || ',"kind":' || to_json(kind)::VARCHAR ||
    ',"name":' || to_json(name)::VARCHAR ||
    CASE WHEN skeleton <> '' AND (effective_mode = 'skeleton' OR (effective_mode = 'summary' AND summary IS NULL))
         THEN ',"skeleton":' || to_json(skeleton)::VARCHAR ELSE '' END ||
    CASE WHEN source <> '' AND effective_mode = 'full' THEN ',"source":' || to_json(source)::VARCHAR ELSE '' END ||
    ',"start_line":' || start_line ||
    CASE WHEN effective_mode = 'summary' AND summary IS NOT NULL THEN ',"summary":' || to_json(summary)::VARCHAR ELSE '' END
    || '}' AS payload
  FROM moded),
sized AS (
  SELECT *, ((strlen(payload) + 5 * (strlen(payload) - strlen(translate(payload, '<>&', '')))
             + CASE WHEN leg = 1 THEN 64 + strlen(similarity::DECIMAL(10, 9)::VARCHAR) ELSE 0 END) // 4)::INT AS tokens,
         (strlen(source) // 4)::INT AS baseline FROM payloads),
run AS (SELECT *, sum(CASE WHEN already THEN 0 ELSE tokens END) OVER (PARTITION BY query_id ORDER BY rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used_so_far FROM sized),
packed AS (SELECT *, used_so_far <= 4000 AND NOT already AS sent, used_so_far <= 4000 AND already AS skipped FROM run)"""


@register("capsule_pack", f"""
WITH {_CAPSULE_SQL}
SELECT query_id, rank, id, effective_mode, payload, tokens, used_so_far::BIGINT AS used_so_far
FROM packed WHERE sent""")
def capsule_pack(spark: SparkSession, sf: str) -> DataFrame:
    return capsule_rows(spark, sf).where("sent").select(
        "query_id", "rank", "id", "effective_mode", "payload", "tokens", "used_so_far")


@register("mode_select", f"""
WITH {_CAPSULE_SQL} SELECT query_id, rank, id, already, effective_mode, score FROM packed""")
def mode_select(spark: SparkSession, sf: str) -> DataFrame:
    return capsule_rows(spark, sf).select("query_id", "rank", "id", "already", "effective_mode", "score")


@register("capsule_savings", f"""
WITH {_CAPSULE_SQL},
agg AS (SELECT query_id, count(*) FILTER (sent) AS results, count(*) FILTER (skipped) AS deduped,
               coalesce(sum(tokens) FILTER (sent), 0)::BIGINT AS tokens_used,
               coalesce(sum(baseline) FILTER (sent), 0)::BIGINT AS symbol_baseline_tokens,
               coalesce(sum(tokens) FILTER (skipped), 0)::BIGINT AS dedup_tokens_saved FROM packed GROUP BY ALL),
filebase AS (SELECT query_id, sum(t)::BIGINT AS file_baseline_tokens
             FROM (SELECT DISTINCT query_id, file, baseline AS t FROM packed WHERE sent) GROUP BY ALL)
SELECT query_id, results, deduped, tokens_used, symbol_baseline_tokens, dedup_tokens_saved,
       coalesce(file_baseline_tokens, 0) AS file_baseline_tokens,
       greatest(symbol_baseline_tokens - tokens_used, 0) + dedup_tokens_saved AS tokens_saved,
       greatest(coalesce(file_baseline_tokens, 0) - tokens_used, 0) + dedup_tokens_saved AS savings_vs_files
FROM agg LEFT JOIN filebase USING (query_id)""")
def capsule_savings(spark: SparkSession, sf: str) -> DataFrame:
    inputs = capsule_inputs(spark, sf)
    # both sums need numbers of a hit only, so the capsules are made once and no text is kept
    packed = pin_small(plan.capsule(**inputs, dims=DIMS).select("query_id", "file", "sent", "skipped", "tokens", "baseline"))
    return packing.pack_savings(packed, plan.file_tokens(inputs["symbols"]))


@register("doc_hybrid", f"""
WITH {request_terms_sql()}, {bm25_sql('documents', 'doc_id', 'text', 20)}, {knn_sql(20, "e.vec_id IN (SELECT doc_id FROM documents)", order="'doc:corpus:' || vec_id")},
votes AS (SELECT query_id, doc_id AS id, rank FROM bm25 WHERE query_id IN (SELECT query_id FROM near) UNION ALL SELECT query_id, vec_id, rank FROM near),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM votes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'doc:corpus:' || id) AS rank FROM fused QUALIFY rank <= 10)
SELECT query_id, id, score, rank FROM ranked
UNION ALL SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM near)""")
def doc_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    key = F.concat(F.lit("doc:corpus:"), F.col("doc_id").cast("string"))
    live = docs.select(key.alias("ident"), F.lit("v1").alias("content_hash"))
    vectors = table(spark, sf, "embeddings").select(F.lit("v1").alias("content_hash"), "embedding", F.lit("doc").alias("doc_type"), entities.entity_key(
        "doc", F.concat(F.lit("doc:corpus:"), F.col("vec_id").cast("string"))).alias("source_file"))
    req = pin_small(requests(spark, sf))
    text = lexical.bm25_search(spread_small(docs), req, "doc_id", F.col("text"), 20)
    text = text.select("query_id", F.concat(F.lit("doc:corpus:"), F.col("doc_id").cast("string")).alias("id"), "score", "rank")
    near = entities.nearest(entities.current_vectors("doc", vectors, live), req, 20, DIMS)
    out = entities.fused(text, near, 10)
    return out.select("query_id", F.element_at(F.split("id", ":"), 3).cast("long").alias("id"), "score", "rank")


@register("search_filters", rf"""
WITH {SYMBOLS_SQL}
SELECT id, file, kind FROM symbols
WHERE kind IN ('function', 'class') AND (lower(file) LIKE '%.ts' OR lower(file) LIKE '%.tsx')
  AND (file = '/src/src1' OR starts_with(file, '/src/src1/'))""")
def search_filters(spark: SparkSession, sf: str) -> DataFrame:
    wanted = SearchFilters.parse({"kinds": "function, class", "kind": "function", "language": "typescript",
                                  "path_prefix": "src1"})
    return symbols(spark, sf).where(wanted.predicate("/src")).select("id", "file", "kind")
