"""How the test tables stand in for the engine's own tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions.scalars import trim_space
from ...functions.text import lines
from ...session import spread_small


# Columns of the test tables. A declared schema saves the job that would infer it.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one whole-file symbol each."""
    docs = spread_small(table(spark, sf_dir, "documents"))
    suffix = (F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".go")
              .when(F.col("lang") == "de", ".ts").otherwise(".sh"))
    ls = lines("text")
    file = F.concat(F.lit("/src/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)
    word = F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}]+", 0)
    name = F.when(word == "", "doc").otherwise(word)
    kind = (F.when(F.col("n_chars") < 500, "function").when(F.col("n_chars") < 1500, "method")
            .when(F.col("n_chars") < 3000, "class").otherwise("type"))
    return docs.select(
        F.col("doc_id").alias("id"), name.alias("name"), kind.alias("kind"), file.alias("file"),
        F.concat(F.lit("/src/"), "source").alias("project_path"),
        F.lit(1).alias("start_line"), F.size(ls).alias("end_line"), F.col("text").alias("code"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), suffix, F.lit("."), name).alias("fqn"),
        F.col("text").alias("source"), trim_space(F.get(ls, F.lit(0))).alias("skeleton"))


TOKENS_SQL = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"

SYMBOLS_SQL = rf"""
symbols AS (
  SELECT doc_id AS id, nm AS name,
         CASE WHEN n_chars < 500 THEN 'function' WHEN n_chars < 1500 THEN 'method'
              WHEN n_chars < 3000 THEN 'class' ELSE 'type' END AS kind,
         '/src/' || source || '/' || lang || '/doc_' || doc_id || suffix AS file,
         '/src/' || source AS project_path, 1 AS start_line,
         len(string_split(text, chr(10)))::INT AS end_line, text AS code,
         'doc_' || doc_id || suffix || '.' || nm AS fqn, text AS source,
         regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS skeleton
  FROM (SELECT *, coalesce({TOKENS_SQL.format('text')}[1], 'doc') AS nm,
               CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.go' WHEN 'de' THEN '.ts' ELSE '.sh' END AS suffix
        FROM documents))"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as text requests."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as requests; the vector of the same number stands for the embedded text."""
    items = texts(spark, sf_dir)
    vecs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    # the other vectors stay in their scan
    return items.join(vecs.join(items.select("query_id"), "query_id", "left_semi"), "query_id", "left")


def request_terms_sql(source: str = "benchmark", id_col: str = "item_id", text: str = "text") -> str:
    """CTE qterms(query_id, prefix, qtf)."""
    return rf"""
qterms AS (
  SELECT query_id, prefix, count(*) AS qtf FROM (
    SELECT {id_col} AS query_id,
           unnest(list_transform(regexp_split_to_array(lower({text}), '\s+'),
                                 lambda t: regexp_replace(t, '[^A-Za-z0-9_]', '', 'g'))) AS prefix
    FROM {source}) WHERE prefix <> '' GROUP BY ALL)"""


def bm25_sql(source: str, id_col: str, text: str, limit: int = 100, out: str = "bm25") -> str:
    """CTEs up to out(query_id, doc_id, score, rank), helpers prefixed with out; expects qterms."""
    return rf"""
{out}_toks AS (SELECT {id_col} AS doc_id, {TOKENS_SQL.format(text)} AS ts FROM {source}),
{out}_totals AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {out}_toks),
{out}_post AS (SELECT doc_id, dl, term, count(*) AS tf
         FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM {out}_toks) GROUP BY ALL),
{out}_prefixes AS (SELECT DISTINCT prefix FROM qterms),
{out}_vocab AS (SELECT DISTINCT term FROM {out}_post),
{out}_match AS (SELECT term, prefix FROM {out}_vocab JOIN {out}_prefixes ON starts_with(term, prefix)),
{out}_f AS (SELECT doc_id, dl, prefix, sum(tf) AS f FROM {out}_post JOIN {out}_match USING (term) GROUP BY ALL),
{out}_df AS (SELECT prefix, count(*) AS df FROM {out}_f GROUP BY ALL),
{out}_w AS (SELECT doc_id, prefix,
              greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2
              / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight
            FROM {out}_f JOIN {out}_df USING (prefix), {out}_totals),
{out}_all AS (SELECT query_id, doc_id, round(sum(qtf * weight), 9) AS score
            FROM {out}_w JOIN qterms USING (prefix) GROUP BY ALL),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
         FROM {out}_all QUALIFY rank <= {limit})"""


def knn_sql(k: int, where: str = "true", out: str = "near", order: str = "vec_id") -> str:
    """CTE near(query_id, vec_id, similarity, rank) for benchmark requests."""
    return rf"""
{out} AS (
  SELECT query_id, vec_id, similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, {order}) AS rank
  FROM (SELECT b.item_id AS query_id, e.vec_id,
               round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity
        FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e WHERE {where})
  QUALIFY rank <= {k})"""
