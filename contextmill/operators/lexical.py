"""Text retrieval: inverted index, disjunctive prefix BM25, substring fallback, cascades.

Requests are a DataFrame (query_id, text); documents carry an id and a text column. A request is a
disjunction of prefixes, one per query term. For a prefix term t with frequency f in a document:

    idf   = max(ln((N - df + 0.5) / (df + 0.5)), 1e-6)
    score = sum over terms of idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import prefix_terms, query_terms, tokens
from ..session import MAX_PINNED_ROWS, pin_small
from . import text_scores
from .ordered import top_per_group
from .rowwise import pinned

# BM25 parameters, candidate cap of the text leg, digits at the query boundary.
K1, B = 1.2, 0.75
MIN_IDF = 1e-6
CANDIDATES = 100
MAX_PUSHED_PREFIXES = 100
SCORE_DIGITS = 9


def request_terms(requests: DataFrame) -> DataFrame:
    """(query_id, prefix, qtf): prefixes of every request with their multiplicity."""
    exploded = requests.select("query_id", F.explode(prefix_terms("text")).alias("prefix"))
    return exploded.groupBy("query_id", "prefix").agg(F.count("*").alias("qtf"))


@dataclass
class TextIndex:
    """postings(term, doc_id, tf, dl) and the corpus totals as a one-row DataFrame (n, avgdl)."""

    postings: DataFrame
    totals: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text: Column) -> "TextIndex":
        toks = docs.select(F.col(id_col).alias("doc_id"), tokens(text).alias("toks"))
        postings = (toks.select("doc_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
                    .where("term IS NOT NULL").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))
        return cls(postings, corpus_totals(toks))

    def write(self, path: str, files: int | None = None) -> None:
        """Term-clustered tables: a term lookup then reads few row groups, and the postings of a
        very frequent term are spread over several files by the document id."""
        keys = ["term", "doc_id"]
        clustered = (self.postings.repartitionByRange(files, *keys) if files
                     else self.postings.repartitionByRange(*keys))
        clustered.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/postings")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark, path: str) -> "TextIndex":
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))

    def matches(self, asked: "Asked") -> DataFrame:
        """(doc_id, dl, prefix, f) for the wanted prefixes, words of one prefix added up."""
        postings = self.postings
        if asked.few and len(asked.words) <= MAX_PUSHED_PREFIXES:
            # string-prefix filters reach the term-clustered Parquet files and skip row groups
            wanted = F.lit(False)
            for word in asked.words:
                wanted = wanted | F.startswith("term", F.lit(word))
            postings = postings.where(wanted)
        expanded = expand_prefixes(postings, asked.lengths)
        return (expanded.join(asked.prefixes, "prefix")
                .groupBy("doc_id", "dl", "prefix").agg(F.sum("tf").alias("f")))


def corpus_totals(toks: DataFrame) -> DataFrame:
    return toks.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))


def expand_prefixes(terms: DataFrame, lengths: list[int] | None) -> DataFrame:
    """One row per (term row, prefix of a wanted length), making the prefix match an equi-join.

    Without a list of lengths every prefix of every term is produced.
    """
    wanted = F.array(*[F.lit(n) for n in lengths]) if lengths else F.sequence(F.lit(1), F.length("term"))
    # explode_outer: plain explode would make Spark filter on, and so compute, its input twice
    return (terms.select("*", F.explode_outer(wanted).alias("__len"))
            .where(F.length("term") >= F.col("__len"))
            .withColumn("prefix", F.substr("term", F.lit(1), F.col("__len")))
            .drop("__len"))


def scan_matches(toks: DataFrame, asked: "Asked") -> DataFrame:
    """As TextIndex.matches, straight from (doc_id, toks) without building an index: only tokens that
    match a request leave the scan stage. Spark broadcasts the prefixes when their size allows."""
    exploded = toks.select("doc_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
    return (expand_prefixes(exploded, asked.lengths).join(asked.prefixes, "prefix")
            .groupBy("doc_id", "dl", "prefix").agg(F.count("*").alias("f")))


def bm25_weights(matches: DataFrame, totals: DataFrame, few_prefixes: bool) -> DataFrame:
    """(doc_id, prefix, weight) from match frequencies and corpus totals.

    few_prefixes says that the number of requested prefixes was counted and is small.
    """
    # counting non-zero f keeps both uses of the aggregate identical, so its shuffle is reused
    frequency = matches.groupBy("prefix").agg(F.count(F.when(F.col("f") > 0, 1)).alias("df"))
    row = totals.select(F.struct("n", "avgdl")).scalar()
    # at most one row per requested prefix
    ratio = (row["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = frequency.select("prefix", F.greatest(F.log(ratio), F.lit(MIN_IDF)).alias("idf"))
    f, dl = F.col("f"), F.col("dl")
    weight = F.col("idf") * f * (K1 + 1) / (f + K1 * ((1 - B) + B * dl / row["avgdl"]))
    return matches.join(F.broadcast(idf) if few_prefixes else idf, "prefix").select("doc_id", "prefix", weight.alias("weight"))


def bm25_rank(weights: DataFrame, terms: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, doc_id, score, rank): best documents per request, ties by document id."""
    scored = (weights.join(terms, "prefix").groupBy("query_id", "doc_id")
              .agg(F.round(F.sum(F.col("qtf") * F.col("weight")), SCORE_DIGITS).alias("score")))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], limit)


@dataclass
class Asked:
    """Terms (query_id, prefix, qtf) of a request batch and their distinct prefixes. `few` says that
    they were counted and are broadcast; `lengths` are then the prefix lengths in use."""

    terms: DataFrame
    prefixes: DataFrame
    lengths: list[int] | None
    words: tuple[str, ...] = ()
    counted: pa.Table | None = None

    @property
    def few(self) -> bool:
        return self.lengths is not None

    @classmethod
    def of(cls, requests: DataFrame) -> "Asked":
        raw = request_terms(requests)
        found = raw.limit(MAX_PINNED_ROWS + 1).toArrow()
        if found.num_rows > MAX_PINNED_ROWS:
            return cls(raw, raw.select("prefix").distinct(), None)
        words = sorted(set(found.column("prefix").to_pylist()))
        spark = requests.sparkSession
        prefixes = spark.createDataFrame(pa.table({"prefix": pa.array(words, pa.string())}), "prefix string")
        lengths = sorted({len(w) for w in words}) or [1]
        return cls(F.broadcast(spark.createDataFrame(found, raw.schema)), F.broadcast(prefixes), lengths, tuple(words), found)


def bm25_search(docs: DataFrame, requests: DataFrame, id_col: str, text: Column,
                limit: int = CANDIDATES) -> DataFrame:
    """Batched BM25 over an unindexed collection.

    Requests of a counted number are scored inside the scan, apart from ids that repeat (see bm25_repeats). More requests
    than that are joined with the documents.
    """
    asked = Asked.of(requests)
    toks = docs.select(F.col(id_col).alias("doc_id"), tokens(text).alias("toks"))
    if asked.few and asked.words and str(toks.schema["doc_id"].dataType.simpleString()) in ("int", "bigint", "string"):
        terms = text_scores.Terms.of(asked.counted, asked.words)
        found = text_scores.counts(toks, terms)
        return bm25_scan(toks, terms, found, limit) if found.get(text_scores.IDS, 0) <= 1 else bm25_repeats(toks, terms, found, limit)
    matches = scan_matches(toks, asked)
    return bm25_rank(bm25_weights(matches, corpus_totals(toks), asked.few), asked.terms, limit)


def bm25_scan(toks: DataFrame, terms: text_scores.Terms, found: dict[int, int], limit: int) -> DataFrame:
    """bm25_search from (doc_id, toks) with distinct ids and their counts."""
    idf, average = idf_and_length(terms, found)
    scored = text_scores.best(toks, terms, idf, average, limit, K1, B, SCORE_DIGITS)
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], limit)


def idf_and_length(terms: text_scores.Terms, found: dict[int, int]) -> tuple[np.ndarray, float]:
    n, df = found[text_scores.DOCS], np.array([found[i] for i in range(len(terms.words))], dtype=np.float64)
    average = found[text_scores.TOKENS] / max(found[text_scores.MEASURED], 1)
    return np.maximum(np.log(np.maximum(n - df + 0.5, 0.5) / (df + 0.5)), MIN_IDF), average or 1.0


def bm25_repeats(toks: DataFrame, terms: text_scores.Terms, found: dict[int, int], limit: int) -> DataFrame:
    """bm25_scan for ids that repeat: the rows of an id of one length count as one document, an id's documents add up.

    Only rows of repeated ids are grouped, as counts per prefix. Where more ids repeat than can be pinned, all rows are.
    """
    ids = toks.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("repeated"))
    counted = ids.limit(MAX_PINNED_ROWS + 1).toArrow()
    if counted.num_rows <= MAX_PINNED_ROWS:
        named = F.broadcast(toks.sparkSession.createDataFrame(counted, ids.schema))
        same = F.col("doc_id").eqNullSafe(F.col("repeated"))
        once = toks.join(named, same, "left_anti")
        rows = pin_small(text_scores.matches(toks.join(named, same, "left_semi"), terms))
    else:
        once, rows = None, text_scores.matches(toks, terms)
    # found has every row as a document
    found = dict(found)
    for r in rows.groupBy("prefix").agg(F.count("*").alias("documents"), F.sum("rows").alias("rows")).collect():
        found[r["prefix"]] += r["documents"] - r["rows"]
    idf, average = idf_and_length(terms, found)
    scored = text_scores.best_repeated(rows, terms, idf, average, limit, K1, B, SCORE_DIGITS)
    if once is not None:
        scored = scored.unionByName(text_scores.best(once, terms, idf, average, limit, K1, B, SCORE_DIGITS))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], limit)


def bm25_search_index(index: TextIndex, requests: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Batched BM25 over a stored index."""
    asked = Asked.of(requests)
    matches = index.matches(asked)
    return bm25_rank(bm25_weights(matches, index.totals, asked.few), asked.terms, limit)


# --- substring fallback ------------------------------------------------------------------------

MAX_REQUEST_BATCH = 1000


def request_batches(requests: DataFrame, columns: list[Column], size: int = MAX_REQUEST_BATCH) -> list[list]:
    """Requests as batches of bounded size, for operators that evaluate a whole batch per scanned row.

    Requests are typed by users and agents, so their number does not grow with the indexed data; a
    larger number than `size` simply takes more passes.
    """
    rows = requests.select(*columns).collect()
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def substring_search(docs: DataFrame, requests: DataFrame, id_col: str, name: Column,
                     fields: list[Column], limit: int = CANDIDATES) -> DataFrame:
    """Fallback ranking: any query term occurs in any field; per term the name scores 10 when equal,
    5 as prefix, 3 when contained and 1 otherwise. Scored first, cut to `limit` afterwards.

    The points depend on the name alone, so a task looks into the fields of those rows only whose points can still be
    among its best.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(name).alias("name"), F.lower(F.concat_ws("\u0001", *fields)).alias("hay"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select(F.lit(None).cast("long").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    for batch in request_batches(requests, [F.col("query_id"), query_terms("text").alias("terms")]):
        asked = [(r["query_id"], r["terms"]) for r in batch if r["terms"]]
        if asked:
            scored = scored.unionByName(rows.mapInArrow(text_scores.substring_scorer(asked, limit), f"query_id long, doc_id {id_type}, score double"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], limit)


def phrase_matches(docs: DataFrame, requests: DataFrame, fields: list[Column]) -> DataFrame:
    """docs with query_id for every request whose whole text occurs in a field (case-insensitive)."""
    found = None
    haystack = F.lower(F.concat_ws("\u0001", *fields))
    for batch in request_batches(requests, [F.col("query_id"), F.lower("text").alias("phrase")]):
        wanted = F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"),
                                    F.lit(r["phrase"]).alias("phrase")) for r in batch])
        base = pinned(docs, __hay=haystack)
        part = base.withColumn("__r", F.explode(F.filter(
            wanted, lambda r: F.contains(F.col("__hay"), r["phrase"]))))
        part = part.withColumn("query_id", F.col("__r.query_id")).drop("__r", "__hay")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.withColumn("query_id", F.lit(None).cast("long")).where(F.lit(False))
    return found


def phrase_search(docs: DataFrame, requests: DataFrame, id_col: str, fields: list[Column],
                  newest: list[Column], limit: int, score: float = 0.5) -> DataFrame:
    """Best phrase matches per request in the given order, with a constant score."""
    ranked = top_per_group(phrase_matches(docs, requests, fields), ["query_id"], newest, limit)
    return ranked.select("query_id", F.col(id_col).alias("doc_id"), F.lit(score).alias("score"), "rank")


def first_non_empty(*stages: DataFrame, by: str = "query_id") -> DataFrame:
    """Cascade: per request the rows of the first stage that returned any. Equal columns expected; each
    stage must already be cut per request, so that the window over a request stays small."""
    tagged = None
    for i, stage in enumerate(stages):
        part = stage.withColumn("stage", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    winner = F.min("stage").over(Window.partitionBy(by))
    return tagged.withColumn("__w", winner).where(F.col("stage") == F.col("__w")).drop("__w")
