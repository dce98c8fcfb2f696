"""Corpus pipeline: filters, dedups, decontaminates and mixes the documents.

Each stage works on all its predecessor kept, and its decisions take effect:

1. toxicity: documents whose clauses score TOXIC or more go. Learned from the training rows of `labels`.
2. near_dedup: of each group of near copies the document of the least id stays.
3. suffix_dedup: 100-byte strings that also start earlier are cut out; n_chars follows the text.
4. decontaminate: documents that hold a window of a benchmark item go.
5. mix: documents are drawn to target weights; a document drawn in two epochs is there twice.

All stages but the last return the columns of documents. Nulls, empty texts, repeated rows, extra columns and empty tables
are treated as the operators say; each stage passes extra columns on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from contextmill.llm.common import cut, table, written
from contextmill.llm.decontaminate import decontaminate
from contextmill.llm.mixing import mix
from contextmill.llm.near_dedup import drop_near_copies, near
from contextmill.llm.suffix_dedup import remove_repeats
from contextmill.llm.toxicity import fit_toxicity, score_toxicity, training_labels

TOXIC = 0.5
#: The toxicity model needs labels that stages after it cannot express in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).where(F.col("tox_score") < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = cut(found.where("n_hit > 0").select(F.col("doc_id").alias("_hit"), F.col("h").alias("_h")).distinct())
    same = docs["doc_id"].eqNullSafe(hit["_hit"]) & (F.xxhash64(docs["text"], F.length(docs["text"])) == hit["_h"])
    return docs.join(near(hit, hit.count()), same, "left_anti")


def draw(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("suffix_dedup", cut_repeats), ("decontaminate", drop_contaminated), ("mix", draw)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage returns is written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
