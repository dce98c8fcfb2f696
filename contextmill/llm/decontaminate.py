"""Benchmark decontamination as a prefix-filtered set join on exact windows.

A window is ten consecutive words of a benchmark item, or the whole item where it is shorter. Shingles are
pairs of neighbouring words. They are ordered by rarity, which is their count over all documents; since a
window must be contained whole, its necessary prefix is its single rarest shingle. Documents are split into
shingles inside the scan stage and probe the windows by that shingle alone. Position and length then say where
the window would have to start, and the words there are compared exactly.

Documents are never shuffled: only one small row per document and one per hit window leave the scan stage.
The windows are broadcast in parts of at most MAX_PART_BYTES; a larger benchmark takes more passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.catalogue import Catalogue
from .common import ascii_lower, cut, parts_of, table

CATALOGUE = Catalogue()
WINDOW = 10
MAX_PART_BYTES = 48 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HIT = "array<struct<item:string,start:int,len:int>>"


def words_of(text: Column) -> Column:
    """Words of a text: runs of 0-9, a-z after lower-casing A-Z, and all characters beyond ASCII. Null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(win array, len, items): every distinct window with the ids of the items that hold it.

    Items without words have no window; a null id counts as the id 'null'; equal texts share windows.
    """
    size = F.size("w")
    return (
        benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("w"))
        .where(size > 0)
        .select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1)))).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(window)).alias("win"))
        .groupBy("win").agg(F.collect_set("item").alias("items"))
        .select("win", F.size("win").alias("len"), "items")
    )


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(win, len, items, off, k): each window with every shingle it holds; one-word windows have that word."""
    pairs = F.arrays_zip(F.col("win").alias("a"), F.slice("win", F.lit(2), F.col("len")).alias("b"))
    return (windows.select("*", F.posexplode(pairs).alias("off", "p"))
            .where((F.col("off") < F.col("len") - 1) | (F.col("len") == 1))
            .select("win", "len", "items", "off", F.xxhash64("p.a", "p.b").alias("k")))


def _document_shingles(documents: DataFrame, id_col: str, text_col: str, single: bool) -> DataFrame:
    """(doc_id, h, w, pos, k): one row per document with pos -1, then one per shingle. Runs inside the scan stage."""
    w = F.col("w")
    pairs = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b"))
    kind = "struct<a:string,b:string>"
    rows = (
        documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col, F.length(text_col)).alias("h"), words_of(F.col(text_col)).alias("w"))
        .select("doc_id", "h", "w", F.posexplode(F.concat(F.array(F.lit(None).cast(kind)), pairs.cast(f"array<{kind}>"))).alias("at", "p"))
        .select("doc_id", "h", "w", (F.col("at") - 1).alias("pos"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    )
    pair = F.when(F.col("b").isNotNull(), F.xxhash64("a", "b"))
    if not single:
        return rows.select("doc_id", "h", "w", "pos", pair.alias("k"))
    # the benchmark has one-word items: single words are shingles as well
    keys = F.when(F.col("pos") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(pair, F.xxhash64("a")))
    return rows.select("doc_id", "h", "w", "pos", F.explode(keys).alias("k"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  max_part_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """(doc_id, h, n_words, hits, n_hit, items): one row per document row.

    h is a hash of the text, so that (doc_id, h) finds the document again; hits has (item, start, len) of every
    occurrence, n_hit counts the words inside any of them, items is sorted. Null and empty texts have no words and
    no hits; repeated rows give repeated results; null ids are kept; an empty benchmark hits nothing; other
    columns of either table are ignored, whatever their names.
    """
    windows = cut(_window_shingles(benchmark_windows(benchmark, item_col, item_text_col, window)))
    stats = windows.agg(F.sum(F.length(F.concat_ws(" ", "win")) + 16 * F.size("items") + 40).alias("bytes"),
                        F.min("len").alias("shortest")).first()
    single, parts = stats["shortest"] == 1, parts_of(stats["bytes"], max_part_bytes)
    shingles = _document_shingles(documents, id_col, text_col, single)

    keys = windows.select("k").distinct()
    counts = None
    for i in range(parts):
        wanted = F.broadcast(keys.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == i))
        part = shingles.select("k").join(wanted, "k", "left_semi").groupBy("k").agg(F.count("*").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    counts = cut(counts)

    # the prefix of a window under the rarity order: its rarest shingle, the leftmost among equals
    rarest = (
        windows.join(counts, "k").groupBy("win", "len", "items")
        .agg(F.min_by(F.struct("off", "k"), F.struct("n", "off")).alias("r"), F.count("*").alias("found"))
        .where(F.col("found") == F.greatest(F.col("len") - 1, F.lit(1)))  # a shingle no document has rules its window out
        .select("win", "len", "items", "r.off", F.col("r.k").alias("k"))
    )
    rarest = cut(rarest)
    found = None
    for i in range(parts):
        index = F.broadcast(rarest.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == i).alias("i"))
        d = shingles.alias("d")
        start = F.col("d.pos") - F.col("i.off")
        holds = ((F.col("d.k") == F.col("i.k")) & (start >= 0) & (start + F.col("i.len") <= F.size("d.w"))
                 & (F.slice("d.w", F.greatest(start, F.lit(0)) + 1, F.col("i.len")) == F.col("i.win")))
        hit = F.transform("i.items", lambda x: F.struct(x.alias("item"), start.alias("start"), F.col("i.len").alias("len")))
        part = d.join(index, holds, "left").where(F.col("i.win").isNotNull() | (F.col("d.pos") < 0) & F.lit(i == 0)).select(
            "d.doc_id", "d.h", (F.col("d.pos") < 0).cast("int").alias("row"),
            F.when(F.col("d.pos") < 0, F.size("d.w")).alias("n_words"), hit.cast(HIT).alias("hit"))
        found = part if found is None else found.unionByName(part)
    span = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["start"].alias("s"), (x["start"] + x["len"]).alias("e")))))
    covered = F.aggregate(
        span, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("n"),
                                F.greatest(acc["end"], x["e"]).alias("end")))["n"]
    per_text = found.groupBy("doc_id", "h").agg(
        F.sum("row").cast("int").alias("rows"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hits"))
    return per_text.select(
        "doc_id", "h", "n_words", "hits", covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item"]))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("copy")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(w[o:o + 9], ' ') AS win, least(len(w), 10) AS n
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS o FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), lens WHERE p + n - 1 <= len(w)),
hits AS (SELECT s.doc_id, s.p, s.n, wins.item_id FROM spots s JOIN wins ON s.win = wins.win AND s.n = wins.n),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS items_sha256
          FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@CATALOGUE.register("op8_decontaminate", SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
