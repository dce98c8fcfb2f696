"""Spelling variants by permuterm rotations.

A word is marked with a terminator and rotated so that the place of an edit comes last: the rotation of `x c y` that ends
in c is `y$xc`. Words that differ in the character c alone share the prefix `y$x` of that rotation, and `y$x` is a whole
rotation of the word `x y`, which lacks c. So each rotation is filed under itself and, when it does not end in the
terminator, under the prefix that skips its last character. All filed rotations are sorted over the cluster; a group of one
prefix lies together in one task and holds one row for each character of the alphabet at most, plus one. A scan of the
sorted groups gives every row its count of neighbours and the best of them; no pairs are written.

A character next to an equal one can be skipped in several places with the same result; only the first of a run counts.

Rotations of a word take the square of its length. Words longer than `short` are filed under fingerprints of the two
pieces x and y instead (lengths, and a polynomial modulo two primes for each), in time in proportion to the length; which
of the two ways serves a group depends on its length alone, so both fit together. A text of one huge word is then no trouble.

Null texts and texts without words give nothing, null ids count as empty text, repeated rows count as often as they
occur, an empty table has no words, other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.catalogue import Catalogue
from .common import ascii_lower, cut, table

CATALOGUE = Catalogue()
# What a word is, which occurrences lose a character, what is counted, when a neighbour is the form.
RUN = r"[A-Za-zÀ-ÿ]+"
DAMAGED = 199
MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 6, 5, 5
TERMINATOR = "$"
SHORT = 64
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 69_061)
ROWS_PER_BATCH = 1 << 16
BEST = "struct<less:bigint,ref:string>"


def damaged_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): every occurrence of a run, lower-cased, with the character deleted that its checksum asks for."""
    runs = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                            F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("w"))
    h = F.crc32(F.encode(F.concat("i", F.lit(":"), "w"), "UTF-8"))
    at = F.pmod(h, F.length("w")).cast("int")
    shorter = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2, F.length("w")))
    return runs.select(F.when(F.pmod(h, F.lit(DAMAGED)) == 0, shorter).otherwise(F.col("w")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): distinct words that are long and frequent enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame, short: int) -> DataFrame:
    """(key, whole, fresh, ref, n): the rotations of words (word, n), under themselves (whole) and under their prefixes.

    fresh marks the first character of a run of equal ones. Groups of a base longer than short - 1 are left out.
    """
    size, word = F.length("word"), F.col("word")
    places = words.where(size <= short).select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    left, right = F.substr("word", F.lit(1), F.col("i")), F.substr("word", F.col("i") + 1, size)
    letter = lambda at: F.substr(word, at, F.lit(1))
    filed = F.array(
        F.struct(F.concat(right, F.lit(TERMINATOR), left).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("fresh")),
        F.struct(F.concat(right, F.lit(TERMINATOR), F.substr("word", F.lit(1), F.col("i") - 1)).alias("key"), F.lit(False).alias("whole"),
                 ((F.col("i") == 1) | (letter(F.col("i")) != letter(F.greatest(F.col("i") - 1, F.lit(1))))).alias("fresh")))
    usable = F.filter(filed, lambda f: F.when(f["whole"], size < short).otherwise(F.col("i") > 0))
    return places.select(F.explode(usable).alias("f"), F.col("word").alias("ref"), "n").select("f.key", "f.whole", "f.fresh", "ref", "n")


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base % prime
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out[:n]


def _prefix_prints(codes: np.ndarray) -> np.ndarray:
    """For every length 0..n of a prefix its two fingerprints."""
    out = np.zeros((2, len(codes) + 1), np.uint64)
    for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
        terms = codes * _powers(base, prime, len(codes)) % np.uint64(prime)
        out[k, 1:] = np.cumsum(terms) % np.uint64(prime)
    return out


def fingerprints(words: DataFrame, short: int) -> DataFrame:
    """As rotations, for the groups left out there; words has (word, ref, n)."""
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, ref, n in zip(*(batch.column(c).to_pylist() for c in ("word", "ref", "n")), strict=True):
                codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
                size, front, back = len(codes), _prefix_prints(codes), _prefix_prints(codes[::-1])
                fresh = np.concatenate([[True], codes[1:] != codes[:-1]])
                for whole in (True, False):
                    if not whole and size <= short:
                        continue
                    last = size + 1 if whole else size  # places of a missing character, or the character skipped
                    for start in range(0, last, ROWS_PER_BATCH):
                        x = np.arange(start, min(start + ROWS_PER_BATCH, last), dtype=np.uint64)
                        y = np.uint64(size if whole else size - 1) - x
                        parts = np.stack([x, y, *front[:, x], *back[:, y]], axis=1).astype(">u8")
                        rows = len(x)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([whole] * rows),
                             pa.array(np.zeros(rows, bool) if whole else fresh[x]), pa.array([ref] * rows, pa.string()), pa.array([n] * rows, pa.int64())],
                            names=["key", "whole", "fresh", "ref", "n"])

    return words.where(F.length("word") >= short).select("word", "ref", "n").mapInArrow(file, "key binary, whole boolean, fresh boolean, ref string, n long")


def neighbours(filed: DataFrame) -> DataFrame:
    """(ref, n_near, best): number of neighbours and the best of them, least by (-n, ref), for refs that have any."""
    by_rank = W.partitionBy("key").orderBy(F.desc("n"), "ref")
    group = W.partitionBy("key")
    me = F.struct((-F.col("n")).alias("less"), "ref").cast(BEST)
    rows = filed.repartitionByRange("key").select(
        "ref", "whole", "fresh", F.row_number().over(by_rank).alias("place"), F.first(me).over(by_rank).alias("top"), F.lead(me, 1).over(by_rank).alias("after"),
        F.count("*").over(group).alias("rows"), F.count_if("whole").over(group).alias("wholes"), F.count_if("fresh").over(group).alias("freshes"))
    found = F.when(F.col("whole"), F.col("freshes")).otherwise(
        F.col("rows") - F.col("wholes") - 1 + F.when(F.col("fresh"), F.col("wholes")).otherwise(F.lit(0)))
    best = F.when(F.col("place") == 1, F.col("after")).otherwise(F.col("top"))
    return rows.where("rows > 1").select("ref", found.alias("found"), best.alias("best")).groupBy("ref").agg(
        F.sum("found").alias("n_near"), F.min("best").alias("best"))


def _named(found: DataFrame, long: DataFrame) -> DataFrame:
    """Places of long words in their order, as words."""
    names = long.select("ref", "word")
    best = F.struct(F.col("best.less").alias("less"), F.col("b.word").alias("ref")).cast(BEST)
    return (found.join(names, "ref").join(names.select(F.col("ref").alias("at"), F.struct("word").alias("b")), F.col("best.ref") == F.col("at"))
            .select(F.col("word").alias("ref"), "n_near", best.alias("best")))


def variants(words: DataFrame, short: int = SHORT, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words."""
    known = cut(words)
    found = neighbours(rotations(known, short))
    stats = known.agg(F.max("n").alias("most"), F.max(F.length("word")).alias("longest")).first()
    if (stats["longest"] or 0) >= short:
        # in place of a long word its rows carry its place in the order of words
        long = cut(known.where(F.length("word") >= short).orderBy("word").withColumn("ref", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")))
        found = found.unionByName(_named(neighbours(fingerprints(long, short)), long))
        found = found.groupBy("ref").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    form_n = -F.col("best.less")
    counts = F.when(form_n >= factor * F.col("n"), form_n)
    judged = cut(known.join(found.withColumnRenamed("ref", "word"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(counts.isNotNull(), F.col("best.ref")).alias("form"), counts.alias("form_n")))
    # a form is at least `factor` times as frequent, so chains are short, and each step doubles what a pointer spans
    links = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2.0, math.log(max(stats["most"] or 1, 1), factor) + 1)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return judged.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# DuckDB has no checksum of this kind: its table of 256 remainders is computed, then folded over the bytes of each run.
SQL = rf"""
WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
remainders AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS i, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
sums AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(i || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM runs, remainders),
words AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM sums),
v AS (SELECT word, count(*)::BIGINT AS n FROM words WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING count(*) >= {MIN_COUNT}),
gone AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT DISTINCT g.word, v.word, v.n FROM gone g JOIN v ON g.rest = v.word
    UNION SELECT DISTINCT v.word, g.word, g.n FROM gone g JOIN v ON g.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS most FROM near GROUP BY word),
judged AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= {FORM_FACTOR} * v.n THEN other END AS form,
    CASE WHEN most >= {FORM_FACTOR} * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form FROM judged UNION ALL SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON j.word = c.form)
SELECT j.word, j.form, c.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON c.word = j.word AND c.form IS NULL
"""


@CATALOGUE.register("op12_spelling_variants", SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(damaged_words(table(spark, sf_dir, "documents"))))
