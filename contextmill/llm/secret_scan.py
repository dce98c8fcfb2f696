"""Secret scan: fixed patterns, and two character Markov models for what the patterns do not know.

Base spans come from three patterns (assign, access, hex). Candidates for the models are runs of at least RUN_LENGTH
letters, digits and `+/_-` between the matches of the assign pattern; numbers, and runs that hold a hex or access span, are
none. One model describes random strings, the other ordinary identifiers, both as chains over pairs of neighbouring
characters. They are trained on labelled samples that all documents supply, each distinct string once: what the base patterns
found is random, runs without digit and plus sign are ordinary. A candidate is a secret if its log-likelihood ratio is at
least MIN_RATIO per pair. Ratios are whole thousandths, so sums do not depend on their order.

Everything is array expressions over the row of a document: only distinct labelled strings and counts of pairs are shuffled,
and the model (one number for each pair of the alphabet) is the one thing that reaches the driver. Positions are running
totals over the pieces between matches, in blocks, so a text of any number of matches takes linear time.

Null texts count as empty, repeated rows give repeated results, null ids are kept, other columns are ignored whatever their
names. Without random samples that model is uniform; without ordinary samples nothing is added to the base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.catalogue import Catalogue
from .common import table, written

CATALOGUE = Catalogue()

# The base patterns with the least lengths of their matches.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN_LENGTH = 16
RUN = rf"[\w+/-]{{{RUN_LENGTH},}}"
#: What every assign match begins with, in a form that is tried at few places of a text.
KEYED = r"""[pPsStTaA](?:[aA][sS][sS][wW](?:[oO][rR])?[dD]|[eE][cC][rR][eE][tT]|[oO][kK][eE][nN]|[pP][iI]_?[kK][eE][yY])["']?\x20*[:=]"""
#: Least log-likelihood ratio per pair of characters, and the unit of ratios, in parts of a nat.
MIN_RATIO, UNIT = 3000, 1000
#: Weight of the uniform distribution in the random model. The ordinary model starts every first character with BACKOFF counts,
#: dealt by how often the second character follows any, and every second character with START counts.
UNIFORM, BACKOFF, START = 0.5, 6.6, 0.1
PIECE, BLOCK = 4096, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _scan(values: Column, first: Column) -> Column:
    return F.aggregate(values, F.array(first.cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_totals(values: Column) -> Column:
    """Inclusive running totals of an array of numbers. Appending to an array copies it, so totals are built in blocks."""
    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK).cast("int"), F.lit(0)))
        block = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda acc, x: acc + x))
        return let(_scan(sums, F.lit(0)), lambda starts: F.flatten(
            F.transform(blocks, lambda b: F.slice(_scan(block(b), starts[b]), F.lit(2), F.lit(BLOCK)))))

    return let(values, of)


def located(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Array of (start, end, found): the leftmost non-overlapping matches, in code points. The pattern never matches nothing.
    Texts without a match of hint, if given, have none of the pattern."""
    def place(found: Column, gaps: Column) -> Column:
        ends = running_totals(F.transform(found, lambda x, i: (F.length(gaps[i]) + F.length(x)).cast("long")))
        return let(ends, lambda e: F.transform(found, lambda x, i: F.struct(
            (e[i] - F.length(x)).alias("start"), e[i].alias("end"), x.alias("found"))))

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern), lambda gaps: place(found, gaps)))
    return F.when(F.rlike(text, F.lit(hint or pattern)), every).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))


def base_and_candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, runs): arrays of (start, end, found), one row per document row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # the shortest access and hex match that counts: shorter runs of a kind are dropped, and no longer one begins inside them
    rows = rows.select("doc_id", "text", located(F.col("text"), ASSIGN, KEYED).alias("all_assign"),
                       located(F.col("text"), rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}").alias("access"),
                       located(F.col("text"), rf"[0-9a-f]{{{MIN_HEX},}}").alias("hex"))
    gap = "struct<start:bigint,text:string>"
    gaps = let(F.split("text", ASSIGN), lambda g: F.transform(
        g, lambda t, i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.col("all_assign")[F.greatest(i - 1, F.lit(0))]["end"]).alias("start"),
                                 t.alias("text"))))
    gaps = F.when(F.size("all_assign") > 0, gaps.cast(f"array<{gap}>")).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("text").alias("text"))))
    runs = F.flatten(F.transform(F.filter(gaps, lambda g: F.rlike(g["text"], F.lit(RUN))), lambda g: F.transform(
        located(g["text"], RUN), lambda r: F.struct((g["start"] + r["start"]).alias("start"), (g["start"] + r["end"]).alias("end"), r["found"].alias("found")))))
    based = rf"[0-9a-f]{{{MIN_HEX}}}|AKIA[A-Z0-9]{{{MIN_ACCESS - 4}}}"
    counted = F.filter("all_assign", lambda a: F.length(F.regexp_extract(a["found"], ASSIGN, 2)) >= MIN_ASSIGN)
    return rows.select("doc_id", counted.alias("assign"), "access", "hex", F.filter(
        F.when(F.rlike("text", F.lit(RUN)), runs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")),
        lambda r: F.rlike(r["found"], F.lit("[A-Za-z]")) & ~F.rlike(r["found"], F.lit(based))).alias("runs"))


def labelled_samples(scanned: DataFrame) -> DataFrame:
    """(sample, random): the distinct strings that train the models."""
    values = F.transform("assign", lambda a: F.regexp_extract(a["found"], ASSIGN, 2))
    values = F.filter(values, lambda v: F.rlike(v, F.lit(f"^{RUN}$")) & F.rlike(v, F.lit("[A-Za-z]")) & F.rlike(v, F.lit("[0-9]")))
    random = F.concat(values, F.transform("access", lambda a: a["found"]), F.transform("hex", lambda a: a["found"]))
    ordinary = F.filter(F.transform("runs", lambda r: r["found"]), lambda r: ~F.rlike(r, F.lit("[0-9+]")))
    both = F.concat(F.transform(random, lambda s: F.struct(s.alias("sample"), F.lit(True).alias("random"))),
                    F.transform(ordinary, lambda s: F.struct(s.alias("sample"), F.lit(False).alias("random"))))
    return scanned.select(F.explode(both).alias("s")).select("s.sample", "s.random").distinct()


def _pairs(text: Column) -> Column:
    """Arrays of numbered character pairs, a number of alphabet size * first + second, piece by piece."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?=(.{{1,{PIECE + 1}}})).{{1,{PIECE}}}"), F.lit(1))
    numbers = lambda p: F.transform(F.regexp_extract_all(p, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.transform(pieces, lambda p: let(numbers(p), lambda n: F.zip_with(
        F.slice(n, F.lit(1), F.size(n) - 1), F.slice(n, F.lit(2), F.size(n)), lambda a, b: a * len(ALPHABET) + b)))


def fit_ratios(samples: DataFrame) -> list[int]:
    """Log-likelihood ratio of random to ordinary for every pair of the alphabet, in units of 1/UNIT nat."""
    size = len(ALPHABET)
    rows = samples.select("random", F.explode(_pairs(F.col("sample"))).alias("p")).select("random", F.explode("p").alias("pair"))
    counts = rows.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()  # at most twice the pairs of the alphabet
    pair: dict[bool, list[int]] = {True: [0] * size * size, False: [0] * size * size}
    for r in counts:
        pair[r["random"]][r["pair"]] = r["n"]
    follows = [sum(pair[False][b::size]) + START for b in range(size)]
    out = []
    for a in range(size):
        n_random, n_ordinary = (sum(pair[kind][a * size:(a + 1) * size]) for kind in (True, False))
        for b in range(size):
            p_random = UNIFORM / size + (1 - UNIFORM) * (pair[True][a * size + b] + 1 / size) / (n_random + 1)
            p_ordinary = (pair[False][a * size + b] + BACKOFF * follows[b] / sum(follows)) / (n_ordinary + BACKOFF)
            out.append(math.floor(UNIT * math.log(p_random / p_ordinary) + 0.5))
    return out


def ratio_of(text: Column, ratios: list[int]) -> Column:
    """Summed ratio of a run, in units of 1/UNIT nat."""
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<long>")  # folded to one constant
    zero = F.lit(0).cast("long")
    return F.aggregate(_pairs(text), zero, lambda acc, p: acc + F.aggregate(p, zero, lambda s, x: s + weights[x]))


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"], F.lit(kind).alias("kind"), s["end"], F.lit(None).cast("long").alias("ratio"))


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[int] | None = None) -> DataFrame:
    """(doc_id, spans array of (start, kind number, end, ratio)): all spans of a document row, by start and kind.

    Kinds are numbered as in KINDS. ratios come from fit_ratios; by default they are learned from these documents.
    """
    scanned = written(base_and_candidates(documents, id_col, text_col), "secret-scan")  # texts are scanned once
    if ratios is None:
        ratios = fit_ratios(labelled_samples(scanned))
    base = [F.transform(name, _of_kind(k)) for k, name in enumerate(KINDS[:3])]
    judged = F.transform("runs", lambda r: F.struct(r["start"], F.lit(3).alias("kind"), r["end"], ratio_of(r["found"], ratios).alias("ratio")))
    added = F.filter(judged, lambda r: r["ratio"] >= MIN_RATIO * (r["end"] - r["start"] - 1))
    return scanned.select("doc_id", F.array_sort(F.concat(*base, added)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


_RUN = rf"[A-Za-z0-9+/_-]{{{RUN_LENGTH},}}"
# Letters of the key words are spelt in both cases: in DuckDB's patterns, (?i) also folds letters beyond ASCII.
_A = ("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
      r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT rid, 0 AS k, regexp_extract_all(t, '{_A}') AS m, regexp_split_to_array(t, '{_A}') AS g FROM d
    UNION ALL SELECT rid, 1, regexp_extract_all(t, '{ACCESS}'), regexp_split_to_array(t, '{ACCESS}') FROM d
    UNION ALL SELECT rid, 2, regexp_extract_all(t, '{HEX}'), regexp_split_to_array(t, '{HEX}') FROM d WHERE regexp_matches(t, '[0-9a-f]{{{MIN_HEX}}}')),
found AS (SELECT rid, k, i, s, e - length(s) AS b, e FROM (
    SELECT rid, k, i, m[i] AS s, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY rid, k ORDER BY i) AS e
    FROM (SELECT rid, k, m, g, unnest(range(1, len(m) + 1)) AS i FROM parts))),
base AS (SELECT * FROM found WHERE (k = 0 AND length(regexp_extract(s, '{_A}', 2)) >= {MIN_ASSIGN})
    OR (k = 1 AND length(s) >= {MIN_ACCESS}) OR (k = 2 AND length(s) >= {MIN_HEX})),
gaps AS (SELECT p.rid, p.i, p.t, coalesce(f.e, 0) AS o FROM
    (SELECT rid, i, g[i] AS t FROM (SELECT rid, g, unnest(range(1, len(g) + 1)) AS i FROM parts WHERE k = 0)) p
    LEFT JOIN found f ON f.rid = p.rid AND f.k = 0 AND f.i = p.i - 1),
runs AS (SELECT rid, s, o + e - length(s) AS b, o + e AS e FROM (
    SELECT rid, i, j, o, m[j] AS s, sum(length(g[j]) + length(m[j])) OVER (PARTITION BY rid, i ORDER BY j) AS e
    FROM (SELECT rid, i, o, m, g, unnest(range(1, len(m) + 1)) AS j
          FROM (SELECT rid, i, o, regexp_extract_all(t, '{_RUN}') AS m, regexp_split_to_array(t, '{_RUN}') AS g FROM gaps)))
    WHERE regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '[0-9a-f]{{{MIN_HEX}}}|AKIA[A-Z0-9]{{{MIN_ACCESS - 4}}}')),
samples AS (SELECT DISTINCT s, r FROM (
    SELECT CASE WHEN k = 0 THEN regexp_extract(s, '{_A}', 2) ELSE s END AS s, 1 AS r, k FROM base
    UNION ALL SELECT s, 0, 3 FROM runs WHERE NOT regexp_matches(s, '[0-9+]'))
    WHERE k <> 0 OR (regexp_matches(s, '^{_RUN}$') AND regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '[0-9]'))),
pairs AS (SELECT r, s[i] AS a, s[i + 1] AS b, count(*) AS n FROM (SELECT s, r, unnest(range(1, length(s))) AS i FROM samples) GROUP BY ALL),
letters AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c),
seen AS (SELECT x.c AS a, y.c AS b, coalesce(p.n, 0) AS n1, coalesce(q.n, 0) AS n0,
           sum(coalesce(p.n, 0)) OVER (PARTITION BY x.c) AS t1, sum(coalesce(q.n, 0)) OVER (PARTITION BY x.c) AS t0,
           sum(coalesce(q.n, 0)) OVER (PARTITION BY y.c) AS f0, sum(coalesce(q.n, 0)) OVER () AS all0
    FROM letters x CROSS JOIN letters y LEFT JOIN pairs p ON p.r = 1 AND p.a = x.c AND p.b = y.c LEFT JOIN pairs q ON q.r = 0 AND q.a = x.c AND q.b = y.c),
ratios AS (SELECT a, b, floor({UNIT} * ln(({UNIFORM}::DOUBLE / {len(ALPHABET)} + (1 - {UNIFORM}::DOUBLE) * (n1 + 1::DOUBLE / {len(ALPHABET)}) / (t1 + 1))
                                     / ((n0 + {BACKOFF}::DOUBLE * (f0 + {START}::DOUBLE) / (all0 + {START}::DOUBLE * {len(ALPHABET)})) / (t0 + {BACKOFF}::DOUBLE))) + 0.5)::BIGINT AS w FROM seen),
judged AS (SELECT rid, x.b, x.e, sum(w) AS score FROM (SELECT rid, s, b, e, unnest(range(1, length(s))) AS i FROM runs) x
    JOIN ratios ON ratios.a = x.s[x.i] AND ratios.b = x.s[x.i + 1] GROUP BY rid, x.b, x.e),
spans AS (SELECT rid, b, k, e FROM base UNION ALL SELECT rid, b, 3, e FROM judged WHERE score >= {MIN_RATIO} * (e - b - 1)),
out AS (SELECT rid, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'markov'][k + 1] || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'markov'][k + 1] || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN out USING (rid)
"""


@CATALOGUE.register("op11_secret_scan", SQL)
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
                        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
