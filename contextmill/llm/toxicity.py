"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as classes: insult, threat, target, negation, reported speech, other. Insult stems are learned: every
word beginning (3 to 8 letters, and whole words) is counted by document over a bounded sample of labelled rows, and
the shortest beginnings whose share of toxic documents cannot be chance become stems. The other classes are short
fixed word lists in four languages. One small transducer per class is composed with the others into a single one;
it reads a clause and yields a pattern - insult or threat, with or without a target, negated, reported - and a
weight. A document is scored from its matched clauses by pattern, never from single words. The pattern weights are
fitted on the same sample by logistic regression.

Texts are scored row by row where they are scanned. An Aho-Corasick pass finds the few clauses worth reading.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.catalogue import Catalogue
from .common import slices, table

CATALOGUE = Catalogue()
#: At most this many labelled rows are learned from: those with the smallest hash of their id.
MAX_TRAINING_ROWS = 12_000
MIN_STEM, MAX_STEM = 3, 8
#: Beginnings sent to the driver; the most frequent in toxic documents come first.
MAX_CANDIDATES = 20_000
#: Share of toxic documents among those with a stem: the sharpest stems are taken first.
SHARES = (0.9, 0.7, 0.5)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_ENDS = str.maketrans(dict.fromkeys("!?;:\n|", "."))

# fixed word lists, by class
THREATS = frozenset("""kill kills hurt destroy beat burn punch stab shoot murder töten umbringen schlagen verbrennen tuer tuerai
 frapper brûler détruire matar mataré golpear quemar destruir""".split())
TARGETS = frozenset("""you your yours he him she her they them their people du dich dir ihr euch sie tu te toi vous votre
 usted ustedes ellos vosotros""".split())
NEGATIONS = frozenset("not never no don't isn't aren't nicht kein keine nie niemals pas jamais aucun nunca jamás ni".split())
REPORTS = frozenset("""said says according reported quoted claimed wrote sagte laut schrieb berichtete selon disait écrit dijo según
 afirmó escribió""".split())
PATTERNS = ("insult", "insult+target", "insult+negated", "insult+reported", "threat", "threat+target", "threat+negated", "threat+reported")
NEGATION_SCOPE = 3
N_FEATURES = len(PATTERNS) + 1


@dataclass(frozen=True)
class Transducer:
    """Deterministic; a pair without an arc stays in its state at no weight. final names what a state has seen."""

    arcs: dict[tuple[object, str], tuple[object, float]]
    start: object
    final: dict[object, frozenset[str]] = field(default_factory=dict)

    def step(self, state: object, symbol: str) -> tuple[object, float]:
        return self.arcs.get((state, symbol), (state, 0.0))


def compose(a: Transducer, b: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """Both read the same clause in step: states are pairs, weights add, finals join. Only reachable pairs are built."""
    start, arcs, final, todo = (a.start, b.start), {}, {}, [(a.start, b.start)]
    while todo:
        state = todo.pop()
        if state in final:
            continue
        final[state] = a.final.get(state[0], frozenset()) | b.final.get(state[1], frozenset())
        for symbol in symbols:
            (x, u), (y, v) = a.step(state[0], symbol), b.step(state[1], symbol)
            arcs[state, symbol] = ((x, y), u + v)
            todo.append((x, y))
    return Transducer(arcs, start, final)


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")


def grammar() -> Transducer:
    """The composed transducer. Negation reaches the next words only; the rest of the clause is seen by all others."""
    seen = lambda symbol, weight: Transducer({(0, symbol): (1, weight), (1, symbol): (1, weight)}, 0, {1: frozenset({symbol})})
    arcs: dict[tuple[object, str], tuple[object, float]] = {}
    for left in range(NEGATION_SCOPE + 1):
        for symbol in SYMBOLS:
            arcs[left, symbol] = (max(left - 1, 0), 0.0)
        arcs[left, "negation"] = (NEGATION_SCOPE, 0.0)
        if left:
            arcs[left, "insult"] = arcs[left, "threat"] = ("negated", 0.0)
    negation = Transducer(arcs, 0, {"negated": frozenset({"negated"})})
    out = seen("insult", 1.0)
    for part in (seen("threat", 1.0), seen("target", 0.0), negation, seen("report", 0.0)):
        out = compose(out, part, SYMBOLS)
    return out


def pattern_of(flags: frozenset[str]) -> str | None:
    kind = "insult" if "insult" in flags else "threat" if "threat" in flags else None
    if kind is None:
        return None
    for flag, name in (("negated", "negated"), ("report", "reported"), ("target", "target")):
        if flag in flags:
            return f"{kind}+{name}"
    return kind


class ClauseMatcher:
    """Finds and reads the clauses of a text that hold a learned stem or a threat."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.stems, self.machine = stems, grammar()
        self.lengths = sorted({len(s) for s in stems if s[-1] != "$"}, reverse=True)
        self.finder = ahocorasick.Automaton()
        for word in {*(s.rstrip("$") for s in stems), *THREATS}:
            self.finder.add_word(word, len(word))
        if len(self.finder):
            self.finder.make_automaton()

    def stem(self, word: str) -> str | None:
        if word + "$" in self.stems:
            return word + "$"
        return next((word[:n] for n in self.lengths if n <= len(word) and word[:n] in self.stems), None)

    def _symbol(self, word: str) -> tuple[str, float]:
        stem = self.stem(word)
        if stem is not None:
            return "insult", self.stems[stem]
        for symbol, words in (("threat", THREATS), ("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS)):
            if word in words:
                return symbol, 1.0
        return "other", 0.0

    def clauses(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, pattern, weight) of every matched clause, in characters of the lower-cased text."""
        low = (text or "").lower()
        if not low or not len(self.finder):
            return []
        found, flat, done = [], None, -1
        for last, size in self.finder.iter(low):
            at = last - size + 1
            if at < done or (at and low[at - 1].isalpha()):
                continue
            if flat is None:
                flat = low.translate(CLAUSE_ENDS)
            start = flat.rfind(".", max(done, 0), at) + 1 or max(done, 0)
            end = flat.find(".", at)
            end = len(flat) if end < 0 else end
            state, weight = self.machine.start, 0.0
            for word in WORD.findall(flat, start, end):
                symbol, own = self._symbol(word)
                state, step = self.machine.step(state, symbol)
                weight += step * own
            pattern = pattern_of(self.machine.final[state])
            if pattern is not None:
                found.append((start, end, pattern, weight))
            done = end
        return found


def features(clauses: list[tuple[int, int, str, float]]) -> np.ndarray:
    """Per pattern log(1 + sum of clause weights), and the same over all clauses with an insult."""
    x = np.zeros(N_FEATURES)
    for _, _, pattern, weight in clauses:
        x[PATTERNS.index(pattern)] += weight
    x[-1] = x[:4].sum()
    return np.log1p(np.maximum(x, 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept; Newton steps with a ridge on the weights."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _beginnings(text: str | None) -> set[str]:
    out: set[str] = set()
    for word in set(WORD.findall((text or "").lower())):
        out.add(word + "$")
        out.update(word[:n] for n in range(MIN_STEM, min(MAX_STEM, len(word)) + 1))
    return out


def learn_stems(rows: DataFrame, n_toxic: int, n_all: int) -> dict[str, float]:
    """Stem -> weight (log odds) from rows of (text, toxic)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for batch in slices(batches, 0):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(_beginnings(text))
        names = [*toxic, *(k for k in clean if k not in toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[k] for k in names], pa.int64()), pa.array([clean[k] for k in names], pa.int64())],
                                         names=["stem", "bad", "good"])

    if not n_toxic or n_toxic == n_all:
        return {}
    base = n_toxic / n_all
    counted = (rows.select("text", "toxic").mapInArrow(count, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
               .where((F.col("bad") >= 4) & (F.col("bad") >= SHARES[-1] * (F.col("bad") + F.col("good")))))
    candidates = counted.orderBy(F.desc("bad"), "stem").limit(MAX_CANDIDATES).collect()
    return _choose({r["stem"]: (r["bad"], r["good"]) for r in candidates}, base)


def _choose(counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """The shortest telling beginnings, each made as long as it can be without losing a tenth of its toxic documents."""
    taken: dict[str, float] = {}
    children: dict[str, list[str]] = {}
    for stem in counts:
        bare = stem.rstrip("$")
        children.setdefault(bare[:MAX_STEM] if stem[-1] == "$" else bare[:-1], []).append(stem)
        if stem[-1] == "$" and len(bare) <= MAX_STEM:
            children.setdefault(bare, []).append(stem)
    chance = math.log(max(len(counts), 1)) + 5
    for floor in SHARES:
        for stem in sorted(counts, key=lambda k: (len(k.rstrip("$")), k)):
            bad, good = counts[stem]
            share = (bad + 0.5) / (bad + good + 1)
            # how much likelier these counts are at their own share than at the common one must beat the number of candidates
            gain = bad * math.log(share / base) + good * math.log(max(1 - share, 1e-9) / (1 - base))
            bare = stem.rstrip("$")
            if share < floor or gain <= chance or any(bare[:n] in taken for n in range(MIN_STEM, len(bare) + 1)):
                continue
            if any(t.startswith(bare) and counts[t][0] >= 0.5 * bad for t in taken):
                continue  # most of its documents hold a sharper stem
            while longer := [c for c in children.get(stem, ()) if c != stem and counts[c][0] >= 0.9 * counts[stem][0]]:
                stem = max(longer, key=lambda c: (counts[c][0], -counts[c][1], c))
            bad, good = counts[stem]
            share = (bad + 0.5) / (bad + good + 1)
            taken[stem] = math.log(share / (1 - share)) - math.log(base / (1 - base))
    return taken


@dataclass(frozen=True)
class ToxicityModel:
    stems: dict[str, float]
    weights: np.ndarray

    def scorer(self):
        matcher, weights = ClauseMatcher(self.stems), self.weights
        return lambda text: (lambda found: (float(1 / (1 + math.exp(-max(-30.0, min(30.0, features(found) @ weights[:-1] + weights[-1]))))), found))(matcher.clauses(text))


def fit_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Learns stems and pattern weights from at most max_rows rows of labels (ids with a 0/1 label).

    Null labels and ids are ignored; of repeated labels of an id the largest counts. Without toxic or without clean
    rows there are no stems, and the score is the smoothed share of toxic labels.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
             .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    # at most max_rows pairs of numbers: bounded by the parameter
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    sizes = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    stems = learn_stems(rows, sizes["bad"], sizes["n"])
    matcher = ClauseMatcher(stems)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            x = [features(matcher.clauses(t)).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int64())], names=["x", "y"])

    got = rows.select("text", "toxic").mapInArrow(read, "x array<double>, y long").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
    x = np.repeat(np.array([r["x"] for r in got]).reshape(-1, N_FEATURES), [r["n"] for r in got], axis=0)
    y = np.repeat(np.array([r["y"] for r in got], dtype=float), [r["n"] for r in got])
    # two made-up rows, one of each label, keep the intercept finite where a class is missing
    blank = np.zeros((2, N_FEATURES))
    return ToxicityModel(stems, fit_logistic(np.vstack([x, blank]), np.append(y, [0.0, 1.0])))


def score_toxicity(documents: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """documents with tox_score (0 to 1) and tox_clauses, the matched clauses.

    Null and empty texts have no clauses and get the base score. Rows are scored alone, so repeats get equal scores.
    Of existing columns only those two names are replaced.
    """
    kept = documents.drop("tox_score", "tox_clauses")
    clause = "array<struct<start:int,end:int,pattern:string,weight:double>>"
    at = kept.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.scorer()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("weight", pa.float64())]))
        for batch in slices(batches, at):
            scored = [judge(t) for t in batch.column(at).to_pylist()]
            spans = [[dict(zip(("start", "end", "pattern", "weight"), c, strict=True)) for c in found] for _, found in scored]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in scored], pa.float64()), pa.array(spans, kind)],
                                             names=[*batch.schema.names, "tox_score", "tox_clauses"])

    from pyspark.sql.types import StructType
    schema = StructType(list(kept.schema.fields)).add("tox_score", "double")
    return kept.mapInArrow(score, StructType([*schema.fields, *spark_schema(f"tox_clauses {clause}").fields]))


def spark_schema(ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl)


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


@CATALOGUE.register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, training_labels(table(spark, sf_dir, "labels")))
    return score_toxicity(documents.select("doc_id", "text"), model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.3).cast("int").alias("predicted"), F.size("tox_clauses").alias("n_clauses"))
