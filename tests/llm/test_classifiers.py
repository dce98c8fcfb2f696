"""Quality and toxicity: held-out accuracy, odd rows, parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contextmill.llm import quality, toxicity
from contextmill.llm.quality import ByteConvNet, fit_quality, halves_of, score_quality
from contextmill.llm.toxicity import ClauseMatcher, compose, fit_toxicity, grammar, pattern_of, score_toxicity

from .helpers import AWKWARD, clashing, documents, prose


def area(y, s):
    order = np.argsort(s, kind="stable")
    _, first, count = np.unique(s[order], return_index=True, return_counts=True)
    ranks = np.empty(len(s))
    ranks[order] = np.repeat(first + (count + 1) / 2, count)
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("name, label, least", [("op1_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"  # smaller tables hold too few toxic words of each language to learn them
    got = entry.queries()[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", label).toPandas()
    assert area(got[label].to_numpy(), got["score"].to_numpy()) > least
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def labelled(spark):
    good = [prose(i, 60) for i in range(60)]
    bad = [prose(100 + i, 30) + f" you vile snarg{'abc'[i % 3]} . " + prose(200 + i, 20) for i in range(40)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(100)] + [(999, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return documents(spark, texts), labels


def test_toxicity_learns_stems_and_scores_clauses(spark):
    docs, labels = labelled(spark)
    model = fit_toxicity(clashing(docs), clashing(labels))
    assert any("snarga".startswith(s.rstrip("$")) for s in model.stems)
    texts = ["you snarga", "he said snargb once", "never a snargc", "prose only", *AWKWARD, "x" * 200_000 + " snargd", "snarga " * 20_000]
    rows = sorted(score_toxicity(clashing(documents(spark, texts)), model).collect(), key=lambda r: r.doc_id)
    scores = [r.tox_score for r in rows]
    assert all(0 <= s <= 1 for s in scores) and scores[0] > 0.3 > scores[3] and scores[4] == scores[5] == scores[3]
    assert rows[0].tox_clauses[0].pattern.startswith("insult") and not rows[3].tox_clauses
    assert scores[-1] > 0.3


def test_nothing_to_learn_from(spark):
    docs, labels = labelled(spark)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        model = fit_toxicity(docs, few)
        assert not model.stems
        assert {r.tox_score for r in score_toxicity(docs, model).collect()} != set()
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_grammar_reads_clauses():
    machine = ClauseMatcher({"vile$": 3.0, "scum": 4.0})
    found = lambda text: [(p, w) for _, _, p, w in machine.clauses(text)]
    assert found("You are vile. Fine.") == [("insult+target", 3.0)]
    assert found("they are not so vile") == [("insult+negated", 3.0)]
    assert found("not one of all those vile scummers") == [("insult", 7.0)]
    assert found("it was reported: he is vile; she said you are scum") == [("insult+target", 3.0), ("insult+reported", 4.0)]
    assert found("I will hurt you!") == [("threat+target", 1.0)]
    assert found("vilest, discum") == []
    joined = compose(grammar(), grammar(), toxicity.SYMBOLS)
    state, weight = joined.step(joined.start, "insult")
    assert weight == 2.0 and pattern_of(joined.final[state]) == "insult"


def test_quality_rows(spark):
    docs, labels = labelled(spark)
    net = fit_quality(clashing(docs), clashing(labels))
    texts = [*AWKWARD, "z" * 300_000, prose(5, 50), prose(5, 50)]
    got = sorted(score_quality(clashing(documents(spark, texts)), net).collect(), key=lambda r: r.doc_id)
    scores = [r.quality_score for r in got]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[-1] == pytest.approx(scores[-2], abs=1e-6)
    assert score_quality(docs.limit(0), net).count() == 0
    assert all(0 <= r.quality_score <= 1 for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect())
    assert quality.training_labels(labels.where(F.col("doc_id") < 100)).count() < 101


def test_chunks_cover_every_byte_and_gradients_are_right():
    for n in (0, 1, 255, 256, 257, 1000):
        data, _ = halves_of("x" * n)
        assert (data[:, :quality.HALF] == ord("x")).sum() == n and len(data) >= 2
    net = ByteConvNet()
    texts, y = [halves_of(prose(i, 40)) for i in range(3)], np.array([1.0, 0.0, 1.0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sizes = np.array([len(d) for d, _ in texts])

    def loss():
        local = np.vstack([net.local(*t) for t in texts]).astype(np.float64)
        q = net.combine(local, np.cumsum(sizes) - sizes)
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    grads = net.gradients(texts, y)
    for name in ("dense", "out", "conv", "cb"):
        flat = net.p[name].reshape(-1)
        for i in (0, len(flat) // 2):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4)
