import random
import re
import zlib
from collections import Counter

import pytest

from contextmill.llm.spelling import damaged_words, fingerprints, neighbours, rotations, variants, vocabulary
from pyspark.sql import functions as F

from .helpers import AWKWARD, clashing, documents, prose


def counted(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    return n


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def brute(vocab):
    out, form = [], {}
    for w, n in vocab.items():
        others = [v for v in vocab if near(w, v)]
        best = min(others, key=lambda v: (-vocab[v], v), default=None)
        form[w] = (best, len(others)) if best and vocab[best] >= 5 * n else (None, len(others))
    for w, n in vocab.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][1], vocab.get(form[w][0])))
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def made(seed, count, low, high, letters="abé"):
    r, out = random.Random(seed), {}
    while len(out) < count:
        w = "".join(r.choice(letters) for _ in range(r.randrange(low, high)))
        for _ in range(3):
            i = r.randrange(len(w))
            out.setdefault(w, r.choice([5, 6, 30, 30, 150, 1000]))
            w = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1:]]) or "a"
    return out


@pytest.mark.parametrize("short", [3, 8, 64])
def test_against_brute_force(spark, short):
    vocab = made(short, 250, 6, 12)
    got = variants(spark.createDataFrame(list(vocab.items()), "word string, n long"), short)
    assert rows(got) == brute(vocab)


def test_both_ways_give_the_same(spark):
    words = spark.createDataFrame(list(made(4, 200, 6, 9).items()), "word string, n long")
    one = neighbours(rotations(words, 64))
    other = neighbours(fingerprints(words.withColumn("ref", F.col("word")), 0))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_words_of_documents(spark):
    texts = [prose(i, 300, 60) for i in range(30)] + ["Straße ÀÉ÷× aé-b'c"] * 40 + [" ".join(["colour"] * 40 + ["color"] * 7 + ["colur"] * 6)] * 9 + AWKWARD
    df = documents(spark, texts).unionByName(documents(spark, [None, "Straße ÀÉé"] * 3, ids=[None] * 6))
    want = counted([(r.doc_id, r.text) for r in df.collect()])
    words = damaged_words(clashing(df))
    assert {r.word: r["count"] for r in words.groupBy("word").count().collect()} == want
    assert rows(variants(vocabulary(words))) == brute({w: n for w, n in want.items() if len(w) >= 6 and n >= 5})


def test_huge_words(spark):
    texts = [("x" * 300_000 + " " + "x" * 299_999 + " " + "xy" * 150_000) + " yx" * 3] * 6
    got = rows(variants(vocabulary(damaged_words(documents(spark, texts)))))
    assert [(len(w), near_by, n) for w, _, _, n, near_by, _ in got] == [(len(w), sum(near(w, v) for v in vs), n) for vs in [dict(
        (w, n) for w, n in counted(enumerate(texts)).items() if len(w) >= 6 and n >= 5)] for w, n in sorted(vs.items())]


def test_empty_table(spark):
    got = variants(vocabulary(damaged_words(documents(spark, []))))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
