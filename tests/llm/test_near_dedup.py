import random
import re
from collections import Counter

import numpy as np
import pytest

from contextmill.llm import near_dedup
from contextmill.llm.near_dedup import bag_minhash, components, drop_near_copies, near_groups, shingles

from .helpers import AWKWARD, clashing, documents, prose


def bag(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


def brute(docs):
    bags = [(i, bag(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            if a and b and overlap(a, b) >= 0.8 - 1e-9:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def edited(text, seed, n):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    out = [prose(i, 80, 5000) for i in range(30)]
    for i in range(10):
        out += [edited(out[i], 50 + i, 1), edited(out[i], 70 + i, 3), out[i], out[i].upper()]
    # copies near one text, but not near each other
    base = prose(400, 300, 9000)
    out += [base] + [edited(base, 500 + i, 5) for i in range(40)]
    out += ["same words over and over " * 50, "same words over and over " * 45, "same words over and over " * 30, "a b c", "A, b; c", "a b"]
    return out + AWKWARD


def test_against_brute_force(spark, texts):
    ids = random.Random(1).sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_groups(clashing(df)).collect()}
    assert got == brute(rows)


def test_shuffle_joins_give_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST_ROWS", -1)
    got = {r.doc_id: r.class_id for r in near_groups(documents(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_repeats_null_ids_and_dropping(spark):
    a, b = prose(1, 60), prose(2, 60)
    texts, ids = [a, a, edited(a, 3, 1), b, None, None, a, ""], [5, 5, 3, 7, 8, None, None, 9]
    df = documents(spark, texts, ids=ids)
    got = sorted(((r.doc_id, r.class_id) for r in near_groups(df).collect()), key=repr)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (7, 7), (8, 8), (None, None), (None, None), (9, 9)], key=repr)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 7, 8, 9, None, None], key=repr)
    assert [r.doc_id for r in drop_near_copies(documents(spark, [a, a], ids=[4, 4])).collect()] == [4]
    # one id, two texts: each stays or goes by its own group
    two = drop_near_copies(documents(spark, [a, b, b.upper(), edited(a, 3, 1), "", None], ids=[4, 4, 4, 2, 4, 4])).collect()
    assert sorted((r.doc_id, bag(r.text) == bag(b), bag(r.text) == bag("")) for r in two) == [(2, False, False), (4, False, True), (4, True, False)]


def test_many_copies_of_one_base(spark):
    base = prose(41, 150, 9000)
    texts = [base] + [edited(base, 900 + i, 1 + i % 12) for i in range(2000)] + [prose(2000 + i, 60, 9000) for i in range(200)]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    got = {r.doc_id: r.class_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()}
    bags = [bag(t) for t in texts]
    linked = [i for i in range(2001) if overlap(bags[0], bags[i]) >= 0.8 - 1e-9]
    # whatever is near the base is in its group; every fortieth text left apart is near none of those
    assert len(linked) > 300 and all(got[i] == 0 for i in linked)
    apart = [i for i in range(2001) if got[i] != 0]
    assert all(overlap(bags[i], bags[j]) < 0.8 for i in apart[::40] for j in linked)
    assert all(got[i] == i for i in range(2001, 2201))


def test_long_texts(spark):
    long = prose(7, 700_000, 20_000)
    texts = [long, edited(long, 1, 200), prose(8, 60), long[: len(long) // 2]]
    got = {r.doc_id: r.class_id for r in near_groups(documents(spark, texts)).collect()}
    assert len(long) > 3_000_000 and got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_empty_table(spark):
    none = documents(spark, ["x"]).limit(0)
    assert near_groups(none).count() == 0 and drop_near_copies(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r.node: r.group for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(3)
    shingle = r.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = r.integers(1, 40, 60), r.integers(1, 40, 60)
    b[:20] = a[:20]
    h = bag_minhash(np.repeat([0, 1], 60), np.concatenate([shingle, shingle]), np.concatenate([a, b]), 2, 6000)
    assert abs((h[0] == h[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


def test_shingles_count_words_like_a_plain_loop(texts):
    of, _, count = shingles([(t or "").encode() for t in texts])
    for i, t in enumerate(texts):
        assert sorted(count[of == i]) == sorted(bag(t).values())
