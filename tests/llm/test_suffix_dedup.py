import hashlib
import random

import numpy as np
import pytest

from contextmill.llm import suffix_dedup
from contextmill.llm.suffix_dedup import Block, dedup_substrings, remove_repeats

from .helpers import AWKWARD, clashing, documents, prose


def brute(docs, size=100):
    """docs: (order key, text) of distinct documents."""
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - size + 1):
            k = data[s:s + size]
            if k in seen:
                gone[s:s + size] = b"\1" * size
            seen.add(k)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[key] = (len(data), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = [prose(i, r.choice([3, 40, 300])) for i in range(40)]
    for _ in range(60):
        a, b = r.randrange(len(out)), r.randrange(len(out))
        n = r.choice([60, 99, 100, 101, 130, 170, 400])
        s = r.randrange(max(1, len(out[a]) - n))
        t = r.randrange(len(out[b]) + 1)
        out[b] = out[b][:t] + out[a][s:s + n] + out[b][t:]
    passage = prose(999, 30)
    out += [prose(500 + i, 20) + passage + prose(700 + i, 20) for i in range(30)]
    return out + [out[3], out[3], "ab" * 700, "ab" * 60, "x" * 99, "x" * 100, "x" * 101, out[7].upper(), *AWKWARD]


@pytest.mark.parametrize("block, held", [(1 << 17, 200_000), (300, 3)])
def test_against_brute_force(spark, texts, monkeypatch, block, held):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "MAX_HELD", held)
    got = dedup_substrings(clashing(documents(spark, texts)))
    assert result(got) == sorted(brute(list(enumerate(texts))).items(), key=repr)


def test_shuffled_keys_give_the_same(spark, texts):
    got = dedup_substrings(documents(spark, texts), max_broadcast_keys=0)
    assert result(got) == sorted(brute(list(enumerate(texts))).items(), key=repr)


def test_repeated_rows_null_ids_and_ids_with_two_texts(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = documents(spark, [a, a, a + b, b], ids=[5, 5, 5, None])
    got = result(dedup_substrings(rows))
    want = brute([(0, b)])[0]
    assert got.count((None, want)) == 1
    # the null id comes first; of the two texts of id 5 one comes first, and the repeated row is one document
    tags = {r.n_bytes: r.tag for r in dedup_substrings(rows).select("n_bytes", "tag").collect()}
    order = sorted([a, a + b], key=lambda t: tags[len(t.encode())])
    ref = brute([(0, b), *enumerate(order, 1)])
    assert sorted(x[1] for x in got if x[0] == 5) == sorted([ref[1 + order.index(a)]] * 2 + [ref[1 + order.index(a + b)]])


def test_remove_repeats_keeps_columns(spark):
    a = "é" + prose(1, 60)
    df = documents(spark, [a, "€€" + a, None]).withColumn("rest", suffix_dedup.F.lit(1))
    rows = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert remove_repeats(df).columns == df.columns
    assert rows[0].text == a and rows[1].text == "€€" and rows[2].text == "" and rows[1].source == "src1" and rows[1]["rest"] == 1


def test_empty_table(spark):
    assert dedup_substrings(documents(spark, ["x"]).limit(0)).count() == 0


def test_every_string_has_an_anchor_that_depends_on_its_bytes_alone():
    r = random.Random(9)
    text = bytes(r.choice(b"ab c") for _ in range(3000))
    for cut in (0, 137, 1001):
        whole, part = Block([text]), Block([text[cut:cut + 400]])
        own = set(whole.anchors[(whole.anchors >= cut) & (whole.anchors <= cut + 400 - suffix_dedup.GRAM)] - cut)
        assert set(part.anchors) <= own
        gaps = np.diff(part.anchors)
        assert gaps.max() <= suffix_dedup.REACH + 1
