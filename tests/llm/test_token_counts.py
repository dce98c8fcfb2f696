from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from contextmill.llm.token_counts import VOCABULARY, Counter, TokenTree, clean_edits, count_tokens, redactions

from .helpers import AWKWARD, clashing, documents, prose

COUNTER = Counter(open(VOCABULARY, "rb").read())
TEXT = st.text(alphabet="ab'st \n\t 12é.,!", max_size=400)


def apply(text, edits):
    for start, end, new in reversed(edits):
        text = text[:start] + new + text[end:]
    return text


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60), st.text(alphabet="ab' \n1é", max_size=8)), max_size=6))
def test_edits_equal_counting_anew(text, raw):
    edits = clean_edits([(s, s + n, new) for s, n, new in raw], len(text))
    tree = TokenTree(text, COUNTER)
    if edits:
        tree.edit(edits)
    whole = TokenTree(apply(text, edits), COUNTER)
    assert (tree.text, tree.total, tree.pre_tokens) == (whole.text, whole.total, whole.pre_tokens)
    assert sum((a for a, _ in tree.leaves), []) == sum((a for a, _ in whole.leaves), [])
    assert tree.chars[1] == len(tree.text)


def test_only_the_touched_region_is_encoded_again():
    text = prose(1, 20_000)
    tree = TokenTree(text, COUNTER)
    tree.edit([(5000, 5003, "xyz"), (60_000, 60_000, " more words")])
    assert 0 < tree.encoded < 40


def test_table(spark):
    texts = [*AWKWARD, "mail me at a.b@c.example.org or 10.0.0.1, card 4111111111111111.", "key 0123456789abcdef0123456789abcdef!"] + [prose(i, 50) for i in range(5)]
    texts += texts[-2:]
    got = sorted(tuple(r) for r in count_tokens(clashing(documents(spark, texts)), redactions).collect())
    for doc, n, pre, edits, after, pre_after, again in got:
        text = texts[doc] or ""
        todo = redactions(text)
        a, b = TokenTree(text, COUNTER), TokenTree(apply(text, todo), COUNTER)
        assert (n, pre, edits, after, pre_after) == (a.total, a.pre_tokens, len(todo), b.total, b.pre_tokens)
        assert (again > 0) == (edits > 0)
    assert len(got) == len(texts) and sum(r[3] for r in got) == 4
    assert count_tokens(documents(spark, ["x"]).limit(0), redactions).count() == 0


def test_edits_as_a_column(spark):
    df = documents(spark, ["hello big world", "same", None]).withColumn(
        "edits", F.expr("CASE doc_id WHEN 0 THEN array(struct(6 AS start, 10 AS end, 'small ' AS replacement), null) END"))
    got = {r.doc_id: r for r in count_tokens(df, "edits").collect()}
    assert got[0].n_tokens_edited == TokenTree("hello small world", COUNTER).total and got[0].n_edits == 1
    assert got[1].n_edits == 0 and got[2].n_tokens == 0
