"""What a task turns into Python objects at once does not grow with its batch of Arrow, which can be a whole partition."""

import tracemalloc

import pyarrow as pa
import pytest

from contextmill.llm import common, near_dedup, suffix_dedup, toxicity

from .helpers import documents, prose


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_slices_keep_rows_and_order():
    texts = [None, "", "a" * 9, "é" * 5, "b" * 40, None, "c", "d" * 10, "", None]
    batch = batch_of(texts).slice(1)
    parts = list(common.slices(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), 1, 10))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts[1:] + texts[3:6]
    assert [p.column(1).to_pylist() for p in parts][:4] == [["", "a" * 9], ["é" * 5], ["b" * 40], [None, "c"]]
    assert list(common.slices(iter([]), 1)) == []
    nothing = pa.RecordBatch.from_arrays([pa.nulls(3)], names=["text"])
    assert [p.num_rows for p in common.slices(iter([nothing]), 0)] == [3]


def scanner(spark, monkeypatch, build):
    """The function that an operator gives to mapInArrow."""
    docs, caught = documents(spark, ["x"]).select("doc_id", "text"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f) or self)
    build(docs)
    return caught[0]


OPERATORS = {
    "op2": lambda docs: suffix_dedup.anchors_of(docs, "bigint"),
    "op5": lambda docs: toxicity.score_toxicity(docs, toxicity.ToxicityModel({}, toxicity.np.zeros(toxicity.N_FEATURES + 1))),
    "op7": lambda docs: near_dedup.signatures(docs, "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_memory_of_a_scan_does_not_grow_with_its_batch(spark, monkeypatch, name):
    scan, most, largest = scanner(spark, monkeypatch, OPERATORS[name]), [], []
    texts = [prose(i, 1200) for i in range(200)]
    for times in (12, 36):
        batch = batch_of(texts * times)
        if name == "op2":
            batch = pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * batch.num_rows, pa.int64()), batch.column(1)], names=["doc_id", "tag", "text"])
        tracemalloc.start()
        largest.append(max(out.num_rows for out in scan(iter([batch]))))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 1.2 * most[0]
    assert largest[1] < 1.2 * largest[0]
