"""The corpus pipeline on small tables: each stage's decisions, columns and the whole run against a plain version."""

import random

import pytest

import corpus_pipeline as pipeline
from contextmill.llm import mixing

from .helpers import AWKWARD, clashing, documents, prose
from .test_decontaminate import brute as windows
from .test_mixing import brute as mixed
from .test_near_dedup import brute as grouped, edited


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder with insults, near copies, shared passages and benchmark passages."""
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [prose(i, 90, 4000) for i in range(120)]
    toxic = [prose(300 + i, 30, 4000) + f" you vile snarg{'abc'[i % 3]} . " + prose(400 + i, 20, 4000) for i in range(60)]
    copies = [edited(texts[i], i, 1) for i in range(20)] + texts[20:30]
    passage = prose(900, 40, 4000)
    shared = [prose(500 + i, 60, 4000) + passage + prose(600 + i, 60, 4000) for i in range(8)]
    leaks = [prose(700 + i, 40, 4000) + " " + prose(800 + i % 3, 20, 4000) + " " + prose(750 + i, 40, 4000) for i in range(6)]
    rows = texts + toxic + copies + shared + leaks
    documents(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(120 <= i < 180)) for i in range(0, 180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, prose(800 + i, 20, 4000)) for i in range(3)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_against_a_plain_version(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    left = {i: r.text for i, r in docs.items() if not 120 <= i < 180}
    classes = grouped(list(left.items()))
    left = {i: t for i, t in left.items() if classes[i] == i}
    seen, cut = set(), {}
    for i in sorted(left):
        data = left[i].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(data[s:s + 100])
        cut[i] = bytes(x for x, g in zip(data, gone, strict=True) if not g).decode()
    assert any(cut[i] != left[i] for i in cut)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {i for i, _, n_hit, _ in windows(list(cut.items()), items) if n_hit == 0}
    assert 0 < len(cut) - len(clean) <= 6
    want = mixed([(i, cut[i], docs[i].lang, docs[i].source, 0) for i in clean])
    got = pipeline.run(spark, folder)
    assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=repr) == want
    assert {(r.doc_id, r.text) for r in got.collect()} <= {(i, cut[i]) for i in clean}


def test_stages_take_awkward_rows(spark, folder):
    r = random.Random(1)
    rows = documents(spark, [*AWKWARD, *AWKWARD, prose(1, 50), prose(1, 50)], ids=[None if i % 9 == 4 else r.randrange(30) for i in range(2 * len(AWKWARD) + 2)])
    for docs in (clashing(rows), rows.limit(0)):
        for name, stage in pipeline.STAGES:
            columns = docs.columns
            docs = pipeline.written(stage(spark, docs, folder), f"test-{name}")
            assert name == "mix" or docs.columns == columns
            assert docs.count() >= 0


def test_stage_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontaminate", "mix"]
    assert mixing.SHARE == (1, 2) and pipeline.ORACLE_SQL is None
