"""Registered queries: all named, row counts, contract columns."""

import pytest

import __spark_entry__ as entry

CONTRACT = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"], "op2_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_url_filter": ["page_id", "host", "path", "rule", "verdict"], "op10_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op11_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op12_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_centroid_clusters": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert df.columns[:len(CONTRACT[name])] == CONTRACT[name]
    if name in ("op1_quality", "op2_suffix_dedup", "op5_toxicity", "op8_decontaminate", "op11_secret_scan"):
        assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
