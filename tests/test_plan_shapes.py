"""Physical plans: no pairwise joins, filters and columns pushed to the scan, top-k cut early."""

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_what_they_need(spark, sf_dir):
    plan = plan_of(QUERIES["retention"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
    assert "EqualTo(event_type,purchase)" in plan_of(QUERIES["memory_asof_join"](spark, sf_dir))


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    for name in ("bm25_batch_topk", "vector_topk_batch", "notes_list", "script_group_by_file"):
        assert plan_of(QUERIES[name](spark, sf_dir)).count("WindowGroupLimit") >= 2
