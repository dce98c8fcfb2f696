"""Text and vector search for a batch of requests: no word is shuffled, and of the vectors only what the requests need."""

import __spark_entry__ as entry
from contextmill.plans.catalogue import views


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hybrid_of_documents_shuffles_no_words(spark, sf_dir):
    plan = plan_of(entry.queries()["doc_hybrid"](spark, sf_dir))
    assert "Generate" not in plan and plan.count("WindowGroupLimit") >= 4


def test_vectors_of_no_request_stay_in_their_scan(spark, sf_dir):
    found = views.requests(spark, sf_dir)
    assert "LeftSemi" in plan_of(found)
    assert found.count() == views.texts(spark, sf_dir).count() and found.where("vector IS NOT NULL").count() > 0
