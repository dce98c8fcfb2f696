"""Queries over every link of a page and every word of a request."""

import pytest

import __spark_entry__ as entry
from contextmill.operators import graph
from contextmill.plans.catalogue import analysis
from tests.oracle import compare, connect

NAMES = ["impact_contains", "impact_summary", "impact_basename", "project_map_depth1",
         "project_map_depth2", "project_map_depth3", "notes_search"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql_on_more_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) is None


def test_every_link_and_word_counts(spark):
    html = '<a href="/first">x</a><a href="/second">y</a>'
    pages = spark.createDataFrame([(1, "https://h.org/d/p", html), (2, "https://h.org/q", "<p>none</p>")], "page_id long, url string, html string")
    items = spark.createDataFrame([(7, "Nothing but Second"), (8, "")], "item_id long, text string")
    syms, asked = analysis.page_symbols(pages), analysis.asked_symbols(items)
    assert {tuple(r) for r in syms.select("file", "name").collect()} == {("/web/h.org/d/p", "first"), ("/web/h.org/d/p", "second"), ("/web/h.org/q", "")}
    assert {tuple(r) for r in asked.collect()} == {(7, "nothing"), (7, "but"), (7, "second")}
    edges = spark.createDataFrame([("/web/a", "/second", "import"), ("/web/b", "/d/p", "import")], "source_file string, target string, kind string")
    # the last word names the last link of page 1, so files that import that page are reached as well
    got = {tuple(r) for r in graph.impact(edges, syms, asked).select("query_id", "source_file").collect()}
    assert got == {(7, "/web/a"), (7, "/web/b")}
