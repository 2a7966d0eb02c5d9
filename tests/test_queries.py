"""A sample of the registered queries against their SQL; ``python -m suite.check`` runs all."""

import pytest

import __spark_entry__ as registry
from suite.check import compare, connect
from suite.queries import ORACLES, QUERIES

SAMPLE = [
    "w3_devig", "w4_blend_markets", "w9_log_pool", "d3_rank_field", "j3_zip_assign", "j4_sequence_gaps", "j7_finish_order_probs",
    "a6_early_score", "w14_predict", "t30_explain_text", "t1_clean_text", "t13_first_non_empty", "t24_extract_metrics", "s4_stream_captures",
    "pages_to_predictions", "pages_to_predictions_repeated", "j7_finish_large_groups",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name]) == ""


def test_entry_runs(spark):
    assert registry.entry(spark).count() > 0


def test_pages_are_read_as_dealt_and_parsed_once(spark, sf_dir):
    """No query deals the rendered pages again, and the warnings' branches share one stored extraction."""
    from suite import page_queries

    plan = lambda df: df._jdf.queryExecution().toString()
    assert "Exchange" not in plan(page_queries.pages(spark, sf_dir))
    assert "regexp_extract" not in plan(registry.queries()["pages_to_warnings"](spark, sf_dir))
