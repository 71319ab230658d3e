"""Plan-shape guards for the scale properties (checked on the physical plan, nothing executed)."""

import __spark_entry__ as E
from conftest import SMALL


def _plan(spark, name):
    return E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_range_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in _plan(spark, "summary_7d")


def test_per_group_top_k_is_partial_before_the_shuffle(spark):
    for name in ("context_last_20", "span_assembly"):
        plan = _plan(spark, name)
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_json_parsed_once_per_row(spark):
    plan = _plan(spark, "ingest_events")
    assert plan.count("from_json") == 1 and "Generate" in plan


def test_redaction_is_map_only_and_linear(spark):
    plan = _plan(spark, "pii_redact_docs")
    assert "Exchange" not in plan
    assert plan.count("regexp_replace") <= 14


def test_no_global_sort_of_threads(spark):
    assert "rangepartitioning" not in _plan(spark, "conversation_thread")


def test_price_lookup_needs_no_join(spark):
    plan = _plan(spark, "cost_by_model")
    assert "Join" not in plan and "BroadcastExchange" not in plan
