"""Registered queries against their check SQL on the smallest tables, and the plans they get."""

import re

import pytest

from registry import all_oracles, all_queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "plan_mixed_grains_by_month_and_state",
    "report_category_dense_rank_top3",
    "report_monthly_reconciliation",
    "scope_row_cap_with_flag",
    "fanout_report_by_customer",
    "load_first_row_per_key",
    "window_month_over_month_series_ends",
    "window_running_totals",
    "series_compare_year_over_year",
    "series_anomaly_median_mad",
    "quality_profile",
    "quality_event_order",
    "retrieval_search_top5",
    "text_secret_scan",
    "evaluate_diagnose_failures",
    "evaluate_paired_bootstrap",
    "evaluate_usage_ledger",
    "stream_usage_per_day",
    "null_key_sequence_audit",
    "null_key_first_seen",
    "load_publish_tables",
    "evaluate_representatives_of_versions",
)


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    ok, why, _, _ = compare(spark, duck, all_queries()[name], all_oracles()[name], FOLDER)
    assert ok, why


def test_every_check_belongs_to_a_query():
    assert set(all_oracles()) <= set(all_queries())


def plan(spark, name):
    return all_queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["evaluate_operational_summary", "evaluate_result_diff_ordered", "series_contribution_evidence", "metric_delivered_category_gmv_contribution", "window_year_over_year_dataset_ends"],
)
def test_no_nested_loops(spark, name):
    shown = plan(spark, name)
    assert "NestedLoop" not in shown and "Cartesian" not in shown


@pytest.mark.parametrize("name", ["window_category_top3_per_month", "quality_event_order", "retrieval_search_top5"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_status_and_period_reach_the_scan(spark):
    frame = all_queries()["report_gmv_by_month"](spark, FOLDER)
    shown = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "EqualTo(o_orderstatus,F)" in shown and "LessThan(o_orderdate" in shown
    assert "struct<l_orderkey:bigint,l_extendedprice:double>" in shown


def test_search_scores_are_whole_before_they_move(spark):
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan(spark, "retrieval_search_top5"))


def test_a_pack_reads_the_items_once(spark):
    """Times and totals of orders come from one aggregate of their lines."""
    shown = plan(spark, "metric_pack")
    assert len(re.findall(r"Scan parquet [^\n]*l_orderkey", shown)) == 1
    assert len(re.findall(r"Scan parquet [^\n]*l_orderkey", plan(spark, "plan_mixed_grains_by_month_and_state"))) == 1
