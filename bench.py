"""Headline queries on one machine: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from metricloom.session import local_session
from registry import all_queries

HEADLINE = (
    "metric_pack",
    "plan_mixed_grains_by_month_and_state",
    "metric_historical_returning_customer_rate",
    "report_gmv_by_month",
    "report_gmv_by_state_top5",
    "report_gmv_by_seller_top10",
    "report_category_dense_rank_top3",
    "report_on_time_rate_by_state_min100",
    "report_repeat_rate_by_state",
    "report_monthly_reconciliation",
    "fanout_report_total",
    "load_first_row_per_key",
    "window_month_over_month_dataset_ends",
    "window_year_over_year_dataset_ends",
    "window_category_top3_per_month",
    "window_running_totals",
    "series_compare_year_over_year",
    "series_anomaly_median_mad",
    "series_contribution_sum_check",
    "quality_profile",
    "quality_key_audit_composite",
    "quality_foreign_key_audit",
    "quality_event_order",
    "retrieval_stored_index",
    "retrieval_search_top5",
    "retrieval_search_with_dependencies_top3",
    "text_secret_scan",
    "text_exact_duplicates",
    "text_dice_pairs_plain",
    "text_similarity_clusters_plain",
    "evaluate_result_diff_multiset",
    "evaluate_result_diff_two_tolerances",
    "evaluate_changed_rows",
    "evaluate_score_cases",
    "evaluate_paired_bootstrap",
    "evaluate_slice_summary",
    "evaluate_operational_summary",
    "evaluate_usage_ledger",
    "evaluate_first_seen",
    "stream_usage_per_day",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("metricloom-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = [n for n in HEADLINE if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    for warm in ("report_gmv_by_month", "quality_key_audit_composite"):
        queries[warm](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
