"""Windows over grouped output, running totals, and deterministic analysis of monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators.series import (
    anomaly_evidence,
    anomaly_mad,
    comparison_evidence,
    contribution,
    contribution_evidence,
    fill_calendar,
    monthly_observations,
    own_ends_incomplete,
    period_compare,
    scope_match,
    spanned_calendar,
)
from metricloom.operators.windows import running_totals
from metricloom.plans.catalog import CUSTOMER_STATE, PRODUCT_CATEGORY, PURCHASE_MONTH
from metricloom.plans.reports import category_share_report, category_top_n_report, mom_report, yoy_report
from metricloom.plans.series_metrics import monthly_gmv
from registry.common import amount, bound_star, ratio, star, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_GMV = """monthly AS (SELECT purchase_month, sum(price) AS gmv FROM sales JOIN line USING (oid)
  WHERE st = 'delivered' GROUP BY 1)"""
_ALL_ENDS = "(SELECT CAST(date_trunc('month', min(ts)) AS DATE) AS lo, CAST(date_trunc('month', max(ts)) AS DATE) AS hi FROM sales)"
_OWN_ENDS = "(SELECT min(purchase_month) AS lo, max(purchase_month) AS hi FROM monthly)"

for _boundary, _ends in (("dataset", _ALL_ENDS), ("series", _OWN_ENDS)):
    QUERIES[f"window_month_over_month_{_boundary}_ends"] = (
        lambda spark, folder, b=_boundary: mom_report(bound_star(spark, folder), b)
    )
    ORACLES[f"window_month_over_month_{_boundary}_ends"] = f"""WITH {star()}, {_GMV},
    f AS (SELECT m.*, CAST(purchase_month IN (lo, hi) AS INTEGER) AS edge FROM monthly m, {_ends} e),
    w AS (SELECT *, lag(purchase_month) OVER t AS pm, lag(gmv) OVER t AS pv, lag(edge) OVER t AS pe FROM f WINDOW t AS (ORDER BY purchase_month))
    SELECT purchase_month, {amount('gmv')} AS monthly_gmv, pm AS previous_month, {amount('pv')} AS previous_month_gmv,
      edge AS is_boundary_month, pe AS is_previous_month_boundary,
      CASE WHEN pm = purchase_month - INTERVAL 1 MONTH THEN round({ratio('gmv', 'pv', 15)} - 1, 6) END AS mom_rate,
      CAST(coalesce(pm = purchase_month - INTERVAL 1 MONTH AND edge = 0 AND pe = 0, false) AS INTEGER) AS is_comparable FROM w"""
    QUERIES[f"window_year_over_year_{_boundary}_ends"] = (
        lambda spark, folder, b=_boundary: yoy_report(bound_star(spark, folder), b)
    )
    ORACLES[f"window_year_over_year_{_boundary}_ends"] = f"""WITH {star()}, {_GMV},
    f AS (SELECT m.*, CAST(purchase_month IN (lo, hi) AS INTEGER) AS edge FROM monthly m, {_ends} e)
    SELECT a.purchase_month, {amount('a.gmv')} AS monthly_gmv, b.purchase_month AS previous_year_month,
      {amount('b.gmv')} AS previous_year_month_gmv, a.edge AS is_boundary_month, b.edge AS is_previous_year_month_boundary,
      round({ratio('a.gmv', 'b.gmv', 15)} - 1, 6) AS yoy_rate,
      CAST(coalesce(a.edge = 0 AND b.edge = 0, false) AS INTEGER) AS is_comparable
    FROM f a LEFT JOIN f b ON b.purchase_month = a.purchase_month - INTERVAL 1 YEAR"""

_CUBE = """cube AS (SELECT purchase_month, product_category, sum(price) AS gmv
  FROM sales JOIN line USING (oid) LEFT JOIN prod USING (pid) WHERE st = 'delivered' GROUP BY 1, 2)"""
QUERIES["window_category_top3_per_month"] = lambda spark, folder: category_top_n_report(bound_star(spark, folder), 3)
ORACLES["window_category_top3_per_month"] = f"""WITH {star()}, {_CUBE}
SELECT purchase_month, product_category, {amount('gmv')} AS category_gmv, rk AS category_rank
FROM (SELECT *, dense_rank() OVER (PARTITION BY purchase_month ORDER BY gmv DESC) AS rk FROM cube) WHERE rk <= 3"""
QUERIES["window_category_share_of_month"] = lambda spark, folder: category_share_report(bound_star(spark, folder))
ORACLES["window_category_share_of_month"] = f"""WITH {star()}, {_CUBE}
SELECT purchase_month, product_category, {amount('gmv')} AS category_gmv,
{ratio('gmv', 'sum(gmv) OVER (PARTITION BY purchase_month)')} AS category_gmv_contribution FROM cube"""


def _running(spark, folder):
    events = tables(spark, folder)("events")
    value = F.col("value").cast("decimal(18,2)")
    rows = events.select("event_type", "event_id", value.alias("v"))
    out = running_totals(
        rows,
        ("event_type",),
        "event_id",
        F.floor(F.col("event_id") / 4096),
        {"running_rows": F.lit(1), "running_value": F.col("v")},
    )
    return out.select(
        "event_type",
        "event_id",
        F.col("running_rows").cast("bigint").alias("running_rows"),
        F.col("running_value").cast("double").alias("running_value"),
    )


QUERIES["window_running_totals"] = _running
ORACLES["window_running_totals"] = """SELECT event_type, event_id, count(*) OVER w AS running_rows,
CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS running_value FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""

# ---------------------------------------------------------------- series analysis, one series per state


def _state_series(spark, folder):
    cube = monthly_gmv(bound_star(spark, folder), None, (CUSTOMER_STATE,))
    return cube.select(CUSTOMER_STATE, F.col(PURCHASE_MONTH).alias("period"), F.col("gmv").alias("value"))


def _observed(spark, folder):
    return own_ends_incomplete(_state_series(spark, folder), (CUSTOMER_STATE,))


_SERIES = """series AS (SELECT customer_state, purchase_month AS period, sum(price) AS amount
  FROM sales JOIN line USING (oid) JOIN cust USING (cid) WHERE st = 'delivered' GROUP BY 1, 2),
obs AS (SELECT customer_state, period, CAST(amount AS DOUBLE) AS value,
  period <> min(period) OVER s AND period <> max(period) OVER s AS ok FROM series WINDOW s AS (PARTITION BY customer_state)),
cal AS (SELECT customer_state, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period
  FROM series GROUP BY 1)"""


def _scaffold(spark, folder):
    series = _state_series(spark, folder)
    calendar = spanned_calendar(series, (CUSTOMER_STATE,))
    return fill_calendar(series, calendar, (CUSTOMER_STATE,), "value", True).select(
        CUSTOMER_STATE, "period", F.col("value").cast("double").alias("value")
    )


QUERIES["series_month_scaffold"] = _scaffold
ORACLES["series_month_scaffold"] = f"""WITH {star()}, {_SERIES}
SELECT customer_state, period, CAST(coalesce(amount, 0) AS DOUBLE) AS value FROM cal LEFT JOIN series USING (customer_state, period)"""


def _observations(spark, folder):
    series = _state_series(spark, folder)
    text = series.select(
        CUSTOMER_STATE,
        F.when(F.month("period") == 7, F.date_format("period", "yyyy/MM/dd"))
        .when(F.month("period") == 9, F.date_add("period", 1).cast("string"))
        .otherwise(F.col("period").cast("string"))
        .alias("period"),
        F.when(F.month("period") != 11, F.col("value").cast("double")).alias("value"),
    )
    partial = series.filter((F.month("period") == 3) | (F.month("period") == 5)).select(
        CUSTOMER_STATE, "period", F.when(F.month("period") == 3, "late feed").otherwise(" ").alias("reason")
    )
    good, bad = monthly_observations(text, "period", "value", (CUSTOMER_STATE,), partial)
    return good.select(
        CUSTOMER_STATE, F.col("period").cast("string").alias("period"), "value", F.col("completeness").alias("outcome")
    ).unionByName(bad.select(CUSTOMER_STATE, F.col("raw_period").alias("period"), "value", F.col("error_code").alias("outcome")))


QUERIES["series_observations_and_rejects"] = _observations
ORACLES["series_observations_and_rejects"] = f"""WITH {star()}, {_SERIES}
SELECT customer_state, CASE month(period) WHEN 7 THEN strftime(period, '%Y/%m/%d') WHEN 9 THEN strftime(period + INTERVAL 1 DAY, '%Y-%m-%d')
    ELSE CAST(period AS VARCHAR) END AS period,
  CASE WHEN month(period) <> 11 THEN value END AS value,
  CASE month(period) WHEN 7 THEN 'invalid_period' WHEN 11 THEN 'invalid_value' WHEN 9 THEN 'invalid_observation'
    WHEN 5 THEN 'invalid_observation' WHEN 3 THEN 'incomplete' ELSE 'complete' END AS outcome FROM obs"""

_KINDS = {"month_over_month": ("1 MONTH", 1), "year_over_year": ("1 YEAR", 12)}


def _compared(kind):
    def run(spark, folder):
        out = period_compare(_observed(spark, folder), kind, (CUSTOMER_STATE,))
        return out.drop("boundary_notes", "analysis_type").withColumns(
            {
                "relative_change": F.round("relative_change", 9),
                "absolute_change": F.round("absolute_change", 4),
            }
        )

    return run


def _compared_sql(kind):
    step = _KINDS[kind][0]
    return f"""WITH {star()}, {_SERIES},
j AS (SELECT t.customer_state, t.period, CAST(t.period - INTERVAL {step} AS DATE) AS other, c.value AS cv, c.ok AS cok, b.value AS bv, b.ok AS bok
  FROM cal t LEFT JOIN obs c ON c.customer_state = t.customer_state AND c.period = t.period
  LEFT JOIN obs b ON b.customer_state = t.customer_state AND b.period = t.period - INTERVAL {step})
SELECT customer_state, period AS target_period, other AS comparison_period, cv AS current_value, bv AS comparison_value,
  round(cv - bv, 4) AS absolute_change, CASE WHEN bv > 0 THEN round((cv - bv) / bv, 9) END AS relative_change,
  CASE WHEN cv IS NULL THEN 'missing_current_period' WHEN bv IS NULL THEN 'missing_comparison_period' WHEN bv = 0 THEN 'zero_baseline'
    WHEN bv < 0 THEN 'negative_baseline' ELSE 'computed' END AS calculation_status,
  CASE WHEN cv IS NULL OR bv IS NULL THEN 'not_applicable' WHEN cok AND bok THEN 'comparable' ELSE 'not_comparable' END AS comparability,
  concat_ws(',', CASE WHEN cv IS NULL THEN 'current_period_missing' END,
    CASE WHEN cv IS NOT NULL AND bv IS NULL THEN 'comparison_period_missing' END,
    CASE WHEN bv IS NOT NULL AND NOT cok THEN 'current_period_incomplete' END,
    CASE WHEN cv IS NOT NULL AND NOT bok THEN 'comparison_period_incomplete' END) AS comparability_reasons,
  'none' AS sign_transition, CASE WHEN cok THEN 'complete' WHEN NOT cok THEN 'incomplete' END AS current_completeness,
  CASE WHEN bok THEN 'complete' WHEN NOT bok THEN 'incomplete' END AS comparison_completeness FROM j"""


for _kind in _KINDS:
    QUERIES[f"series_compare_{_kind}"] = _compared(_kind)
    ORACLES[f"series_compare_{_kind}"] = _compared_sql(_kind)


def _evidence(spark, folder):
    return comparison_evidence(period_compare(_observed(spark, folder), "month_over_month", (CUSTOMER_STATE,)), (CUSTOMER_STATE,))


QUERIES["series_comparison_evidence"] = _evidence
ORACLES["series_comparison_evidence"] = f"""WITH {star()}, {_SERIES}
SELECT t.customer_state, t.period AS target_period, p AS position, CASE p WHEN 1 THEN 'comparison' ELSE 'current' END AS role,
  o.period, o.value, CASE WHEN o.ok THEN 'complete' ELSE 'incomplete' END AS completeness
FROM cal t, (VALUES (1), (2)) v(p) JOIN obs o ON o.customer_state = t.customer_state
  AND o.period = CASE p WHEN 1 THEN t.period - INTERVAL 1 MONTH ELSE t.period END"""


def _anomalies(spark, folder):
    out = anomaly_mad(_observed(spark, folder), (CUSTOMER_STATE,), window=6, minimum_history=5, threshold=2.5)
    return out.drop("baseline").withColumns(
        {
            "robust_z_score": F.round("robust_z_score", 6),
            "baseline_median": F.round("baseline_median", 4),
            "baseline_mad": F.round("baseline_mad", 4),
            "is_anomaly": F.col("is_anomaly").cast("int"),
        }
    )


_ANOMALY = f"""WITH {star()}, {_SERIES},
h AS (SELECT t.customer_state, t.period, k, o.value, coalesce(o.ok, false) AS ok, o.period IS NOT NULL AS seen
  FROM cal t, range(1, 7) r(k) LEFT JOIN obs o ON o.customer_state = t.customer_state AND o.period = t.period - to_months(CAST(k AS INTEGER))),
run AS (SELECT customer_state, period, coalesce(min(k) FILTER (NOT ok) - 1, 6) AS n,
  arg_min(seen, k) FILTER (NOT ok) AS broke_on_seen FROM h GROUP BY 1, 2),
med AS (SELECT r.customer_state, r.period, r.n, r.broke_on_seen, median(h.value) AS med FROM run r
  LEFT JOIN h ON h.customer_state = r.customer_state AND h.period = r.period AND k <= n GROUP BY 1, 2, 3, 4),
mad AS (SELECT m.customer_state, m.period, m.n, m.broke_on_seen, m.med, median(abs(h.value - med)) AS mad FROM med m
  LEFT JOIN h ON h.customer_state = m.customer_state AND h.period = m.period AND k <= n GROUP BY 1, 2, 3, 4, 5),
z AS (SELECT m.*, o.value, o.ok, o.ok AND n >= 5 AS ready, CASE WHEN o.ok AND n >= 5 AND mad <> 0 THEN 0.6745 * (o.value - med) / mad END AS z
  FROM mad m LEFT JOIN obs o USING (customer_state, period))"""
QUERIES["series_anomaly_median_mad"] = _anomalies
ORACLES["series_anomaly_median_mad"] = f"""{_ANOMALY}
SELECT customer_state, period AS target_period, value AS current_value,
  CASE WHEN value IS NULL THEN 'missing_current_period' WHEN NOT ok THEN 'incomplete_current_period'
    WHEN n < 5 THEN CASE WHEN broke_on_seen THEN 'incomplete_history' ELSE 'non_contiguous_history' END
    WHEN mad = 0 THEN 'zero_dispersion' WHEN abs(z) >= 2.5 THEN 'detected' ELSE 'not_detected' END AS calculation_status,
  CAST(abs(z) >= 2.5 AS INTEGER) AS is_anomaly,
  CASE WHEN z IS NULL THEN NULL WHEN value > med THEN 'above_baseline' WHEN value < med THEN 'below_baseline' ELSE 'at_baseline' END AS direction,
  round(z, 6) AS robust_z_score, CASE WHEN ready THEN round(med, 4) END AS baseline_median, CASE WHEN ready THEN round(mad, 4) END AS baseline_mad,
  CASE WHEN ok THEN n ELSE 0 END AS history_months FROM z"""


def _anomaly_rows(spark, folder):
    scored = anomaly_mad(_observed(spark, folder), (CUSTOMER_STATE,), window=5, minimum_history=5)
    return anomaly_evidence(scored, (CUSTOMER_STATE,)).withColumn("baseline_median", F.round("baseline_median", 4))


QUERIES["series_anomaly_evidence"] = _anomaly_rows
ORACLES["series_anomaly_evidence"] = f"""{_ANOMALY.replace('range(1, 7)', 'range(1, 6)').replace('- 1, 6)', '- 1, 5)')}
SELECT z.customer_state, z.period AS target_period, CAST(h.period - to_months(CAST(h.k AS INTEGER)) AS DATE) AS period, h.value,
  'baseline_history' AS role, CASE WHEN ready THEN round(med, 4) END AS baseline_median
FROM z JOIN h ON h.customer_state = z.customer_state AND h.period = z.period AND h.k <= n WHERE z.ok
UNION ALL SELECT customer_state, period, period, value, 'current', CASE WHEN ready THEN round(med, 4) END FROM z WHERE value IS NOT NULL"""


def _components(spark, folder):
    cube = monthly_gmv(bound_star(spark, folder), None, (PRODUCT_CATEGORY,))
    return cube.select(F.col(PURCHASE_MONTH).alias("period"), PRODUCT_CATEGORY, F.col("gmv").alias("value"))


def _shares(spark, folder):
    rows, _ = contribution(_components(spark, folder), PRODUCT_CATEGORY, ("period",))
    rows = rows.withColumns({"value": F.col("value").cast("double"), "contribution": F.round("contribution", 9)})
    return contribution_evidence(rows, ("period",))


QUERIES["series_contribution_evidence"] = _shares
ORACLES["series_contribution_evidence"] = f"""WITH {star()}, {_CUBE}
SELECT purchase_month AS period, product_category AS "group", CAST(gmv AS DOUBLE) AS value,
{ratio('gmv', 'sum(gmv) OVER (PARTITION BY purchase_month)', 9)} AS contribution,
CAST(product_category = 'unknown' AS INTEGER) AS is_unknown_group FROM cube"""


def _external(spark, folder):
    """Category values against the payments of the same month: totals that do not agree."""
    star_ = bound_star(spark, folder)
    paid = (
        star_.orders.filter(F.col("order_status") == star_.statuses.delivered)
        .join(star_.payments, "order_id")
        .groupBy(F.trunc("purchase_ts", "MM").alias("period"))
        .agg(F.sum("payment_value").alias("denominator"))
    )
    _, check = contribution(_components(spark, folder), PRODUCT_CATEGORY, ("period",), denominators=paid)
    return check.withColumns(
        {
            "component_sum": F.col("component_sum").cast("double"),
            "denominator": F.col("denominator").cast("double"),
            "value_difference": F.col("value_difference").cast("double"),
            "contribution_sum": F.round("contribution_sum", 9),
        }
    )


QUERIES["series_contribution_sum_check"] = _external
ORACLES["series_contribution_sum_check"] = f"""WITH {star()}, {_CUBE},
d AS (SELECT purchase_month, sum(paid) AS paid FROM sales JOIN pay USING (oid) WHERE st = 'delivered' GROUP BY 1),
t AS (SELECT purchase_month, sum(gmv) AS s FROM cube GROUP BY 1)
SELECT purchase_month AS period, CAST(s AS DOUBLE) AS component_sum, CAST(paid AS DOUBLE) AS denominator, CAST(s - paid AS DOUBLE) AS value_difference,
{ratio('s', 'paid', 9)} AS contribution_sum, 'computed' AS calculation_status, CAST(s = paid AS INTEGER) AS passed, 0 AS has_negative_component
FROM t JOIN d USING (purchase_month)"""


def _scopes(spark, folder):
    series = own_ends_incomplete(_state_series(spark, folder), (CUSTOMER_STATE,))
    scoped = series.select(
        F.lit("delivered_gmv").alias("metric_id"),
        "period",
        F.concat(F.lit("state="), CUSTOMER_STATE).alias("filters"),
        F.lit("delivered").alias("status_scope"),
        F.when(F.month("period") == 2, "price_and_freight").otherwise("price").alias("amount_basis"),
        "completeness",
        "value",
    )
    totals = scoped.filter(F.col("filters") != "state=NATION_7").withColumn("amount_basis", F.lit("price"))
    totals = totals.drop("value").withColumn("denominator", F.lit(1.0))
    return scope_match(scoped, totals).select("filters", "period", "amount_basis", "denominator", "scope_status")


QUERIES["series_scope_match"] = _scopes
ORACLES["series_scope_match"] = f"""WITH {star()}, {_SERIES},
s AS (SELECT 'state=' || customer_state AS filters, period, month(period) = 2 AS feb, customer_state <> 'NATION_7' AS known FROM obs)
SELECT filters, period, CASE WHEN feb THEN 'price_and_freight' ELSE 'price' END AS amount_basis,
CASE WHEN known AND NOT feb THEN 1.0::DOUBLE END AS denominator, CASE WHEN known AND NOT feb THEN 'matched' ELSE 'scope_mismatch' END AS scope_status FROM s"""
