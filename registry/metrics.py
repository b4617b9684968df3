"""Metrics without and with dimensions, the metric pack, and the named reports."""

from __future__ import annotations

from metricloom.plans.catalog import (
    CUSTOMER_CITY,
    CUSTOMER_STATE,
    PRODUCT_CATEGORY,
    PURCHASE_MONTH,
    AnalysisPlan,
    DimensionFilter,
)
from metricloom.plans.compiler import compile_plan, metric_pack
from metricloom.plans.reports import REPORTS, state_monthly_canceled, state_monthly_gmv
from registry.common import IN_PERIOD, PERIOD, amount, bound_star, ratio, star

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _metric(name, metric_id, sql, dims=(), filters=(), period=PERIOD, open_status="open"):
    plan = AnalysisPlan((metric_id,), tuple(dims), tuple(filters), period)
    QUERIES[name] = lambda spark, folder: compile_plan(bound_star(spark, folder, open_status), plan)
    ORACLES[name] = f"WITH {star(open_status)} {sql}"


_DELIVERED = f"st = 'delivered' AND {IN_PERIOD}"
_LINES = "sales JOIN line USING (oid)"

_SCALARS = {
    "delivered_gmv": (amount("sum(price)"), _LINES, _DELIVERED),
    "delivered_gmv_including_freight": (amount("sum(price + freight)"), _LINES, _DELIVERED),
    "delivered_payment_amount": (amount("sum(paid)"), "sales JOIN pay USING (oid)", _DELIVERED),
    "delivered_customer_count": ("count(DISTINCT person)", "sales JOIN cust USING (cid)", _DELIVERED),
    "delivered_order_count": ("count(DISTINCT oid)", "sales", _DELIVERED),
    "invalid_carrier_delivery_sequence_count": ("count(DISTINCT oid)", "sales", f"arrived < handed AND {IN_PERIOD}"),
    "canceled_order_count": ("count(DISTINCT oid)", "sales", f"st = 'canceled' AND {IN_PERIOD}"),
    "delivered_item_count": ("count(seq)", _LINES, _DELIVERED),
    "delivered_freight_amount": (amount("sum(freight)"), _LINES, _DELIVERED),
    "delivered_freight_to_gmv_rate": (ratio("sum(freight)", "sum(price)"), _LINES, _DELIVERED),
    "average_items_per_delivered_order": (
        ratio("count(seq)", "count(DISTINCT oid)"),
        "sales LEFT JOIN line USING (oid)",
        _DELIVERED,
    ),
    "on_time_delivery_rate": (
        ratio("count(*) FILTER (arrived <= due)", "count(*)"),
        "sales",
        f"{_DELIVERED} AND arrived IS NOT NULL AND due IS NOT NULL",
    ),
    "average_order_delivery_days": (
        "round(CAST(sum(date_diff('microsecond', ts, arrived)) AS DOUBLE) / count(*) / 86400000000.0, 6)",
        "sales",
        f"{_DELIVERED} AND arrived >= ts",
    ),
}
for _id, (_value, _source, _where) in _SCALARS.items():
    _metric(f"metric_{_id}", _id, f"SELECT {_value} AS {_id} FROM {_source} WHERE {_where}")

_metric(
    "metric_delivered_average_order_value",
    "delivered_average_order_value",
    f"""SELECT {ratio('sum(coalesce(gmv, 0))', 'count(*)', 2)} AS delivered_average_order_value
    FROM sales LEFT JOIN (SELECT oid, sum(price) AS gmv FROM line GROUP BY 1) g USING (oid) WHERE {_DELIVERED}""",
)
_metric(
    "metric_average_carrier_delivery_days",
    "average_carrier_delivery_days",
    f"""SELECT round(CAST(sum(date_diff('microsecond', handed, arrived)) FILTER (arrived >= handed) AS DOUBLE)
          / count(*) FILTER (arrived >= handed) / 86400000000.0, 6) AS average_carrier_delivery_days,
        count(*) FILTER (arrived < handed) AS excluded_order_count
    FROM sales WHERE {_DELIVERED} AND arrived IS NOT NULL""",
)
for _status in ("open", "unavailable"):
    _suffix = "" if _status == "open" else "_all_statuses"
    _metric(
        f"metric_terminal_order_count{_suffix}",
        "terminal_order_count",
        f"SELECT count(DISTINCT oid) AS terminal_order_count FROM sales WHERE st IN ('delivered','canceled','unavailable') AND {IN_PERIOD}",
        open_status=_status,
    )
    _metric(
        f"metric_terminal_cancellation_rate{_suffix}",
        "terminal_cancellation_rate",
        f"""SELECT {ratio("count(*) FILTER (st = 'canceled')", "count(*)")} AS terminal_cancellation_rate
        FROM sales WHERE st IN ('delivered','canceled','unavailable') AND {IN_PERIOD}""",
        open_status=_status,
    )
_metric(
    "metric_unavailable_order_count",
    "unavailable_order_count",
    f"SELECT count(DISTINCT oid) AS unavailable_order_count FROM sales WHERE st = 'unavailable' AND {IN_PERIOD}",
    open_status="unavailable",
)
_PEOPLE = f"(SELECT person, count(DISTINCT oid) AS n FROM sales JOIN cust USING (cid) WHERE {_DELIVERED} GROUP BY 1)"
_metric(
    "metric_period_repeat_customer_count",
    "period_repeat_customer_count",
    f"SELECT count(*) AS period_repeat_customer_count FROM {_PEOPLE} WHERE n >= 2",
)
_metric(
    "metric_period_repeat_customer_rate",
    "period_repeat_customer_rate",
    f"SELECT {ratio('count(*) FILTER (n >= 2)', 'count(*)')} AS period_repeat_customer_rate FROM {_PEOPLE}",
)
_metric(
    "metric_historical_returning_customer_rate",
    "historical_returning_customer_rate",
    f"""SELECT {ratio('count(*) FILTER (person IN (SELECT person FROM sales JOIN cust USING (cid) WHERE st = ' + "'delivered' AND ts < TIMESTAMP '1996-01-01'" + '))', 'count(*)')}
        AS historical_returning_customer_rate FROM {_PEOPLE}""",
)
_metric(
    "metric_delivered_payment_reconciliation_difference",
    "delivered_payment_reconciliation_difference",
    f"""SELECT {amount('sum(coalesce(paid, 0)) - sum(coalesce(gmv, 0)) - sum(coalesce(fr, 0))')}
        AS delivered_payment_reconciliation_difference
    FROM sales LEFT JOIN (SELECT oid, sum(price) AS gmv, sum(freight) AS fr FROM line GROUP BY 1) g USING (oid)
    LEFT JOIN (SELECT oid, sum(paid) AS paid FROM pay GROUP BY 1) p USING (oid) WHERE {_DELIVERED}""",
)

# Series metrics.
_MONTHLY = """monthly AS (SELECT purchase_month, sum(price) AS gmv FROM sales JOIN line USING (oid)
  WHERE st = 'delivered' GROUP BY 1),
ends AS (SELECT CAST(date_trunc('month', min(ts)) AS DATE) AS lo, CAST(date_trunc('month', max(ts)) AS DATE) AS hi FROM sales),
flagged AS (SELECT m.*, CAST(purchase_month IN (lo, hi) AS INTEGER) AS edge FROM monthly m, ends)"""
_CUBE = """cube AS (SELECT purchase_month, product_category, sum(price) AS gmv
  FROM sales JOIN line USING (oid) LEFT JOIN prod USING (pid) WHERE st = 'delivered' GROUP BY 1, 2)"""
_metric(
    "metric_delivered_monthly_gmv",
    "delivered_monthly_gmv",
    f""", {_MONTHLY} SELECT purchase_month, {amount('gmv')} AS delivered_monthly_gmv, edge AS is_boundary_month FROM flagged""",
    period=None,
    dims=(PURCHASE_MONTH,),
)
_metric(
    "metric_delivered_gmv_mom_rate",
    "delivered_gmv_mom_rate",
    f""", {_MONTHLY} SELECT a.purchase_month, round({ratio('a.gmv', 'b.gmv', 15)} - 1, 6) AS delivered_gmv_mom_rate,
      CAST(coalesce(a.edge = 0 AND b.edge = 0, false) AS INTEGER) AS is_comparable
      FROM flagged a LEFT JOIN flagged b ON b.purchase_month = a.purchase_month - INTERVAL 1 MONTH""",
    period=None,
    dims=(PURCHASE_MONTH,),
)
_metric(
    "metric_delivered_gmv_yoy_rate",
    "delivered_gmv_yoy_rate",
    f""", {_MONTHLY} SELECT a.purchase_month, round({ratio('a.gmv', 'b.gmv', 15)} - 1, 6) AS delivered_gmv_yoy_rate,
      CAST(coalesce(a.edge = 0 AND b.edge = 0, false) AS INTEGER) AS is_comparable
      FROM flagged a LEFT JOIN flagged b ON b.purchase_month = a.purchase_month - INTERVAL 1 YEAR""",
    period=None,
    dims=(PURCHASE_MONTH,),
)
_metric(
    "metric_delivered_monthly_category_gmv_rank",
    "delivered_monthly_category_gmv_rank",
    f""", {_CUBE} SELECT purchase_month, product_category,
      dense_rank() OVER (PARTITION BY purchase_month ORDER BY gmv DESC) AS delivered_monthly_category_gmv_rank FROM cube""",
    period=None,
    dims=(PURCHASE_MONTH, PRODUCT_CATEGORY),
)
_metric(
    "metric_delivered_category_gmv_contribution",
    "delivered_category_gmv_contribution",
    f""", {_CUBE} SELECT product_category,
      {ratio('sum(gmv)', '(SELECT sum(gmv) FROM cube)')} AS delivered_category_gmv_contribution FROM cube GROUP BY 1""",
    period=None,
    dims=(PRODUCT_CATEGORY,),
)

# The compiler with several metrics of different grains, two dimensions and filters.
_MIXED = ("delivered_gmv", "delivered_order_count", "delivered_customer_count", "delivered_payment_amount", "on_time_delivery_rate")


def _mixed(spark, folder):
    plan = AnalysisPlan(
        _MIXED,
        (PURCHASE_MONTH, CUSTOMER_STATE),
        (DimensionFilter(CUSTOMER_CITY, "in", ("BUILDING", "MACHINERY", "HOUSEHOLD")),),
        PERIOD,
    )
    return compile_plan(bound_star(spark, folder), plan)


QUERIES["plan_mixed_grains_by_month_and_state"] = _mixed
ORACLES["plan_mixed_grains_by_month_and_state"] = f"""WITH {star()},
scope AS (SELECT sales.*, person, customer_state FROM sales JOIN cust USING (cid)
  WHERE {_DELIVERED} AND customer_city IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')),
g AS (SELECT oid, sum(price) AS gmv FROM line GROUP BY 1),
p AS (SELECT oid, sum(paid) AS paid FROM pay GROUP BY 1)
SELECT purchase_month, customer_state, {amount('sum(gmv)')} AS delivered_gmv,
  count(DISTINCT oid) AS delivered_order_count, count(DISTINCT person) AS delivered_customer_count,
  {amount('sum(paid)')} AS delivered_payment_amount,
  {ratio('count(*) FILTER (arrived <= due)', 'count(*) FILTER (arrived IS NOT NULL)')} AS on_time_delivery_rate
FROM scope LEFT JOIN g USING (oid) LEFT JOIN p USING (oid) GROUP BY 1, 2"""

# One query over several metrics as (metric_id, value).
_PACK = (
    "delivered_order_count",
    "delivered_gmv",
    "delivered_average_order_value",
    "delivered_customer_count",
    "delivered_payment_amount",
    "delivered_freight_amount",
    "terminal_cancellation_rate",
    "on_time_delivery_rate",
    "period_repeat_customer_count",
)
QUERIES["metric_pack"] = lambda spark, folder: metric_pack(bound_star(spark, folder), _PACK)
ORACLES["metric_pack"] = f"""WITH {star()},
g AS (SELECT oid, sum(price) AS gmv, sum(freight) AS fr FROM line GROUP BY 1),
ok AS (SELECT sales.*, gmv, fr FROM sales LEFT JOIN g USING (oid) WHERE st = 'delivered')
SELECT 'delivered_order_count' AS metric_id, CAST(count(*) AS DOUBLE) AS value FROM ok
UNION ALL SELECT 'delivered_gmv', {amount('sum(gmv)')} FROM ok
UNION ALL SELECT 'delivered_average_order_value', {ratio('sum(gmv)', 'count(*)', 2)} FROM ok
UNION ALL SELECT 'delivered_customer_count', CAST(count(DISTINCT cid) AS DOUBLE) FROM ok
UNION ALL SELECT 'delivered_payment_amount', {amount('sum(paid)')} FROM ok JOIN pay USING (oid)
UNION ALL SELECT 'delivered_freight_amount', {amount('sum(fr)')} FROM ok
UNION ALL SELECT 'terminal_cancellation_rate', {ratio("count(*) FILTER (st = 'canceled')", 'count(*)')} FROM sales WHERE st <> 'open'
UNION ALL SELECT 'on_time_delivery_rate', {ratio('count(*) FILTER (arrived <= due)', 'count(*)')} FROM ok WHERE arrived IS NOT NULL
UNION ALL SELECT 'period_repeat_customer_count', CAST(count(*) AS DOUBLE) FROM (SELECT cid FROM ok GROUP BY 1 HAVING count(*) >= 2)"""

# Reports.
_STATE = "sales JOIN cust USING (cid)"


def _report(name, sql):
    QUERIES[f"report_{name}"] = lambda spark, folder: REPORTS[name](bound_star(spark, folder), PERIOD)
    ORACLES[f"report_{name}"] = f"WITH {star()} {sql}"


def _by(dim, value, alias, source, where=_DELIVERED, top=None, having=""):
    limit = f" LIMIT {top}" if top else ""
    return f"SELECT {dim}, {value} AS {alias} FROM {source} WHERE {where} GROUP BY 1 {having} ORDER BY 2 DESC, 1 ASC{limit}"


_CAT = f"{_LINES} LEFT JOIN prod USING (pid)"
_report("orders_by_month", _by("purchase_month", "count(DISTINCT oid)", "delivered_order_count", "sales"))
_report("gmv_by_state_top5", _by("customer_state", amount("sum(price)"), "delivered_gmv", f"{_LINES} JOIN cust USING (cid)", top=5))
_report(
    "category_dense_rank_top3",
    f"""SELECT product_category, {amount('gmv')} AS category_gmv, rk AS category_rank FROM (
      SELECT product_category, sum(price) AS gmv, dense_rank() OVER (ORDER BY sum(price) DESC) AS rk
      FROM {_CAT} WHERE {_DELIVERED} GROUP BY 1) WHERE rk <= 3""",
)
_report("gmv_by_seller_top10", _by("seller", amount("sum(price)"), "delivered_gmv", _LINES, top=10))
_report("payments_by_type", _by("payment_type", amount("sum(paid)"), "delivered_payment_amount", "sales JOIN pay USING (oid)"))
_report("customers_by_state", _by("customer_state", "count(DISTINCT person)", "delivered_customer_count", _STATE))
_report(
    "cancellation_rate_by_state",
    _by(
        "customer_state",
        ratio("count(*) FILTER (st = 'canceled')", "count(*)"),
        "terminal_cancellation_rate",
        _STATE,
        f"st IN ('delivered', 'canceled', 'unavailable') AND {IN_PERIOD}",
    ),
)
_report(
    "on_time_rate_by_state_min100",
    _by(
        "customer_state",
        ratio("count(*) FILTER (arrived <= due)", "count(*)"),
        "on_time_delivery_rate",
        _STATE,
        f"{_DELIVERED} AND arrived IS NOT NULL",
        top=10,
        having="HAVING count(*) >= 100",
    ),
)
_report(
    "delivery_days_by_state_top5",
    _by(
        "customer_state",
        "round(CAST(sum(date_diff('microsecond', ts, arrived)) AS DOUBLE) / count(*) / 86400000000.0, 6)",
        "average_order_delivery_days",
        _STATE,
        f"{_DELIVERED} AND arrived >= ts",
        top=5,
    ),
)
_report("items_by_category_top10", _by("product_category", "count(seq)", "delivered_item_count", _CAT, top=10))
_report("freight_rate_by_category_top10", _by("product_category", ratio("sum(freight)", "sum(price)"), "delivered_freight_to_gmv_rate", _CAT, top=10))
_report(
    "items_per_order_by_state",
    _by("customer_state", ratio("count(seq)", "count(DISTINCT oid)"), "average_items_per_delivered_order", f"{_STATE} LEFT JOIN line USING (oid)"),
)
_report(
    "repeat_rate_by_state",
    f"""SELECT customer_state, {ratio('count(*) FILTER (n >= 2)', 'count(*)')} AS period_repeat_customer_rate
    FROM (SELECT customer_state, person, count(DISTINCT oid) AS n FROM {_STATE} WHERE {_DELIVERED} GROUP BY 1, 2) GROUP BY 1""",
)
_report(
    "payments_by_city_top10",
    _by("customer_city", amount("sum(paid)"), "delivered_payment_amount", f"{_STATE} JOIN pay USING (oid)", top=10),
)
_report("gmv_by_month", _by("purchase_month", amount("sum(price)"), "delivered_gmv", _LINES))
_report("payments_by_month", _by("purchase_month", amount("sum(paid)"), "delivered_payment_amount", "sales JOIN pay USING (oid)"))
_report("freight_by_seller_top10", _by("seller", amount("sum(freight)"), "delivered_freight_amount", _LINES, top=10))
_report(
    "gmv_with_freight_by_category_top10",
    _by("product_category", amount("sum(price + freight)"), "delivered_gmv_including_freight", _CAT, top=10),
)
_report(
    "monthly_reconciliation",
    f""", g AS (SELECT oid, sum(price) AS gmv, sum(freight) AS fr FROM line GROUP BY 1),
    p AS (SELECT oid, sum(paid) AS paid FROM pay GROUP BY 1),
    t AS (SELECT purchase_month, sum(coalesce(gmv, 0)) AS gmv, sum(coalesce(fr, 0)) AS fr, sum(coalesce(paid, 0)) AS paid
      FROM sales LEFT JOIN g USING (oid) LEFT JOIN p USING (oid) WHERE {_DELIVERED} GROUP BY 1)
    SELECT purchase_month, {amount('gmv')} AS gmv, {amount('fr')} AS freight, {amount('paid')} AS payments,
      {amount('gmv + fr')} AS gmv_including_freight, {amount('paid - gmv')} AS payments_minus_gmv,
      {amount('paid - gmv - fr')} AS reconciliation_difference FROM t""",
)
_report(
    "late_handover_orders_by_state",
    _by("customer_state", "count(DISTINCT oid)", "invalid_carrier_delivery_sequence_count", _STATE, f"arrived < handed AND {IN_PERIOD}"),
)
_report(
    "positive_category_gmv",
    _by("product_category", amount("sum(price)"), "delivered_gmv", _CAT, having="HAVING sum(price) > 0"),
)

QUERIES["report_state_monthly_gmv"] = lambda spark, folder: state_monthly_gmv(bound_star(spark, folder), "NATION_3")
ORACLES["report_state_monthly_gmv"] = f"""WITH {star()} SELECT purchase_month, {amount('sum(price)')} AS metric_value
FROM {_STATE} JOIN line USING (oid) WHERE st = 'delivered' AND customer_state = 'NATION_3' GROUP BY 1"""
QUERIES["report_state_monthly_canceled_zero_filled"] = lambda spark, folder: state_monthly_canceled(
    bound_star(spark, folder), "NATION_3", "1994-10-01", 90
)
ORACLES["report_state_monthly_canceled_zero_filled"] = f"""WITH {star()},
cal AS (SELECT CAST(DATE '1994-10-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS purchase_month FROM range(90) r(i)),
c AS (SELECT purchase_month, count(DISTINCT oid) AS n FROM {_STATE}
  WHERE st = 'canceled' AND customer_state = 'NATION_3' GROUP BY 1)
SELECT cal.purchase_month, coalesce(n, 0) AS metric_value FROM cal LEFT JOIN c USING (purchase_month)"""
