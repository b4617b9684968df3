"""Operators over data whose group keys are partly NULL: such rows are a group like any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators.ledger import first_seen, sequence_audit
from metricloom.operators.scoring import operational_summary
from metricloom.operators.series import contribution, own_ends_incomplete, period_compare
from metricloom.operators.windows import share_of_partition, year_over_year
from registry.common import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Views have no group, the other events their own type.
_GROUP = "CASE WHEN event_type <> 'view' THEN event_type END"


def _events(spark, folder):
    return tables(spark, folder)("events").withColumn("grp", F.expr(_GROUP))


def _share(spark, folder):
    totals = _events(spark, folder).groupBy("grp", "user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return share_of_partition(totals, ("grp",), "total").select("grp", "user_id", F.round(F.col("share").cast("double"), 9).alias("share"))


QUERIES["null_key_share_of_partition"] = _share
ORACLES["null_key_share_of_partition"] = f"""WITH t AS (SELECT {_GROUP} AS grp, user_id, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY 1, 2)
SELECT grp, user_id, round(CAST(total AS DOUBLE) / CAST(nullif(sum(total) OVER (PARTITION BY grp), 0) AS DOUBLE), 9) AS share FROM t"""


def _sequence(spark, folder):
    return sequence_audit(_events(spark, folder), ("grp",), "event_id")


QUERIES["null_key_sequence_audit"] = _sequence
ORACLES["null_key_sequence_audit"] = f"""WITH e AS (SELECT {_GROUP} AS grp, event_id FROM events),
d AS (SELECT grp, event_id, count(*) AS n FROM e GROUP BY 1, 2),
s AS (SELECT *, CAST(coalesce(lag(event_id) OVER (PARTITION BY grp ORDER BY event_id) = event_id - 1, FALSE) AS INTEGER) AS follows FROM d)
SELECT grp, CAST(sum(n) AS BIGINT) AS rows, min(event_id) AS first_number, max(event_id) AS last_number, CAST(sum(n - 1) AS BIGINT) AS repeats, CAST(count(*) - sum(follows) - 1 AS BIGINT) AS gaps,
CAST(min(event_id) = 1 AND sum(n - 1) = 0 AND count(*) - sum(follows) = 1 AS INTEGER) AS contiguous FROM s GROUP BY 1"""


def _first(spark, folder):
    """Neither views nor their text are named."""
    return first_seen(_events(spark, folder), ("grp",), F.when(F.col("event_type") != "click", F.col("user_id").cast("string")), "event_id").select("event_id", "grp", "first_seen", "is_duplicate")


QUERIES["null_key_first_seen"] = _first
ORACLES["null_key_first_seen"] = f"""WITH e AS (SELECT event_id, {_GROUP} AS grp, CASE WHEN event_type <> 'click' THEN user_id END AS x FROM events)
SELECT event_id, grp, min(event_id) OVER w AS first_seen, CAST(event_id > min(event_id) OVER w AS INTEGER) AS is_duplicate FROM e WINDOW w AS (PARTITION BY grp, x)"""


def _quantiles(spark, folder):
    return operational_summary(_events(spark, folder).withColumn("calls", F.lit(1)), ("grp",), "value", (), "calls").select("grp", "case_count", F.round("median_latency", 9).alias("median_latency"), "p95_latency")


QUERIES["null_key_operational_summary"] = _quantiles
ORACLES["null_key_operational_summary"] = f"""WITH e AS (SELECT {_GROUP} AS grp, value FROM events)
SELECT grp, count(*) AS case_count, round(median(value), 9) AS median_latency, list_sort(list(value))[CAST(greatest(1, ceil(count(*) * 95 / 100.0)) AS BIGINT)] AS p95_latency FROM e GROUP BY 1"""


_MONTHLY = f"SELECT {_GROUP} AS grp, CAST(date_trunc('month', ts) AS DATE) AS period, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2"


def _monthly(spark, folder):
    month = F.trunc(F.col("ts").cast("date"), "month").alias("period")
    return _events(spark, folder).groupBy("grp", month).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


def _yoy(spark, folder):
    return year_over_year(_monthly(spark, folder), "value", "period", ("grp",)).select("grp", "period", "previous_year_month", F.round("previous_year_value", 6).alias("previous_year_value"), "is_comparable")


QUERIES["null_key_year_over_year"] = _yoy
ORACLES["null_key_year_over_year"] = f"""WITH m AS ({_MONTHLY}), b AS (SELECT *, period IN (min(period) OVER w, max(period) OVER w) AS edge FROM m WINDOW w AS (PARTITION BY grp))
SELECT a.grp, a.period, b.period AS previous_year_month, round(b.value, 6) AS previous_year_value, CAST(b.period IS NOT NULL AND NOT a.edge AND NOT coalesce(b.edge, FALSE) AS INTEGER) AS is_comparable
FROM b a LEFT JOIN b ON a.grp IS NOT DISTINCT FROM b.grp AND b.period = a.period - INTERVAL 1 YEAR"""


def _compared(spark, folder):
    return period_compare(own_ends_incomplete(_monthly(spark, folder), ("grp",)), "month_over_month", ("grp",)).groupBy("grp", "calculation_status").agg(F.count(F.lit(1)).alias("months"))


QUERIES["null_key_period_compare"] = _compared
ORACLES["null_key_period_compare"] = f"""WITH m AS ({_MONTHLY}), c AS (
SELECT grp, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM m GROUP BY 1)
SELECT c.grp, CASE WHEN a.period IS NULL THEN 'missing_current_period' WHEN b.period IS NULL THEN 'missing_comparison_period' WHEN b.value = 0 THEN 'zero_baseline'
WHEN b.value < 0 THEN 'negative_baseline' ELSE 'computed' END AS calculation_status, count(*) AS months
FROM c LEFT JOIN m a ON c.grp IS NOT DISTINCT FROM a.grp AND a.period = c.period
LEFT JOIN m b ON c.grp IS NOT DISTINCT FROM b.grp AND b.period = c.period - INTERVAL 1 MONTH GROUP BY 1, 2"""


def _contribution(spark, folder):
    totals = _events(spark, folder).groupBy("grp", F.col("user_id").cast("string").alias("user")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
    rows, check = contribution(totals, "user", ("grp",))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("shares")).join(check.select(F.col("grp").alias("g"), "passed"), F.col("grp").eqNullSafe(F.col("g"))).drop("g")


QUERIES["null_key_contribution"] = _contribution
ORACLES["null_key_contribution"] = f"SELECT {_GROUP} AS grp, count(DISTINCT user_id) AS shares, 1 AS passed FROM events GROUP BY 1"
