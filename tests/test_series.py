"""Status words and numbers of the series operators on tiny series."""

import datetime as dt
from decimal import Decimal

import pytest

from metricloom.operators.series import (
    SeriesInputError,
    anomaly_mad,
    contribution,
    monthly_observations,
    period_compare,
    scope_match,
)

OBS = "series string, period date, value double, completeness string, reason string"


def series(spark, months, partial=(), name="s"):
    rows = [
        (name, dt.date.fromisoformat(f"{m}-01"), float(v), "incomplete" if m in partial else "complete", "partial" if m in partial else None)
        for m, v in months.items()
    ]
    return spark.createDataFrame(rows, OBS)


def target(spark, month, name="s"):
    return spark.createDataFrame([(name, dt.date.fromisoformat(f"{month}-01"))], "series string, period date")


def compare(spark, months, month, kind="month_over_month", partial=()):
    return period_compare(series(spark, months, partial), kind, ["series"], target(spark, month)).first()


def test_year_over_year(spark):
    r = compare(spark, {"2023-01": 100, "2024-01": 90}, "2024-01", "year_over_year")
    assert (r.absolute_change, r.relative_change) == (-10, -0.1)
    assert (r.calculation_status, r.comparability) == ("computed", "comparable")


def test_known_month_over_month(spark):
    r = compare(spark, {"2018-06": 856077.86, "2018-07": 867953.46}, "2018-07")
    assert r.absolute_change == pytest.approx(11875.60)
    assert r.relative_change == pytest.approx(0.0138721027)


@pytest.mark.parametrize(
    "months, status, transition, relative",
    [
        ({"2018-06": 0, "2018-07": 5}, "zero_baseline", "none", None),
        ({"2018-06": -4, "2018-07": 5}, "negative_baseline", "negative_to_zero_or_positive", None),
        ({"2018-06": 4, "2018-07": -2}, "computed", "zero_or_positive_to_negative", -1.5),
        ({"2018-05": 4, "2018-07": 2}, "missing_comparison_period", "none", None),
        ({"2018-05": 4, "2018-06": 2}, "missing_current_period", "none", None),
        ({"2018-04": 4}, "missing_current_period", "none", None),
    ],
)
def test_statuses(spark, months, status, transition, relative):
    r = compare(spark, months, "2018-07")
    assert (r.calculation_status, r.sign_transition, r.relative_change) == (status, transition, relative)
    if status.startswith("missing"):
        assert (r.comparability, r.absolute_change) == ("not_applicable", None)


def test_incomplete_periods_keep_the_arithmetic(spark):
    r = compare(spark, {"2018-06": 4, "2018-07": 2}, "2018-07", partial=("2018-06", "2018-07"))
    assert (r.absolute_change, r.comparability) == (-2, "not_comparable")
    assert r.comparability_reasons == "current_period_incomplete,comparison_period_incomplete"


HISTORY = {"2024-01": 100, "2024-02": 102, "2024-03": 98, "2024-04": 101, "2024-05": 99}


def anomaly(spark, months, partial=(), month="2024-06", **options):
    return anomaly_mad(series(spark, months, partial), ["series"], target(spark, month), **options).first()


def test_detected_and_normal(spark):
    r = anomaly(spark, HISTORY | {"2024-06": 160})
    assert (r.baseline_median, r.baseline_mad, r.calculation_status, r.direction) == (100, 1, "detected", "above_baseline")
    assert r.robust_z_score == pytest.approx(40.47)
    assert anomaly(spark, HISTORY | {"2024-06": 103}).calculation_status == "not_detected"


def test_known_score(spark):
    values = [421923.37, 481604.52, 554699.70, 607399.67, 648247.65, 987765.37]
    months = {f"2017-{m:02d}": v for m, v in zip(range(6, 12), values)}
    r = anomaly(spark, months, month="2017-11", window=5, minimum_history=5)
    assert r.robust_z_score == pytest.approx(3.9961977577)
    assert r.is_anomaly


def test_history_interruptions(spark):
    now = {"2024-06": 160}
    short = {m: v for m, v in HISTORY.items() if m > "2024-02"} | now
    assert anomaly(spark, short).calculation_status == "non_contiguous_history"
    gap = {m: v for m, v in HISTORY.items() if m != "2024-03"} | now
    assert anomaly(spark, gap).calculation_status == "non_contiguous_history"
    assert anomaly(spark, HISTORY | now, ("2024-03",)).calculation_status == "incomplete_history"
    assert anomaly(spark, HISTORY | now, ("2024-06",)).calculation_status == "incomplete_current_period"
    assert anomaly(spark, HISTORY).calculation_status == "missing_current_period"
    flat = {m: 100 for m in HISTORY} | now
    assert anomaly(spark, flat).calculation_status == "zero_dispersion"


def test_long_run_survives_an_older_gap(spark):
    r = anomaly(spark, {"2023-11": 1} | HISTORY | {"2024-06": 100}, window=7)
    assert (r.history_months, r.calculation_status) == (5, "not_detected")


def shares(spark, values, **options):
    rows = spark.createDataFrame([(g, Decimal(str(v))) for g, v in values.items()], "g string, value decimal(18,4)")
    out, check = contribution(rows, "g", **options)
    return {r.group: r for r in out.collect()}, check.first()


def test_contribution(spark):
    rows, check = shares(spark, {"A": 60, "B": 30, "unknown": 10})
    assert [rows[g].contribution for g in ("A", "B", "unknown")] == [0.6, 0.3, 0.1]
    assert (rows["unknown"].is_unknown_group, check.passed, check.contribution_sum) == (1, 1, 1.0)
    rows, check = shares(spark, {"A": 0, "B": 0})
    assert (rows["A"].contribution, check.calculation_status, check.passed) == (None, "zero_denominator", 0)
    rows, check = shares(spark, {"positive": 120, "negative": -20})
    assert (rows["positive"].contribution, rows["negative"].contribution, check.has_negative_component) == (1.2, -0.2, 1)
    assert shares(spark, {"A": -5})[1].calculation_status == "non_positive_denominator"


def test_external_denominator(spark):
    total = spark.createDataFrame([(Decimal(100),)], "denominator decimal(18,4)")
    rows, check = shares(spark, {"A": 60}, denominators=total)
    assert (rows["A"].contribution, check.passed, float(check.value_difference)) == (0.6, 0, -40.0)


def test_scope_mismatch(spark):
    left = spark.createDataFrame([("gmv", "state=RJ"), ("gmv", None)], "metric_id string, filters string")
    right = spark.createDataFrame([("gmv", None, 9.0)], "metric_id string, filters string, denominator double")
    got = {r.filters: r.scope_status for r in scope_match(left, right, ("metric_id", "filters")).collect()}
    assert got == {"state=RJ": "scope_mismatch", None: "matched"}


def test_observation_contract(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 1.0), ("2024-02-02", 1.0), ("2024-03-01", float("nan")), ("x", 1.0), ("2024-05-01", None), ("2024-06-01", 1.0), ("2024-06-01", 2.0)],
        "month string, v double",
    )
    good, bad = monthly_observations(df, "month", "v")
    assert [r.period.isoformat() for r in good.collect()] == ["2024-01-01"]
    assert sorted((r.raw_period, r.error_code) for r in bad.collect()) == [
        ("2024-02-02", "invalid_observation"),
        ("2024-03-01", "invalid_observation"),
        ("2024-05-01", "invalid_value"),
        ("2024-06-01", "invalid_observation"),
        ("2024-06-01", "invalid_observation"),
        ("x", "invalid_period"),
    ]
    with pytest.raises(SeriesInputError) as error:
        monthly_observations(df, "month", "absent")
    assert error.value.code == "missing_column"
    with pytest.raises(SeriesInputError):
        monthly_observations(df, "month", "v", truncated=True)
