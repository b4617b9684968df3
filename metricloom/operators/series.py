"""Deterministic analysis of monthly series: every series and every target month at once.

A series is rows of ``(*keys, period, value, completeness, reason)`` with ``period`` the first
day of a month. Windows are partitioned by series and ordered by a month index, so one window
partition holds at most the months of one calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.functions.joins import join_on
from metricloom.functions.scope import UNKNOWN, flag, month_index, safe_ratio

# Completeness and status words of the result contract.
COMPLETE, INCOMPLETE = "complete", "incomplete"
MAD_SCALE = 0.6745


# --------------------------------------------------------------------------- calendar


def month_scaffold(spark: SparkSession, start: str, months: int) -> DataFrame:
    """A dense calendar of ``months`` month starts as column ``period``."""
    if months < 1:
        raise ValueError("a calendar needs at least one month")
    first = F.lit(start).cast("date")
    return spark.range(months).select(F.add_months(first, F.col("id").cast("int")).alias("period"))


def spanned_calendar(series: DataFrame, keys: Sequence[str], period: str = "period") -> DataFrame:
    """Every month between the first and the last observation of each series."""
    ends = series.groupBy(*keys).agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    return ends.select(
        *keys, F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))).alias(period)
    )


def fill_calendar(
    series: DataFrame, calendar: DataFrame, keys: Sequence[str], value: str, zero_is_observed: bool
) -> DataFrame:
    """Put a series on a calendar. Absent months stay NULL unless the caller vouches that
    absence means an observed zero."""
    out = join_on(calendar, series, [*keys, "period"], "left")
    return out.withColumn(value, F.coalesce(value, F.lit(0))) if zero_is_observed else out


# --------------------------------------------------------------------------- observations


class SeriesInputError(ValueError):
    """A table that can not be read as a series at all; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def monthly_observations(
    df: DataFrame,
    period: str,
    value: str,
    keys: Sequence[str] = (),
    incomplete: DataFrame | None = None,
    truncated: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Split rows into usable observations and rejects with an error code.

    ``incomplete`` lists ``(*keys, period, reason)`` of partial months. Nothing is guessed:
    no month is filled in and no value is coerced from text or boolean.
    """
    if truncated:
        raise SeriesInputError("truncated_result", "a truncated result is not a series")
    absent = [c for c in (period, value, *keys) if c not in df.columns]
    if absent:
        raise SeriesInputError("missing_column", f"missing columns: {absent}")
    types = dict(df.dtypes)
    numeric = types[value] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[
        value
    ].startswith("decimal")
    text = F.col(period).cast("string")
    parsed = (
        F.col(period).cast("date")
        if types[period] in ("date", "timestamp", "timestamp_ntz")
        else F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    )
    rows = df.select(
        *keys,
        text.alias("raw_period"),
        parsed.alias("period"),
        (F.col(value).cast("double") if numeric else F.lit(None).cast("double")).alias("value"),
    )
    if incomplete is not None:
        marked = incomplete.select(*keys, "period", "reason", F.lit(True).alias("_partial"))
        rows = join_on(rows, marked, [*keys, "period"], "left")
    else:
        rows = rows.withColumn("reason", F.lit(None).cast("string")).withColumn("_partial", F.lit(None).cast("boolean"))
    # A month given twice is ambiguous; counting before the join back keeps this a plain sum.
    repeats = rows.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("_n")).filter(
        (F.col("_n") > 1) & F.col("period").isNotNull()
    )
    rows = join_on(rows, repeats, [*keys, "period"], "left")
    partial = F.coalesce(F.col("_partial"), F.lit(False))
    finite = ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    code = (
        F.when(F.col("period").isNull(), "invalid_period")
        .when(F.col("value").isNull(), "invalid_value")
        .when(
            (F.dayofmonth("period") != 1)
            | ~finite
            | (partial & (F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0))
            | F.col("_n").isNotNull(),
            "invalid_observation",
        )
    )
    rows = rows.withColumn("error_code", code).withColumn(
        "completeness", F.when(partial, INCOMPLETE).otherwise(COMPLETE)
    )
    accepted = rows.filter(F.col("error_code").isNull()).select(
        *keys, "period", "value", "completeness", F.when(partial, F.col("reason")).alias("reason")
    )
    rejected = rows.filter(F.col("error_code").isNotNull()).select(*keys, "raw_period", "value", "error_code")
    return accepted, rejected


def own_ends_incomplete(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Treat the first and last observed month of each series as partial."""
    whole = Window.partitionBy(*keys)
    first = F.col("period") == F.min("period").over(whole)
    last = F.col("period") == F.max("period").over(whole)
    reason = F.when(first, "first_observed_month").when(last, "last_observed_month")
    return series.select(
        *keys,
        "period",
        F.col(value).cast("double").alias("value"),
        F.when(first | last, INCOMPLETE).otherwise(COMPLETE).alias("completeness"),
        reason.alias("reason"),
    )


def _targeted(obs: DataFrame, keys: Sequence[str], targets: DataFrame | None) -> DataFrame:
    """Observations and target months on one axis; by default every month a series spans."""
    if targets is None:
        targets = spanned_calendar(obs, keys)
    marked = targets.select(*keys, "period").distinct().withColumn("_target", F.lit(True))
    seen = obs.withColumn("_seen", F.lit(True))
    return (
        join_on(seen, marked, [*keys, "period"], "full")
        .withColumn("_idx", month_index("period"))
        .withColumn("_complete", F.col("completeness") == COMPLETE)
    )


# --------------------------------------------------------------------------- comparison


def period_compare(
    obs: DataFrame, kind: str, keys: Sequence[str] = (), targets: DataFrame | None = None
) -> DataFrame:
    """Compare each target month with exactly the previous month or the same month last year.

    The comparison month is read through a one-point range frame on the month index, so it is
    found or absent; the nearest row never stands in for it.
    """
    offset = {"month_over_month": 1, "year_over_year": 12}[kind]
    rows = _targeted(obs, keys, targets)
    at = Window.partitionBy(*keys).orderBy("_idx").rangeBetween(-offset, -offset)
    other = F.max(F.when(F.col("_seen"), F.struct("value", "_complete"))).over(at)
    rows = rows.withColumn("_other", other).filter("_target")
    current, base = F.col("value"), F.col("_other.value")
    has_current, has_base = F.col("_seen").isNotNull(), F.col("_other").isNotNull()
    both = has_current & has_base
    status = (
        F.when(~has_current, "missing_current_period")
        .when(~has_base, "missing_comparison_period")
        .when(base == 0, "zero_baseline")
        .when(base < 0, "negative_baseline")
        .otherwise("computed")
    )
    partial_current, partial_base = both & ~F.col("_complete"), both & ~F.col("_other._complete")
    change = F.when(both, current - base)
    transition = (
        F.when(both & (base < 0) & (current >= 0), "negative_to_zero_or_positive")
        .when(both & (base >= 0) & (current < 0), "zero_or_positive_to_negative")
        .otherwise("none")
    )
    reasons = F.concat_ws(
        ",",
        F.when(~has_current, "current_period_missing"),
        F.when(has_current & ~has_base, "comparison_period_missing"),
        F.when(partial_current, "current_period_incomplete"),
        F.when(partial_base, "comparison_period_incomplete"),
    )
    notes = F.concat_ws(
        ",",
        F.when(~both, "missing_period_is_not_imputed_as_zero"),
        F.when(~both, "no_standard_comparison_without_exact_calendar_match"),
        F.when(both, "an_arithmetic_result_does_not_establish_business_cause"),
        F.when(status == "zero_baseline", "relative_change_undefined_for_zero_baseline"),
        F.when(status == "negative_baseline", "positive_scale_growth_language_not_applied"),
        F.when(transition != "none", "sign_flip_requires_explicit_interpretation"),
    )
    return rows.select(
        *keys,
        F.lit(kind).alias("analysis_type"),
        F.col("period").alias("target_period"),
        F.add_months("period", -offset).alias("comparison_period"),
        F.when(has_current, current).alias("current_value"),
        base.alias("comparison_value"),
        change.alias("absolute_change"),
        F.when(both & (base > 0), change / base).alias("relative_change"),
        status.alias("calculation_status"),
        F.when(~both, "not_applicable")
        .when(partial_current | partial_base, "not_comparable")
        .otherwise("comparable")
        .alias("comparability"),
        reasons.alias("comparability_reasons"),
        transition.alias("sign_transition"),
        F.when(has_current, F.col("completeness")).alias("current_completeness"),
        F.when(has_base, F.when(F.col("_other._complete"), COMPLETE).otherwise(INCOMPLETE)).alias(
            "comparison_completeness"
        ),
        notes.alias("boundary_notes"),
    )


# --------------------------------------------------------------------------- anomalies


def _median(values: Column) -> Column:
    """Median of a non-empty numeric array, averaging the two middle values."""
    ordered, n = F.array_sort(values), F.size(values)
    low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return (low + high) / 2


def anomaly_mad(
    obs: DataFrame,
    keys: Sequence[str] = (),
    targets: DataFrame | None = None,
    window: int = 6,
    minimum_history: int = 5,
    threshold: float = 3.5,
) -> DataFrame:
    """Score each target month against the median and MAD of the months right before it.

    History is the unbroken run of complete months ending just before the target, at most
    ``window`` long. The fold below extends the run only by the month directly before it; after
    the first miss no older month can match, so the run stops there by itself.
    """
    if minimum_history < 2 or window < minimum_history:
        raise ValueError("need window >= minimum_history >= 2")
    if not 0 < threshold < float("inf"):
        raise ValueError("threshold must be a finite positive number")
    rows = _targeted(obs, keys, targets)
    trailing = Window.partitionBy(*keys).orderBy("_idx").rangeBetween(-window, -1)
    history = F.collect_list(
        F.when(F.col("_seen"), F.struct("_idx", "period", "value", "_complete"))
    ).over(trailing)
    rows = rows.withColumn("_newest", F.reverse(history)).filter("_target")
    run = F.aggregate(
        "_newest",
        F.lit(0),
        lambda n, h: F.when((h["_idx"] == F.col("_idx") - n - 1) & h["_complete"], n + 1).otherwise(n),
    )
    rows = rows.withColumn("_run", run)
    broken_by_partial = F.exists("_newest", lambda h: h["_idx"] == F.col("_idx") - F.col("_run") - 1)
    rows = rows.withColumn(
        "_break",
        F.when(F.col("_run") >= window, F.lit(None))
        .when(broken_by_partial, "incomplete_history")
        .otherwise("non_contiguous_history"),
    ).withColumn("_base", F.reverse(F.slice("_newest", F.lit(1), F.col("_run"))))
    rows = rows.withColumn("_values", F.transform("_base", lambda h: h["value"]))
    enough = F.col("_run") >= minimum_history
    ready = F.coalesce(F.col("_seen") & F.col("_complete") & enough, F.lit(False))
    rows = rows.withColumn("_median", F.when(ready, _median(F.col("_values"))))
    rows = rows.withColumn(
        "_mad",
        F.when(ready, _median(F.transform("_values", lambda v: F.abs(v - F.col("_median"))))),
    )
    score = F.when(
        ready & (F.col("_mad") != 0), F.lit(MAD_SCALE) * (F.col("value") - F.col("_median")) / F.col("_mad")
    )
    rows = rows.withColumn("_score", score)
    hit = F.abs("_score") >= threshold
    status = (
        F.when(F.col("_seen").isNull(), "missing_current_period")
        .when(~F.col("_complete"), "incomplete_current_period")
        .when(~enough, F.coalesce(F.col("_break"), F.lit("insufficient_history")))
        .when(F.col("_mad") == 0, "zero_dispersion")
        .when(hit, "detected")
        .otherwise("not_detected")
    )
    scored = F.col("_score").isNotNull()
    direction = (
        F.when(scored & (F.col("value") > F.col("_median")), "above_baseline")
        .when(scored & (F.col("value") < F.col("_median")), "below_baseline")
        .when(scored, "at_baseline")
    )
    looked = F.col("_seen") & F.col("_complete")
    return rows.select(
        *keys,
        F.col("period").alias("target_period"),
        F.when(F.col("_seen"), F.col("value")).alias("current_value"),
        status.alias("calculation_status"),
        F.when(scored, hit).alias("is_anomaly"),
        direction.alias("direction"),
        F.col("_score").alias("robust_z_score"),
        F.col("_median").alias("baseline_median"),
        F.col("_mad").alias("baseline_mad"),
        F.when(looked, F.col("_run")).otherwise(0).alias("history_months"),
        F.when(looked, F.transform("_base", lambda h: F.struct(h["period"].alias("period"), h["value"].alias("value"))))
        .otherwise(F.slice(F.transform("_base", lambda h: F.struct(h["period"].alias("period"), h["value"].alias("value"))), 1, 0))
        .alias("baseline"),
    )


# --------------------------------------------------------------------------- contribution


def contribution(
    components: DataFrame,
    group: str,
    scope: Sequence[str] = (),
    value: str = "value",
    denominators: DataFrame | None = None,
    tolerance: float = 1e-9,
    completeness: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Shares per group inside each scope, and one reconciliation row per scope.

    ``value`` should be DECIMAL so that totals reconcile exactly. ``denominators`` holds
    ``(*scope, denominator)`` when the total comes from elsewhere; scopes must match exactly.
    Both frames stay at grouped grain: the shares join pre-aggregated scope totals.
    """
    keys = list(scope)
    sums = components.groupBy(*keys).agg(
        F.sum(value).alias("component_sum"),
        F.max(flag(F.col(value) < 0)).alias("has_negative_component"),
        *([F.max(flag(F.col(completeness) == INCOMPLETE)).alias("has_incomplete_period")] if completeness else []),
    )
    if denominators is None:
        sums = sums.withColumn("denominator", F.col("component_sum"))
    elif keys:
        sums = join_on(sums, denominators.select(*keys, "denominator"), keys)
    else:
        sums = sums.withColumn("denominator", denominators.select("denominator").scalar())
    status = (
        F.when(F.col("denominator") == 0, "zero_denominator")
        .when(F.col("denominator") < 0, "non_positive_denominator")
        .otherwise("computed")
    )
    sums = sums.withColumn("calculation_status", status)
    carried = sums.select(*keys, "denominator", "calculation_status")
    if keys:
        rows = join_on(components, carried, keys)
    else:
        rows = components.withColumns(
            {name: carried.select(name).scalar() for name in ("denominator", "calculation_status")}
        )
    share = F.when(
        F.col("calculation_status") == "computed", safe_ratio(F.col(value), F.col("denominator"))
    )
    rows = rows.select(
        *keys,
        F.col(group).alias("group"),
        F.col(value).alias("value"),
        share.alias("contribution"),
        flag(F.col(group) == UNKNOWN).alias("is_unknown_group"),
        "calculation_status",
    )
    gap = F.col("component_sum") - F.col("denominator")
    # The shares add up to component_sum / denominator; taking that ratio of exact sums avoids
    # adding rounded shares.
    total_share = F.when(
        F.col("calculation_status") == "computed",
        safe_ratio(F.col("component_sum"), F.col("denominator")),
    )
    passed = F.coalesce(
        (F.abs(total_share - 1) <= tolerance) & (F.abs(gap.cast("double")) <= tolerance), F.lit(False)
    )
    check = sums.select(
        *keys,
        "component_sum",
        "denominator",
        gap.alias("value_difference"),
        total_share.alias("contribution_sum"),
        "calculation_status",
        flag(passed).alias("passed"),
        "has_negative_component",
        *(["has_incomplete_period"] if completeness else []),
    )
    return rows, check


# What must agree between a numerator and an external denominator.
SCOPE_COLUMNS = ("metric_id", "period", "filters", "status_scope", "amount_basis", "completeness")


def scope_match(numerators: DataFrame, denominators: DataFrame, scope: Sequence[str] = SCOPE_COLUMNS) -> DataFrame:
    """Every numerator scope with its denominator, or with ``scope_mismatch`` when none agrees."""
    left, right = numerators.alias("n"), denominators.withColumn("_found", F.lit(True)).alias("d")
    same = None
    for name in scope:
        test = F.col(f"n.{name}").eqNullSafe(F.col(f"d.{name}"))
        same = test if same is None else same & test
    joined = left.join(right, same, "left")
    return joined.select(
        "n.*",
        F.col("d.denominator").alias("denominator"),
        F.when(F.col("d._found").isNull(), "scope_mismatch").otherwise("matched").alias("scope_status"),
    )


# --------------------------------------------------------------------------- presentation rows


def comparison_evidence(compared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The comparison row then the current row of each target, leaving out absent periods."""
    points = F.array(
        F.struct(
            F.lit(1).alias("position"),
            F.lit("comparison").alias("role"),
            F.col("comparison_period").alias("period"),
            F.col("comparison_value").alias("value"),
            F.col("comparison_completeness").alias("completeness"),
        ),
        F.struct(
            F.lit(2).alias("position"),
            F.lit("current").alias("role"),
            F.col("target_period").alias("period"),
            F.col("current_value").alias("value"),
            F.col("current_completeness").alias("completeness"),
        ),
    )
    return (
        compared.select(*keys, "target_period", F.explode(points).alias("p"))
        .select(*keys, "target_period", "p.*")
        .filter(F.col("value").isNotNull())
        .orderBy(*keys, "target_period", "position")
    )


def contribution_evidence(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return rows.select(*scope, "group", "value", "contribution", "is_unknown_group").orderBy(
        *scope, F.col("value").desc(), "group"
    )


def anomaly_evidence(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Baseline months then the target month, each beside the baseline median."""
    current = F.array(
        F.struct(F.col("target_period").alias("period"), F.col("current_value").alias("value"), F.lit("current").alias("role"))
    )
    baseline = F.transform(
        "baseline",
        lambda h: F.struct(
            h["period"].alias("period"), h["value"].alias("value"), F.lit("baseline_history").alias("role")
        ),
    )
    return (
        scored.select(*keys, "target_period", "baseline_median", F.explode(F.concat(baseline, current)).alias("p"))
        .select(*keys, "target_period", "p.period", "p.value", "p.role", "baseline_median")
        .filter(F.col("value").isNotNull())
        .orderBy(*keys, "target_period", "period")
    )
