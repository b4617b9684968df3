"""Scoping predicates and null-safe arithmetic shared by every metric."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000
UNKNOWN = "unknown"


def as_date(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def in_period(df: DataFrame, ts: str, start: dt.date | str, end: dt.date | str) -> Column:
    """Half-open day range on the raw column, so it reaches the scan as a pushed filter.

    ``end`` is the last included day. The bounds take the column's own type: a cast on the
    column side would hide it from parquet statistics and partition pruning.
    """
    first, last = as_date(start), as_date(end)
    if first > last:
        raise ValueError("period start is after its end")
    kind = df.schema[ts].dataType.simpleString()
    low = F.lit(first.isoformat()).cast(kind)
    high = F.lit((last + dt.timedelta(days=1)).isoformat()).cast(kind)
    return (F.col(ts) >= low) & (F.col(ts) < high)


def before_day(df: DataFrame, ts: str, day: dt.date | str) -> Column:
    return F.col(ts) < F.lit(as_date(day).isoformat()).cast(df.schema[ts].dataType.simpleString())


def month_start(ts: Column | str) -> Column:
    return F.trunc(ts, "MM")


def month_index(month: Column | str) -> Column:
    """Months counted on one axis, so calendar neighbours differ by exactly one."""
    return F.year(month) * 12 + F.month(month) - 1


def unknown_bucket(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(UNKNOWN))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is NULL, never an error, when the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def elapsed_micros(start: Column | str, end: Column | str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", start, end)


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    return elapsed_micros(start, end) / F.lit(float(MICROS_PER_DAY))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def equals_or_in(field: Column, operator: str, value) -> Column:
    if operator == "eq":
        if isinstance(value, (list, tuple, set)):
            raise ValueError("eq takes one value")
        return field == F.lit(value)
    if operator == "in":
        if not isinstance(value, (list, tuple, set)) or not value:
            raise ValueError("in takes a non-empty list")
        return field.isin(list(value))
    raise ValueError(f"unknown filter operator: {operator}")


def run_named_sql(spark, sql: str, params: dict, contract: Iterable[str], **frames: DataFrame) -> DataFrame:
    """Run SQL with named parameters whose names must equal the declared contract."""
    names, declared = set(params), set(contract)
    if names != declared:
        raise ValueError(
            f"parameter names differ: missing {sorted(declared - names)}, extra {sorted(names - declared)}"
        )
    return spark.sql(sql, args=params, **frames)


def capped(df: DataFrame, rows: int, order: Sequence[Column]) -> DataFrame:
    """At most ``rows`` rows in a stated order, each carrying whether more existed.

    One top-k of ``rows + 1`` decides both: the extra row only proves truncation.
    """
    if rows < 1:
        raise ValueError("row cap must be positive")
    probe = df.orderBy(*order).limit(rows + 1)
    truncated = probe.agg((F.count(F.lit(1)) > rows).alias("t")).scalar()
    return probe.orderBy(*order).limit(rows).withColumn("rows_truncated", truncated)


def scoped_view(df: DataFrame, allowed: Sequence[str], requested: Sequence[str]) -> DataFrame:
    """Only columns in both the global allow-list and the request; a wider request is an error."""
    wider = [name for name in requested if name not in set(allowed)]
    if wider:
        raise ValueError(f"requested columns outside the allow-list: {wider}")
    absent = [name for name in requested if name not in df.columns]
    if absent:
        raise ValueError(f"requested columns missing from the table: {absent}")
    wanted = set(requested)
    return df.select(*[name for name in allowed if name in wanted])


def schema_drift(df: DataFrame, expected: T.StructType) -> DataFrame:
    """One row per column that is missing, unexpected or of another type; empty means equal.

    Compares table metadata only, so it costs no scan.
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = {f.name: f.dataType.simpleString() for f in expected}
    rows = []
    for name in sorted(set(actual) | set(wanted)):
        if name not in actual:
            rows.append((name, "missing", wanted[name], None))
        elif name not in wanted:
            rows.append((name, "unexpected", None, actual[name]))
        elif actual[name] != wanted[name]:
            rows.append((name, "type_changed", wanted[name], actual[name]))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, issue string, expected_type string, actual_type string"
    )
