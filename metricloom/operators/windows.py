"""Calendar comparisons, ranks, shares and running totals on grouped output.

Windows here run over months or groups, never over raw facts: the rows of one window
partition are bounded by the calendar or by the number of groups in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.joins import join_on
from metricloom.functions.scope import flag, month_start, safe_ratio

# Blocks whose totals are summed up together.
FANOUT = 1024


def dataset_bounds(orders: DataFrame, ts: str = "purchase_ts") -> tuple[Column, Column]:
    """First and last month of the whole dataset as scalar subqueries over one scan."""
    first = orders.agg(month_start(F.min(ts)).alias("first_month")).scalar()
    last = orders.agg(month_start(F.max(ts)).alias("last_month")).scalar()
    return first, last


def flag_boundary(series: DataFrame, month: str, by: Sequence[str], bounds: tuple[Column, Column] | None) -> DataFrame:
    """Mark the months that may be partial: dataset ends when given, else each series' own ends."""
    if bounds is None:
        whole = Window.partitionBy(*by)
        bounds = (F.min(month).over(whole), F.max(month).over(whole))
    return series.withColumn(
        "is_boundary_month", flag((F.col(month) == bounds[0]) | (F.col(month) == bounds[1]))
    )


def month_over_month(
    series: DataFrame,
    value: str,
    month: str = "purchase_month",
    by: Sequence[str] = (),
    bounds: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Each month beside the row before it; a rate only if that row is the previous calendar month."""
    rows = flag_boundary(series, month, by, bounds)
    in_time = Window.partitionBy(*by).orderBy(month)
    rows = (
        rows.withColumn("previous_month", F.lag(month).over(in_time))
        .withColumn("previous_value", F.lag(value).over(in_time))
        .withColumn("is_previous_month_boundary", F.lag("is_boundary_month").over(in_time))
    )
    adjacent = F.col("previous_month") == F.add_months(month, -1)
    return rows.withColumn(
        "mom_rate", F.when(adjacent, safe_ratio(F.col(value), F.col("previous_value")) - 1)
    ).withColumn(
        "is_comparable",
        flag(adjacent & (F.col("is_boundary_month") == 0) & (F.col("is_previous_month_boundary") == 0)),
    )


def year_over_year(
    series: DataFrame,
    value: str,
    month: str = "purchase_month",
    by: Sequence[str] = (),
    bounds: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Each month beside the same month one year earlier, by an offset join of the series to itself."""
    rows = flag_boundary(series, month, by, bounds)
    earlier = rows.select(
        *by,
        F.add_months(month, 12).alias(month),
        F.col(month).alias("previous_year_month"),
        F.col(value).alias("previous_year_value"),
        F.col("is_boundary_month").alias("is_previous_year_month_boundary"),
    )
    joined = join_on(rows, earlier, [*by, month], "left")
    return joined.withColumn(
        "yoy_rate", safe_ratio(F.col(value), F.col("previous_year_value")) - 1
    ).withColumn(
        "is_comparable",
        flag(
            F.col("previous_year_month").isNotNull()
            & (F.col("is_boundary_month") == 0)
            & (F.col("is_previous_year_month_boundary") == 0)
        ),
    )


def top_n_per_group(df: DataFrame, by: Sequence[str], value: str, n: int, rank: str = "rank") -> DataFrame:
    """Dense rank inside each group on the unrounded value; ties can exceed ``n`` rows.

    The rank filter is planned as a window group limit: each map task forwards only rows that
    can still rank, so one huge group does not reach a single task whole.
    """
    order = Window.partitionBy(*by).orderBy(F.col(value).desc())
    return df.withColumn(rank, F.dense_rank().over(order)).filter(F.col(rank) <= n)


def first_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, position: str) -> DataFrame:
    """Row number inside each group in a total order, with the same early limit as the rank."""
    return df.withColumn(
        position, F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ).filter(F.col(position) <= n)


def share_of_partition(df: DataFrame, by: Sequence[str], value: str, share: str = "share") -> DataFrame:
    """Value over the total of its partition; NULL where the total is 0.

    Totals are a pre-aggregated join rather than a window, so a partition with very many
    groups is never buffered in one task.
    """
    if not by:
        total = df.agg(F.sum(value).alias("t")).scalar()
        return df.withColumn(share, safe_ratio(F.col(value), total))
    totals = df.groupBy(*by).agg(F.sum(value).alias("_partition_total"))
    return (
        join_on(df, totals, list(by))
        .withColumn(share, safe_ratio(F.col(value), F.col("_partition_total")))
        .drop("_partition_total")
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    block: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Cumulative sums along ``order`` for series of any length.

    ``block`` is a non-decreasing function of ``order`` that holds a bounded number of rows per
    value (for a gap-free sequence, its integer quotient). Block totals are pre-aggregated and
    prefixed first, as a tree: runs of ``FANOUT`` blocks have totals of their own, so no task sees
    all blocks of a series. Only then are rows summed inside their own block, so the longest series
    is spread over as many tasks as it has blocks.
    """
    rows = df.withColumn("_block", block)
    for name, column in sums.items():
        rows = rows.withColumn(f"_step_{name}", column)
    totals = rows.groupBy(*by, "_block").agg(
        *[F.sum(f"_step_{name}").alias(f"_total_{name}") for name in sums]
    )
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    totals = totals.select(*keys, F.col("_block").alias("_offset_block"), F.floor(F.col("_block") / FANOUT).alias("_run"), *[f"_total_{n}" for n in sums])
    series = [f"_k{i}" for i in range(len(by))]

    def earlier(frame: DataFrame, within: Sequence[str], place: str) -> dict[str, Column]:
        window = Window.partitionBy(*within).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return {n: F.coalesce(F.sum(f"_total_{n}").over(window), F.lit(0)) for n in sums}

    runs = totals.groupBy(*series, "_run").agg(*[F.sum(f"_total_{n}").alias(f"_total_{n}") for n in sums])
    starts = runs.select(*[F.col(k).alias(f"{k}_run") for k in series], F.col("_run").alias("_of_run"), *[c.alias(f"_start_{n}") for n, c in earlier(runs, series, "_run").items()])
    same_run = F.col("_run") == F.col("_of_run")
    for k in series:
        same_run = same_run & F.col(k).eqNullSafe(F.col(f"{k}_run"))
    inner = totals.withColumns({f"_before_{n}": c for n, c in earlier(totals, [*series, "_run"], "_offset_block").items()})
    offsets = inner.join(starts, same_run).select(
        *series, "_offset_block", *[(F.col(f"_start_{n}") + F.col(f"_before_{n}")).alias(f"_offset_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = F.col("_block") == F.col("_offset_block")
    for i, c in enumerate(by):
        matched = matched & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.select("*", *[F.sum(f"_step_{n}").over(inside).alias(f"_inside_{n}") for n in sums])
    out = rows.join(offsets, matched)
    return out.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_inside_{n}"), F.lit(0)) + F.col(f"_offset_{n}")).alias(n)
            for n in sums
        ],
    )
