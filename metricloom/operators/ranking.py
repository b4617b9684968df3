"""Exact ranks and quantiles of unbounded groups, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.joins import join_on
from metricloom.operators.windows import running_totals
from metricloom.session import written

# Blocks for each shuffle partition of the session, and at most: the cuts of all tasks meet in one.
BLOCKS_PER_PARTITION, MOST_BLOCKS = 32, 4096


def with_value_blocks(df: DataFrame, column: str, name: str, blocks: int | None = None) -> DataFrame:
    """Add a non-decreasing block number of a numeric column with about equal rows per block.

    The cut points are approximate quantiles, as many as the session's shuffle partitions call for, up to
    ``MOST_BLOCKS``: one row of numbers, read as a scalar subquery of the same job. Any cut points give exact
    results; they only balance the work. The rows are written: a filter on the number, as every join has one,
    would be moved below each step of the search and double it, cuts and all, and blocks are found once.
    """
    blocks = blocks or min(MOST_BLOCKS, BLOCKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    halvings = max(1, (blocks - 1).bit_length())
    blocks = 1 << halvings
    cuts = df.agg(F.percentile_approx(column, [i / blocks for i in range(1, blocks)], 4 * blocks).alias("cuts"))
    points, placed = cuts.scalar(), df.withColumn(name, F.lit(0))
    # The number of cuts that are not above the value, by halving. The cuts are no column: no row carries them.
    for step in (1 << i for i in reversed(range(halvings))):
        above = points[F.col(name) + (step - 1)] <= F.col(column)
        placed = placed.withColumn(name, F.col(name) + F.when(above, step).otherwise(0))
    return written(placed)


def cumulative_counts(counts: DataFrame, by: Sequence[str], value: str, names: dict[str, str]) -> DataFrame:
    """Running sums of count columns along ``value``; ``counts`` is already one row per value."""
    blocked = with_value_blocks(counts, value, "_cut_block")
    sums = {out: F.col(source) for out, source in names.items()}
    return running_totals(blocked, by, value, F.col("_cut_block"), sums).drop("_cut_block")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]
) -> DataFrame:
    """Values at given 1-based ranks of each group, ``ranks`` being expressions over ``n``.

    Rows collapse to counts per distinct value first, so repeats of one value cost one row.
    """
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_count")))
    running = cumulative_counts(counts, by, value, {"_upto": "_count"})
    totals = counts.groupBy(*by).agg(F.sum("_count").alias("n"))
    if by:
        placed = join_on(running, totals, list(by))
    else:
        placed = running.withColumn("n", totals.scalar())
    return placed.groupBy(*by, "n").agg(
        *[F.min(F.when(F.col("_upto") >= rank, F.col(value))).alias(name) for name, rank in ranks.items()]
    )
