"""Joins that keep the grain: pre-aggregation, fan-out and cardinality reports, existence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scope import flag


def preaggregate_then_join(
    base: DataFrame, key: str, facts: Sequence[tuple[DataFrame, dict[str, Column]]]
) -> DataFrame:
    """Left-join several many-side facts to a base, each reduced to one row per key first.

    Map-side partial aggregation shrinks a hot key to one row per task before the shuffle, and
    every join after it is one-to-one, so no fact can multiply another.
    """
    out = base
    for fact, aggregates in facts:
        reduced = fact.groupBy(key).agg(*[column.alias(name) for name, column in aggregates.items()])
        out = out.join(reduced, key, "left")
    return out


def fanout_report(
    base: DataFrame,
    key: str,
    left: tuple[DataFrame, str],
    right: tuple[DataFrame, str],
    per_key: bool = False,
) -> DataFrame:
    """What a direct three-way join would report beside the true totals.

    Each side is reduced to (rows, total) per key; a joined row count is the product of the two
    row counts and a joined total is the total times the other side's rows, so the inflated
    join is measured without ever being produced.
    """

    def reduced(side, name):
        fact, amount = side
        return fact.groupBy(key).agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), F.sum(amount).alias(f"{name}_total")
        )

    rows = base.select(key).join(reduced(left, "left"), key, "left").join(reduced(right, "right"), key, "left")
    l_n, r_n = F.coalesce("left_rows", F.lit(0)), F.coalesce("right_rows", F.lit(0))
    l_t, r_t = F.coalesce("left_total", F.lit(0)), F.coalesce("right_total", F.lit(0))
    rows = rows.select(
        key,
        (l_n * r_n).alias("joined_rows"),
        F.when(r_n > 0, l_t * r_n.cast("decimal(20,0)")).otherwise(F.lit(0)).alias("joined_left_total"),
        F.when(l_n > 0, r_t * l_n.cast("decimal(20,0)")).otherwise(F.lit(0)).alias("joined_right_total"),
        l_t.alias("true_left_total"),
        r_t.alias("true_right_total"),
    )
    if per_key:
        return rows
    names = rows.columns[1:]
    return rows.agg(
        F.count(F.lit(1)).alias("base_rows"),
        F.sum(flag(F.col("joined_rows") > 1)).alias("inflated_keys"),
        *[F.sum(n).alias(n) for n in names],
    )


def cardinality_report(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """How many parents have no, one or several children, and the largest family."""
    sizes = child.groupBy(F.col(child_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    joined = parent.select(F.col(parent_key).alias("_key")).distinct().join(sizes, "_key", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("parents"),
        F.sum(flag(n > 0)).alias("parents_with_children"),
        F.sum(flag(n == 0)).alias("parents_without_children"),
        F.sum(flag(n > 1)).alias("parents_with_several"),
        F.max(n).alias("largest_family"),
    )


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key exists in no parent. NULL keys are missing, not orphaned."""
    known = parent.select(F.col(key).alias("_parent_key"))
    return child.filter(F.col(foreign_key).isNotNull()).join(
        known, F.col(foreign_key) == F.col("_parent_key"), "left_anti"
    )


def exists_in(df: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """0/1 column telling whether the key occurs in ``other``; rows are never multiplied."""
    seen = other.select(*keys).distinct().withColumn(name, F.lit(1))
    return df.join(seen, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))
