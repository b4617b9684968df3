"""Equi-joins that treat NULL keys as equal, as grouping does."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; each key appears once, first, as with USING.

    Spark hashes and sorts null-safe equality like any other, so no plan gets slower. Without keys
    the sides are one row each and meet in a cross join.
    """
    if not keys:
        return left.join(right, F.lit(True), how)
    renamed = right.select(*[F.col(k).alias(f"__right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys], F.lit(True).alias("__in_right"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{i}")) for i, k in enumerate(keys)])
    if how != "full":
        return left.join(renamed, same, how).select(*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])
    joined = left.withColumn("__in_left", F.lit(True)).join(renamed, same, "full")
    both = [F.when(F.col("__in_left"), F.col(k)).otherwise(F.col(f"__right_{i}")).alias(k) for i, k in enumerate(keys)]
    return joined.select(*both, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])
