"""The metrics that are series: monthly value, growth rates, category share and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from metricloom.operators.windows import (
    dataset_bounds,
    flag_boundary,
    month_over_month,
    share_of_partition,
    year_over_year,
)
from metricloom.plans.catalog import PRODUCT_CATEGORY, PURCHASE_MONTH, AnalysisPlan
from metricloom.plans.star import StarSchema


def monthly_gmv(star: StarSchema, period=None, extra=(), filters=()) -> DataFrame:
    """(month, *extra, gmv) with unrounded exact amounts."""
    from metricloom.plans.compiler import _item_measures

    plan = AnalysisPlan(("delivered_gmv",), (PURCHASE_MONTH, *extra), tuple(filters), period, rounded=False)
    plan.validate()
    needed = {*plan.dimensions, *(f.field for f in plan.filters)}
    return _item_measures(star, plan, needed, ["price"]).withColumnRenamed("price", "gmv")


def compile_series(star: StarSchema, plan: AnalysisPlan) -> DataFrame:
    metric = plan.metrics[0]
    from metricloom.plans.compiler import shown
    from metricloom.plans.catalog import METRICS

    unit = METRICS[metric].unit
    if metric in ("delivered_category_gmv_contribution", "delivered_monthly_category_gmv_rank"):
        by = [d for d in plan.dimensions if d == PURCHASE_MONTH]
        extra = (PRODUCT_CATEGORY,)
        cube = monthly_gmv(star, plan.period, extra, plan.filters)
        if not by:
            cube = cube.groupBy(PRODUCT_CATEGORY).agg(F.sum("gmv").alias("gmv"))
        if metric.endswith("rank"):
            order = Window.partitionBy(*by).orderBy(F.col("gmv").desc())
            out = cube.withColumn(metric, F.dense_rank().over(order))
        else:
            out = share_of_partition(cube, by, "gmv", metric)
        return out.select(*by, PRODUCT_CATEGORY, shown(F.col(metric), unit, plan.rounded).alias(metric))
    series = monthly_gmv(star, plan.period, (), plan.filters)
    bounds = dataset_bounds(star.orders)
    if metric == "delivered_monthly_gmv":
        out = flag_boundary(series, PURCHASE_MONTH, (), bounds).withColumn(metric, F.col("gmv"))
        return out.select(PURCHASE_MONTH, shown(F.col(metric), unit, plan.rounded).alias(metric), "is_boundary_month")
    if metric == "delivered_gmv_mom_rate":
        out = month_over_month(series, "gmv", bounds=bounds).withColumn(metric, F.col("mom_rate"))
    else:
        out = year_over_year(series, "gmv", bounds=bounds).withColumn(metric, F.col("yoy_rate"))
    return out.select(PURCHASE_MONTH, shown(F.col(metric), unit, plan.rounded).alias(metric), "is_comparable")
