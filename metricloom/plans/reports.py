"""Named business reports: a plan, an order with a tie-break, and sometimes a limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators.series import month_scaffold
from metricloom.operators.windows import (
    dataset_bounds,
    month_over_month,
    share_of_partition,
    top_n_per_group,
    year_over_year,
)
from metricloom.plans.catalog import (
    CUSTOMER_CITY,
    CUSTOMER_STATE,
    PAYMENT_TYPE,
    PRODUCT_CATEGORY,
    PURCHASE_MONTH,
    SELLER,
    AnalysisPlan,
    DimensionFilter,
    Period,
)
from metricloom.plans.compiler import _order_measures, compile_plan
from metricloom.plans.series_metrics import monthly_gmv
from metricloom.plans.star import StarSchema


def grouped(
    star: StarSchema,
    metrics: tuple[str, ...] | str,
    dimension: str,
    period: Period | None = None,
    top: int | None = None,
    filters: tuple[DimensionFilter, ...] = (),
) -> DataFrame:
    """Metrics by one dimension. Months run forward; other groups by value, then name."""
    names = (metrics,) if isinstance(metrics, str) else tuple(metrics)
    frame = compile_plan(star, AnalysisPlan(names, (dimension,), filters, period))
    if dimension == PURCHASE_MONTH:
        return frame.orderBy(PURCHASE_MONTH)
    frame = frame.orderBy(F.col(names[0]).desc(), F.col(dimension).asc())
    return frame.limit(top) if top else frame


def category_rank_report(star: StarSchema, period: Period | None, ranks: int = 3) -> DataFrame:
    """Categories holding one of the first dense ranks over the whole period."""
    cube = monthly_gmv(star, period, (PRODUCT_CATEGORY,))
    totals = cube.groupBy(PRODUCT_CATEGORY).agg(F.sum("gmv").alias("gmv"))
    top = top_n_per_group(totals, (), "gmv", ranks, "category_rank")
    return top.select(
        PRODUCT_CATEGORY, F.round("gmv", 2).cast("double").alias("category_gmv"), "category_rank"
    ).orderBy("category_rank", PRODUCT_CATEGORY)


def on_time_by_state(star: StarSchema, period: Period | None, minimum_orders: int = 100, top: int = 10) -> DataFrame:
    """On-time rate where enough orders can be judged."""
    plan = AnalysisPlan(("on_time_delivery_rate",), (CUSTOMER_STATE,), (), period)
    frame = compile_plan(star, AnalysisPlan(plan.metrics, plan.dimensions, (), period, helpers=("on_time_base",)))
    return (
        frame.filter(F.col("on_time_base") >= minimum_orders)
        .drop("on_time_base")
        .orderBy(F.col("on_time_delivery_rate").desc(), CUSTOMER_STATE)
        .limit(top)
    )


def monthly_reconciliation(star: StarSchema, period: Period | None = None) -> DataFrame:
    """Seven amounts per month from one pass over order-grain totals."""
    plan = AnalysisPlan(("delivered_payment_reconciliation_difference",), (PURCHASE_MONTH,), (), period)
    sums = _order_measures(star, plan, {PURCHASE_MONTH}, ["order_price", "order_freight", "order_paid"])
    price, freight, paid = F.col("order_price"), F.col("order_freight"), F.col("order_paid")

    def amount(column, name):
        return F.round(column, 2).cast("double").alias(name)

    return sums.select(
        PURCHASE_MONTH,
        amount(price, "gmv"),
        amount(freight, "freight"),
        amount(paid, "payments"),
        amount(price + freight, "gmv_including_freight"),
        amount(paid - price, "payments_minus_gmv"),
        amount(paid - price - freight, "reconciliation_difference"),
    ).orderBy(PURCHASE_MONTH)


def positive_category_gmv(star: StarSchema, period: Period | None = None) -> DataFrame:
    cube = monthly_gmv(star, period, (PRODUCT_CATEGORY,))
    totals = cube.groupBy(PRODUCT_CATEGORY).agg(F.sum("gmv").alias("gmv")).filter(F.col("gmv") > 0)
    return totals.select(PRODUCT_CATEGORY, F.round("gmv", 2).cast("double").alias("delivered_gmv")).orderBy(
        F.col("delivered_gmv").desc(), PRODUCT_CATEGORY
    )


def state_monthly_gmv(star: StarSchema, state: str, period: Period | None = None) -> DataFrame:
    one = (DimensionFilter(CUSTOMER_STATE, "eq", state),)
    return (
        monthly_gmv(star, period, (), one)
        .select(PURCHASE_MONTH, F.round("gmv", 2).cast("double").alias("metric_value"))
        .orderBy(PURCHASE_MONTH)
    )


def state_monthly_canceled(star: StarSchema, state: str, start: str, months: int) -> DataFrame:
    """Canceled orders of one state on a given calendar; months without any count 0."""
    calendar = month_scaffold(star.orders.sparkSession, start, months)
    last = F.add_months(F.lit(start).cast("date"), months)
    span = star.orders.filter(
        (F.col("purchase_ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("purchase_ts") < last)
    )
    scoped = StarSchema(span, star.items, star.payments, star.customers, star.products, star.statuses)
    counts = compile_plan(
        scoped,
        AnalysisPlan(("canceled_order_count",), (PURCHASE_MONTH,), (DimensionFilter(CUSTOMER_STATE, "eq", state),)),
    )
    return (
        calendar.join(counts, calendar.period == counts[PURCHASE_MONTH], "left")
        .select(
            F.col("period").alias(PURCHASE_MONTH),
            F.coalesce("canceled_order_count", F.lit(0)).cast("bigint").alias("metric_value"),
        )
        .orderBy(PURCHASE_MONTH)
    )


def mom_report(star: StarSchema, boundary: str = "dataset") -> DataFrame:
    bounds = dataset_bounds(star.orders) if boundary == "dataset" else None
    rows = month_over_month(monthly_gmv(star), "gmv", bounds=bounds)
    return rows.select(
        PURCHASE_MONTH,
        F.round("gmv", 2).cast("double").alias("monthly_gmv"),
        "previous_month",
        F.round("previous_value", 2).cast("double").alias("previous_month_gmv"),
        "is_boundary_month",
        "is_previous_month_boundary",
        F.round("mom_rate", 6).alias("mom_rate"),
        "is_comparable",
    ).orderBy(PURCHASE_MONTH)


def yoy_report(star: StarSchema, boundary: str = "dataset") -> DataFrame:
    bounds = dataset_bounds(star.orders) if boundary == "dataset" else None
    rows = year_over_year(monthly_gmv(star), "gmv", bounds=bounds)
    return rows.select(
        PURCHASE_MONTH,
        F.round("gmv", 2).cast("double").alias("monthly_gmv"),
        "previous_year_month",
        F.round("previous_year_value", 2).cast("double").alias("previous_year_month_gmv"),
        "is_boundary_month",
        "is_previous_year_month_boundary",
        F.round("yoy_rate", 6).alias("yoy_rate"),
        "is_comparable",
    ).orderBy(PURCHASE_MONTH)


def category_top_n_report(star: StarSchema, n: int = 3) -> DataFrame:
    cube = monthly_gmv(star, None, (PRODUCT_CATEGORY,))
    top = top_n_per_group(cube, (PURCHASE_MONTH,), "gmv", n, "category_rank")
    return top.select(
        PURCHASE_MONTH,
        PRODUCT_CATEGORY,
        F.round("gmv", 2).cast("double").alias("category_gmv"),
        "category_rank",
    ).orderBy(PURCHASE_MONTH, "category_rank", PRODUCT_CATEGORY)


def category_share_report(star: StarSchema) -> DataFrame:
    cube = monthly_gmv(star, None, (PRODUCT_CATEGORY,))
    shares = share_of_partition(cube, (PURCHASE_MONTH,), "gmv", "category_gmv_contribution")
    return shares.select(
        PURCHASE_MONTH,
        PRODUCT_CATEGORY,
        F.round("gmv", 2).cast("double").alias("category_gmv"),
        F.round("category_gmv_contribution", 6).alias("category_gmv_contribution"),
    ).orderBy(PURCHASE_MONTH, F.col("category_gmv").desc(), PRODUCT_CATEGORY)


# The reports by name: (star, period) -> DataFrame.
REPORTS: dict[str, Callable[[StarSchema, Period | None], DataFrame]] = {
    "orders_by_month": lambda s, p: grouped(s, "delivered_order_count", PURCHASE_MONTH, p),
    "gmv_by_state_top5": lambda s, p: grouped(s, "delivered_gmv", CUSTOMER_STATE, p, 5),
    "category_dense_rank_top3": lambda s, p: category_rank_report(s, p, 3),
    "gmv_by_seller_top10": lambda s, p: grouped(s, "delivered_gmv", SELLER, p, 10),
    "payments_by_type": lambda s, p: grouped(s, "delivered_payment_amount", PAYMENT_TYPE, p),
    "customers_by_state": lambda s, p: grouped(s, "delivered_customer_count", CUSTOMER_STATE, p),
    "cancellation_rate_by_state": lambda s, p: grouped(s, "terminal_cancellation_rate", CUSTOMER_STATE, p),
    "on_time_rate_by_state_min100": lambda s, p: on_time_by_state(s, p),
    "delivery_days_by_state_top5": lambda s, p: grouped(s, "average_order_delivery_days", CUSTOMER_STATE, p, 5),
    "items_by_category_top10": lambda s, p: grouped(s, "delivered_item_count", PRODUCT_CATEGORY, p, 10),
    "freight_rate_by_category_top10": lambda s, p: grouped(s, "delivered_freight_to_gmv_rate", PRODUCT_CATEGORY, p, 10),
    "items_per_order_by_state": lambda s, p: grouped(s, "average_items_per_delivered_order", CUSTOMER_STATE, p),
    "repeat_rate_by_state": lambda s, p: grouped(s, "period_repeat_customer_rate", CUSTOMER_STATE, p),
    "payments_by_city_top10": lambda s, p: grouped(s, "delivered_payment_amount", CUSTOMER_CITY, p, 10),
    "gmv_by_month": lambda s, p: grouped(s, "delivered_gmv", PURCHASE_MONTH, p),
    "payments_by_month": lambda s, p: grouped(s, "delivered_payment_amount", PURCHASE_MONTH, p),
    "freight_by_seller_top10": lambda s, p: grouped(s, "delivered_freight_amount", SELLER, p, 10),
    "gmv_with_freight_by_category_top10": lambda s, p: grouped(s, "delivered_gmv_including_freight", PRODUCT_CATEGORY, p, 10),
    "monthly_reconciliation": lambda s, p: monthly_reconciliation(s, p),
    "late_handover_orders_by_state": lambda s, p: grouped(s, "invalid_carrier_delivery_sequence_count", CUSTOMER_STATE, p),
    "positive_category_gmv": lambda s, p: positive_category_gmv(s, p),
}

