"""From an analysis plan to one DataFrame, with the right grain.

Every metric is a formula over *measures*, and every measure is a plain sum. That gives one
physical shape for all of them:

1. Facts with several rows per order are reduced to order grain before they meet orders, so
   no join can multiply an amount (item facts keep their product or seller key when a
   dimension needs it).
2. The sums are collapsed to the few surrogate keys the requested dimensions hang off
   (month, customer, product, seller, payment type). Partial aggregation does this on the map
   side, so a key holding a third of all rows leaves each task as one row.
3. Dimension tables are joined to those collapsed rows, not to the facts, and the rows are
   collapsed once more to the requested dimensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scope import (
    MICROS_PER_DAY,
    before_day,
    elapsed_micros,
    equals_or_in,
    flag,
    in_period,
    month_start,
    safe_ratio,
    unknown_bucket,
)
from metricloom.plans.catalog import (
    CUSTOMER_CITY,
    CUSTOMER_STATE,
    METRICS,
    ORDER_DIMENSIONS,
    PAYMENT_TYPE,
    PRODUCT_CATEGORY,
    PURCHASE_MONTH,
    SELLER,
    AnalysisPlan,
    DimensionFilter,
    Period,
)
from metricloom.plans.star import StarSchema

_CUSTOMER_DIMENSIONS = (CUSTOMER_STATE, CUSTOMER_CITY)


def _total(name: str) -> Column:
    return F.sum(name).alias(name)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _days(micros: str, rows: str) -> Column:
    return safe_ratio(F.col(micros), F.col(rows)) / F.lit(float(MICROS_PER_DAY))


# The measures each metric is computed from.
_MEASURES: dict[str, tuple[str, ...]] = {
    "delivered_gmv": ("price",),
    "delivered_gmv_including_freight": ("price", "freight"),
    "delivered_freight_amount": ("freight",),
    "delivered_item_count": ("item_rows",),
    "delivered_freight_to_gmv_rate": ("price", "freight"),
    "delivered_payment_amount": ("paid",),
    "delivered_order_count": ("delivered_orders",),
    "delivered_average_order_value": ("order_price", "delivered_orders"),
    "average_carrier_delivery_days": ("carrier_micros", "carrier_valid", "carrier_excluded"),
    "invalid_carrier_delivery_sequence_count": ("carrier_invalid",),
    "terminal_order_count": ("terminal_orders",),
    "terminal_cancellation_rate": ("canceled_orders", "terminal_orders"),
    "canceled_order_count": ("canceled_orders",),
    "unavailable_order_count": ("unavailable_orders",),
    "average_items_per_delivered_order": ("order_items", "delivered_orders"),
    "on_time_delivery_rate": ("on_time", "on_time_base"),
    "average_order_delivery_days": ("delivery_micros", "delivery_valid"),
    "delivered_payment_reconciliation_difference": ("order_price", "order_freight", "order_paid"),
}


def _formula(metric_id: str) -> Column:
    c = F.col
    table = {
        "delivered_gmv": lambda: c("price"),
        "delivered_gmv_including_freight": lambda: c("price") + c("freight"),
        "delivered_freight_amount": lambda: c("freight"),
        "delivered_item_count": lambda: c("item_rows"),
        "delivered_freight_to_gmv_rate": lambda: safe_ratio(c("freight"), c("price")),
        "delivered_payment_amount": lambda: c("paid"),
        "delivered_order_count": lambda: c("delivered_orders"),
        "delivered_average_order_value": lambda: safe_ratio(c("order_price"), c("delivered_orders")),
        "average_carrier_delivery_days": lambda: _days("carrier_micros", "carrier_valid"),
        "invalid_carrier_delivery_sequence_count": lambda: c("carrier_invalid"),
        "terminal_order_count": lambda: c("terminal_orders"),
        "terminal_cancellation_rate": lambda: safe_ratio(c("canceled_orders"), c("terminal_orders")),
        "canceled_order_count": lambda: c("canceled_orders"),
        "unavailable_order_count": lambda: c("unavailable_orders"),
        "average_items_per_delivered_order": lambda: safe_ratio(c("order_items"), c("delivered_orders")),
        "on_time_delivery_rate": lambda: safe_ratio(c("on_time"), c("on_time_base")),
        "average_order_delivery_days": lambda: _days("delivery_micros", "delivery_valid"),
        "delivered_payment_reconciliation_difference": lambda: c("order_paid") - c("order_price") - c("order_freight"),
    }
    return table[metric_id]()


# The order rows a metric speaks about; a group without such rows has no result row.
_POPULATION = {
    "terminal_order_count": "terminal_orders",
    "terminal_cancellation_rate": "terminal_orders",
    "canceled_order_count": "canceled_orders",
    "unavailable_order_count": "unavailable_orders",
    "invalid_carrier_delivery_sequence_count": "carrier_invalid",
    "on_time_delivery_rate": "on_time_base",
    "average_order_delivery_days": "delivery_valid",
    "average_carrier_delivery_days": "carrier_base",
}


def shown(column: Column, unit: str, rounded: bool) -> Column:
    """Amounts as doubles with 2 places, rates and days with 6, counts as bigint."""
    if unit == "count":
        return column.cast("bigint")
    if not rounded:
        return column.cast("double")
    return F.round(column, 2 if unit == "amount" else 6).cast("double")


# --------------------------------------------------------------------------- scope


def scoped_orders(star: StarSchema, period: Period | None, with_items: bool = False) -> DataFrame:
    """Orders of the period, on request with the item totals of each (NULL where it has none)."""
    orders = star.orders
    if with_items and star.orders_with_items is not None:
        orders = star.orders_with_items
    elif with_items:
        orders = orders.join(order_totals(star, "items"), "order_id", "left")
    if period is not None:
        orders = orders.filter(in_period(orders, "purchase_ts", period.start, period.end))
    return orders.withColumn(PURCHASE_MONTH, month_start("purchase_ts"))


def _delivered(star: StarSchema, orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == star.statuses.delivered)


def _order_keys(needed: set[str]) -> list[str]:
    keys = [PURCHASE_MONTH] if PURCHASE_MONTH in needed else []
    if needed & set(_CUSTOMER_DIMENSIONS):
        keys.append("customer_id")
    return keys


def _passes(filters: tuple[DimensionFilter, ...]) -> Column | None:
    tests = [equals_or_in(F.col(f.field), f.operator, f.value) for f in filters]
    return reduce(lambda a, b: a & b, tests) if tests else None


def _with_dimensions(frame: DataFrame, star: StarSchema, needed: set[str]) -> DataFrame:
    """Dimension columns by their surrogate keys; unknown products keep their own bucket."""
    geography = [d for d in _CUSTOMER_DIMENSIONS if d in needed]
    if geography:
        frame = frame.join(star.customers.select("customer_id", *geography), "customer_id")
    if PRODUCT_CATEGORY in needed:
        frame = frame.join(star.products, "product_id", "left").withColumn(
            PRODUCT_CATEGORY, unknown_bucket(PRODUCT_CATEGORY)
        )
    return frame


def _collapse(
    frame: DataFrame,
    star: StarSchema,
    keys: list[str],
    needed: set[str],
    plan: AnalysisPlan,
    measures: list[str],
) -> DataFrame:
    sums = [_total(m) for m in measures]
    passes = _passes(plan.filters)
    if needed & {*_CUSTOMER_DIMENSIONS, PRODUCT_CATEGORY}:
        frame = _with_dimensions(frame.groupBy(*keys).agg(*sums), star, needed)
    if passes is not None:
        frame = frame.filter(passes)
    return frame.groupBy(*plan.dimensions).agg(*sums)


# --------------------------------------------------------------------------- grain families


def order_totals(star: StarSchema, source: str) -> DataFrame:
    """One row per order for a fact with several: the only form in which facts meet orders."""
    if source == "items":
        return star.items.groupBy("order_id").agg(
            F.sum("price").alias("price"), F.sum("freight").alias("freight"), F.count("item_seq").alias("item_rows")
        )
    return star.payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))


def _item_measures(star: StarSchema, plan: AnalysisPlan, needed: set[str], measures: list[str]) -> DataFrame:
    keys = _order_keys(needed)
    orders = _delivered(star, scoped_orders(star, plan.period)).select("order_id", *keys)
    item_keys = []
    if PRODUCT_CATEGORY in needed:
        item_keys.append("product_id")
    if SELLER in needed:
        item_keys.append(SELLER)
    if not item_keys:
        rows = orders.join(order_totals(star, "items"), "order_id")
    else:
        items = star.items.withColumnRenamed("seller_id", SELLER).select(
            "order_id", *item_keys, "price", "freight", F.lit(1).alias("item_rows")
        )
        rows = orders.join(items, "order_id")
    return _collapse(rows, star, keys + item_keys, needed, plan, measures)


def _payment_measures(star: StarSchema, plan: AnalysisPlan, needed: set[str], measures: list[str]) -> DataFrame:
    keys = _order_keys(needed)
    orders = _delivered(star, scoped_orders(star, plan.period)).select("order_id", *keys)
    if PAYMENT_TYPE in needed:
        rows = orders.join(
            star.payments.select("order_id", PAYMENT_TYPE, F.col("payment_value").alias("paid")), "order_id"
        )
        keys = keys + [PAYMENT_TYPE]
    else:
        rows = orders.join(order_totals(star, "payments"), "order_id")
    return _collapse(rows, star, keys, needed, plan, measures)


def _order_measures(star: StarSchema, plan: AnalysisPlan, needed: set[str], measures: list[str]) -> DataFrame:
    keys = _order_keys(needed)
    with_items = bool({"order_price", "order_freight", "order_items", "price", "freight", "item_rows"} & set(measures))
    orders = scoped_orders(star, plan.period, with_items)
    s = star.statuses
    delivered = F.col("order_status") == s.delivered
    timed = F.col("delivered_ts").isNotNull()
    handed = timed & F.col("carrier_ts").isNotNull()
    in_order = F.col("delivered_ts") >= F.col("carrier_ts")
    on_time_base = delivered & timed & F.col("estimated_ts").isNotNull()
    sensible = delivered & (F.col("delivered_ts") >= F.col("purchase_ts"))
    wide = "decimal(20,0)"
    columns = {
        "delivered_orders": flag(delivered),
        "canceled_orders": flag(F.col("order_status") == s.canceled),
        "unavailable_orders": flag(F.col("order_status") == s.unavailable),
        "terminal_orders": flag(F.col("order_status").isin(*s.terminal)),
        "carrier_base": flag(delivered & handed),
        "carrier_valid": flag(delivered & handed & in_order),
        "carrier_excluded": flag(delivered & handed & ~in_order),
        "carrier_micros": F.when(
            delivered & handed & in_order, elapsed_micros("carrier_ts", "delivered_ts").cast(wide)
        ),
        "carrier_invalid": flag(handed & (F.col("delivered_ts") < F.col("carrier_ts"))),
        "on_time": flag(on_time_base & (F.col("delivered_ts") <= F.col("estimated_ts"))),
        "on_time_base": flag(on_time_base),
        "delivery_valid": flag(sensible),
        "delivery_micros": F.when(sensible, elapsed_micros("purchase_ts", "delivered_ts").cast(wide)),
        "order_price": F.when(delivered, _zero("price")),
        "order_freight": F.when(delivered, _zero("freight")),
        "order_items": F.when(delivered, _zero("item_rows")),
        "order_paid": F.when(delivered, _zero("paid")),
        # Item and payment amounts that ride along stay NULL where an order has none.
        **{name: F.when(delivered, F.col(name)) for name in ("price", "freight", "item_rows", "paid")},
    }
    statuses: set[str] = set()
    for name in measures:
        if name == "carrier_invalid":
            statuses = set()
            break
        statuses |= {
            "canceled_orders": {s.canceled},
            "unavailable_orders": {s.unavailable},
            "terminal_orders": set(s.terminal),
        }.get(name, {s.delivered})
    if statuses:
        orders = orders.filter(F.col("order_status").isin(*sorted(statuses)))
    if {"order_paid", "paid"} & set(measures):
        orders = orders.join(order_totals(star, "payments"), "order_id", "left")
    rows = orders.select(*keys, *[columns[m].alias(m) for m in measures])
    return _collapse(rows, star, keys, needed, plan, measures)


def _customer_measures(star: StarSchema, plan: AnalysisPlan, needed: set[str], returning: bool) -> DataFrame:
    """Customers, repeat customers and (on request) returning customers per group.

    Orders are counted per order-level customer record first; only those counts meet the
    customer table, which maps them to the real customer.
    """
    month = [PURCHASE_MONTH] if PURCHASE_MONTH in needed else []
    geography = [d for d in _CUSTOMER_DIMENSIONS if d in needed]
    records = (
        _delivered(star, scoped_orders(star, plan.period))
        .groupBy("customer_id", *month)
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    rows = records.join(star.customers.select("customer_id", "customer_unique_id", *geography), "customer_id")
    passes = _passes(plan.filters)
    if passes is not None:
        rows = rows.filter(passes)
    people = rows.groupBy("customer_unique_id", *plan.dimensions).agg(F.sum("orders").alias("orders"))
    measures = [
        F.count(F.lit(1)).alias("customers"),
        F.sum(flag(F.col("orders") >= 2)).alias("repeat_customers"),
    ]
    if returning:
        if plan.period is None:
            raise ValueError("a returning-customer rate needs a bounded period")
        orders = _delivered(star, star.orders)
        history = (
            orders.filter(before_day(orders, "purchase_ts", plan.period.start))
            .select("customer_id")
            .distinct()
            .join(star.customers.select("customer_id", "customer_unique_id"), "customer_id")
            .select("customer_unique_id")
            .distinct()
            .withColumn("seen_before", F.lit(1))
        )
        people = people.join(history, "customer_unique_id", "left")
        measures.append(F.count("seen_before").alias("returning_customers"))
    return people.groupBy(*plan.dimensions).agg(*measures)


_CUSTOMER_FORMULAS = {
    "delivered_customer_count": lambda: F.col("customers"),
    "period_repeat_customer_count": lambda: F.coalesce(F.col("repeat_customers"), F.lit(0)),
    "period_repeat_customer_rate": lambda: safe_ratio(F.col("repeat_customers"), F.col("customers")),
    "historical_returning_customer_rate": lambda: safe_ratio(F.col("returning_customers"), F.col("customers")),
}


def _family_frame(star: StarSchema, plan: AnalysisPlan, family: str, metrics: list[str]) -> DataFrame:
    needed = {*plan.dimensions, *(f.field for f in plan.filters)}
    dims = list(plan.dimensions)
    if family == "customers":
        frame = _customer_measures(
            star, plan, needed, returning="historical_returning_customer_rate" in metrics
        )
        outputs = [
            shown(_CUSTOMER_FORMULAS[m](), METRICS[m].unit, plan.rounded).alias(m) for m in metrics
        ]
        return frame.select(*dims, *outputs)
    measures = list(
        dict.fromkeys(
            [n for m in metrics for n in _MEASURES[m]]
            + [_POPULATION[m] for m in metrics if m in _POPULATION and dims]
            + (list(plan.helpers) if family == "orders" else [])
        )
    )
    build = {"items": _item_measures, "payments": _payment_measures, "orders": _order_measures}[family]
    frame = build(star, plan, needed, measures)
    if family == "orders" and dims:
        # A group exists for a metric only where its population does.
        populated = [F.col(_POPULATION.get(m, "delivered_orders")) > 0 for m in metrics if _POPULATION.get(m, "delivered_orders") in measures]
        if len(populated) == len(metrics):
            frame = frame.filter(reduce(lambda a, b: a | b, populated))
    outputs = [shown(_count_or_null(m), METRICS[m].unit, plan.rounded).alias(m) for m in metrics]
    if "average_carrier_delivery_days" in metrics:
        outputs.append(F.coalesce(F.col("carrier_excluded"), F.lit(0)).cast("bigint").alias("excluded_order_count"))
    helpers = [F.col(h).cast("bigint").alias(h) for h in plan.helpers if h in frame.columns]
    return frame.select(*dims, *outputs, *helpers)


def _count_or_null(metric_id: str) -> Column:
    formula = _formula(metric_id)
    return F.coalesce(formula, F.lit(0)) if METRICS[metric_id].unit == "count" else formula


def compile_plan(star: StarSchema, plan: AnalysisPlan) -> DataFrame:
    """Dimensions plus one column per metric.

    Metrics of one family share one pass over their facts. Families meet as tall rows that are
    regrouped by the dimensions: a union and one small aggregation instead of outer joins.
    """
    plan.validate()
    series = [m for m in plan.metrics if METRICS[m].family == "series"]
    if series:
        if len(plan.metrics) > 1:
            raise ValueError("a series metric is compiled on its own")
        from metricloom.plans.series_metrics import compile_series

        return compile_series(star, plan)
    by_family: dict[str, list[str]] = {}
    for metric_id in plan.metrics:
        by_family.setdefault(METRICS[metric_id].family, []).append(metric_id)
    asked = {*plan.dimensions, *(f.field for f in plan.filters)}
    if asked <= ORDER_DIMENSIONS and len({"items", "payments", "orders"} & set(by_family)) > 1:
        # Without an item or payment dimension all three live at order grain: one pass for them.
        merged = [m for family in ("orders", "items", "payments") for m in by_family.pop(family, [])]
        by_family["orders"] = merged
    frames = [_family_frame(star, plan, family, ids) for family, ids in by_family.items()]
    if len(frames) == 1:
        return frames[0]
    dims = list(plan.dimensions)
    names = [n for frame in frames for n in frame.columns if n not in dims]
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return wide.groupBy(*dims).agg(*[F.max(n).alias(n) for n in names])


def compile_metric(star: StarSchema, metric_id: str, dims=(), filters=(), period=None, **options) -> DataFrame:
    """One metric: ``dims`` columns and ``value``."""
    plan = AnalysisPlan((metric_id,), tuple(dims), tuple(filters), period, **options)
    return compile_plan(star, plan).withColumnRenamed(metric_id, "value")


# --------------------------------------------------------------------------- metric pack


def metric_pack(star: StarSchema, metrics, period: Period | None = None) -> DataFrame:
    """A named set of metrics as (metric_id, value): one pass per grain family, then a stack."""
    plan = AnalysisPlan(tuple(metrics), (), (), period)
    wide = compile_plan(star, plan)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(m).cast("double").alias("value")) for m in metrics])
    )
    return wide.select(pairs.alias("p")).select("p.metric_id", "p.value")
