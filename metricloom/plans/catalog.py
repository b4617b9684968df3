"""What can be asked: metrics, dimensions, and which metric supports which dimension."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from metricloom.functions.scope import as_date

# Dimension ids.
PURCHASE_MONTH = "purchase_month"
PRODUCT_CATEGORY = "product_category"
SELLER = "seller"
CUSTOMER_STATE = "customer_state"
CUSTOMER_CITY = "customer_city"
PAYMENT_TYPE = "payment_type"
DIMENSIONS = (PURCHASE_MONTH, PRODUCT_CATEGORY, SELLER, CUSTOMER_STATE, CUSTOMER_CITY, PAYMENT_TYPE)

ORDER_DIMENSIONS = frozenset({PURCHASE_MONTH, CUSTOMER_STATE, CUSTOMER_CITY})
ITEM_DIMENSIONS = ORDER_DIMENSIONS | {PRODUCT_CATEGORY, SELLER}
PAYMENT_DIMENSIONS = ORDER_DIMENSIONS | {PAYMENT_TYPE}
MONTH_ONLY = frozenset({PURCHASE_MONTH})
MONTH_CATEGORY = frozenset({PURCHASE_MONTH, PRODUCT_CATEGORY})


@dataclass(frozen=True)
class Metric:
    """One governed number.

    ``family`` names the grain it is computed at, ``unit`` decides display rounding
    (amount: 2 places, rate and days: 6 places, count: none).
    """

    metric_id: str
    family: str
    unit: str
    dimensions: frozenset[str]
    meaning: str


# Metric ids and the dimensions each one supports.
_METRICS = (
    Metric("delivered_gmv", "items", "amount", ITEM_DIMENSIONS, "item prices of delivered orders, without freight"),
    Metric("delivered_gmv_including_freight", "items", "amount", ITEM_DIMENSIONS, "item prices plus freight of delivered orders"),
    Metric("delivered_payment_amount", "payments", "amount", PAYMENT_DIMENSIONS, "all payment records of delivered orders"),
    Metric("delivered_customer_count", "customers", "count", ORDER_DIMENSIONS, "real customers with a delivered order"),
    Metric("delivered_order_count", "orders", "count", ORDER_DIMENSIONS, "delivered orders"),
    Metric("delivered_average_order_value", "orders", "amount", ORDER_DIMENSIONS, "item prices per delivered order; an order without items counts as 0"),
    Metric("delivered_category_gmv_contribution", "series", "rate", MONTH_CATEGORY, "category share of item prices in the same scope"),
    Metric("delivered_monthly_gmv", "series", "amount", MONTH_ONLY, "item prices per purchase month with a completeness flag"),
    Metric("delivered_gmv_mom_rate", "series", "rate", MONTH_ONLY, "monthly item prices against the previous calendar month"),
    Metric("delivered_gmv_yoy_rate", "series", "rate", MONTH_ONLY, "monthly item prices against the same month a year earlier"),
    Metric("delivered_monthly_category_gmv_rank", "series", "count", MONTH_CATEGORY, "dense rank of a category inside its month"),
    Metric("average_carrier_delivery_days", "orders", "days", ORDER_DIMENSIONS, "carrier hand-over to delivery, valid delivered orders"),
    Metric("invalid_carrier_delivery_sequence_count", "orders", "count", ORDER_DIMENSIONS, "orders delivered before the carrier hand-over"),
    Metric("terminal_order_count", "orders", "count", ORDER_DIMENSIONS, "orders in a terminal status"),
    Metric("terminal_cancellation_rate", "orders", "rate", ORDER_DIMENSIONS, "canceled share of terminal orders"),
    Metric("canceled_order_count", "orders", "count", ORDER_DIMENSIONS, "canceled orders"),
    Metric("unavailable_order_count", "orders", "count", ORDER_DIMENSIONS, "orders that could not be fulfilled"),
    Metric("delivered_item_count", "items", "count", ITEM_DIMENSIONS, "item rows of delivered orders"),
    Metric("average_items_per_delivered_order", "orders", "rate", ORDER_DIMENSIONS, "item rows per delivered order"),
    Metric("delivered_freight_amount", "items", "amount", ITEM_DIMENSIONS, "freight of delivered orders"),
    Metric("delivered_freight_to_gmv_rate", "items", "rate", ITEM_DIMENSIONS, "freight over item prices"),
    Metric("period_repeat_customer_count", "customers", "count", ORDER_DIMENSIONS, "real customers with two or more delivered orders in the period"),
    Metric("period_repeat_customer_rate", "customers", "rate", ORDER_DIMENSIONS, "repeat customers over customers of the period"),
    Metric("historical_returning_customer_rate", "customers", "rate", ORDER_DIMENSIONS, "period customers with a delivered order before the period"),
    Metric("on_time_delivery_rate", "orders", "rate", ORDER_DIMENSIONS, "delivered no later than estimated"),
    Metric("average_order_delivery_days", "orders", "days", ORDER_DIMENSIONS, "purchase to delivery, valid delivered orders"),
    Metric("delivered_payment_reconciliation_difference", "orders", "amount", ORDER_DIMENSIONS, "payments minus item prices and freight"),
)
METRICS = {metric.metric_id: metric for metric in _METRICS}


@dataclass(frozen=True)
class DimensionFilter:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Period:
    """Inclusive day range; ``end`` is the last included day."""

    start: dt.date
    end: dt.date

    @classmethod
    def of(cls, start, end) -> "Period":
        period = cls(as_date(start), as_date(end))
        if period.start > period.end:
            raise ValueError("period start is after its end")
        return period


@dataclass(frozen=True)
class AnalysisPlan:
    """Metrics by dimensions under filters; ``period`` None means all data."""

    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[DimensionFilter, ...] = ()
    period: Period | None = None
    rounded: bool = True
    helpers: tuple[str, ...] = field(default=())

    def validate(self) -> None:
        if not self.metrics:
            raise ValueError("a plan needs at least one metric")
        unknown = [m for m in self.metrics if m not in METRICS]
        if unknown:
            raise ValueError(f"unknown metrics: {unknown}")
        asked = list(dict.fromkeys([*self.dimensions, *(f.field for f in self.filters)]))
        strange = [d for d in asked if d not in DIMENSIONS]
        if strange:
            raise ValueError(f"unknown dimensions: {strange}")
        for metric_id in self.metrics:
            refused = [d for d in asked if d not in METRICS[metric_id].dimensions]
            if refused:
                raise ValueError(f"metric {metric_id} does not support {refused}")
