"""The star schema every metric reads, and its binding to concrete tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,4)"


@dataclass(frozen=True)
class Statuses:
    # The order statuses the metrics speak about.
    delivered: str = "delivered"
    canceled: str = "canceled"
    unavailable: str = "unavailable"

    @property
    def terminal(self) -> tuple[str, str, str]:
        return (self.delivered, self.canceled, self.unavailable)


@dataclass(frozen=True)
class StarSchema:
    """Facts and dimensions under role names.

    orders(order_id, customer_id, order_status, purchase_ts, approved_ts, carrier_ts,
    delivered_ts, estimated_ts); items(order_id, item_seq, product_id, seller_id, price,
    freight); payments(order_id, payment_seq, payment_type, payment_value);
    customers(customer_id, customer_unique_id, customer_city, customer_state);
    products(product_id, product_category).

    ``orders.order_id`` is a primary key: tables are published only after the key audit, so
    orders are counted, not re-distinguished, which saves a shuffle of every order id.

    ``orders_with_items``, if a binding has it, is ``orders`` with price, freight and item_rows summed
    over the items of each order, where that costs no further pass over them.
    """

    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    customers: DataFrame
    products: DataFrame
    statuses: Statuses = Statuses()
    orders_with_items: DataFrame | None = None


# The retail tables, their columns, types and keys.
_TEXT, _INT, _TS, _AMOUNT = T.StringType(), T.IntegerType(), T.TimestampNTZType(), T.DecimalType(12, 2)


def _struct(required: dict, optional: dict | None = None, order: list[str] | None = None) -> T.StructType:
    fields = {n: T.StructField(n, t, False) for n, t in required.items()}
    fields |= {n: T.StructField(n, t, True) for n, t in (optional or {}).items()}
    return T.StructType([fields[n] for n in (order or list(fields))])


RETAIL_SCHEMAS: dict[str, T.StructType] = {
    "dim_customers": _struct(
        {
            "customer_id": _TEXT,
            "customer_unique_id": _TEXT,
            "customer_zip_code_prefix": _TEXT,
            "customer_city": _TEXT,
            "customer_state": _TEXT,
        }
    ),
    "dim_products": _struct(
        {"product_id": _TEXT},
        {
            "product_category_name": _TEXT,
            "product_name_lenght": _INT,
            "product_description_lenght": _INT,
            "product_photos_qty": _INT,
            "product_weight_g": _INT,
            "product_length_cm": _INT,
            "product_height_cm": _INT,
            "product_width_cm": _INT,
        },
    ),
    "dim_sellers": _struct(
        {"seller_id": _TEXT, "seller_zip_code_prefix": _TEXT, "seller_city": _TEXT, "seller_state": _TEXT}
    ),
    "fact_orders": _struct(
        {
            "order_id": _TEXT,
            "customer_id": _TEXT,
            "order_status": _TEXT,
            "order_purchase_timestamp": _TS,
            "order_estimated_delivery_date": _TS,
        },
        {
            "order_approved_at": _TS,
            "order_delivered_carrier_date": _TS,
            "order_delivered_customer_date": _TS,
        },
        order=[
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ],
    ),
    "fact_order_items": _struct(
        {
            "order_id": _TEXT,
            "order_item_id": _INT,
            "product_id": _TEXT,
            "seller_id": _TEXT,
            "shipping_limit_date": _TS,
            "price": _AMOUNT,
            "freight_value": _AMOUNT,
        }
    ),
    "fact_payments": _struct(
        {
            "order_id": _TEXT,
            "payment_sequential": _INT,
            "payment_type": _TEXT,
            "payment_installments": _INT,
            "payment_value": _AMOUNT,
        }
    ),
}
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "dim_customers": ("customer_id",),
    "dim_products": ("product_id",),
    "dim_sellers": ("seller_id",),
    "fact_orders": ("order_id",),
    "fact_order_items": ("order_id", "order_item_id"),
    "fact_payments": ("order_id", "payment_sequential"),
}
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("fact_orders", "customer_id", "dim_customers", "customer_id"),
    ("fact_order_items", "order_id", "fact_orders", "order_id"),
    ("fact_order_items", "product_id", "dim_products", "product_id"),
    ("fact_order_items", "seller_id", "dim_sellers", "seller_id"),
    ("fact_payments", "order_id", "fact_orders", "order_id"),
)
GRAINS: dict[str, str] = {
    "dim_customers": "order-level customer record",
    "dim_products": "product",
    "dim_sellers": "seller",
    "fact_orders": "order",
    "fact_order_items": "item sequence inside an order",
    "fact_payments": "payment record inside an order",
}
CHECKS: dict[str, dict[str, str]] = {
    "dim_products": {
        f"{name}_not_negative": f"{name} IS NULL OR {name} >= 0"
        for name in (
            "product_name_lenght",
            "product_description_lenght",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        )
    },
    "fact_order_items": {
        "order_item_id_from_1": "order_item_id >= 1",
        "price_not_negative": "price >= 0",
        "freight_not_negative": "freight_value >= 0",
    },
    "fact_payments": {
        "payment_sequential_from_1": "payment_sequential >= 1",
        "installments_not_negative": "payment_installments >= 0",
        "payment_not_negative": "payment_value >= 0",
    },
}


def retail_star(tables: dict[str, DataFrame]) -> StarSchema:
    """Bind the six retail tables."""
    orders = tables["fact_orders"].select(
        "order_id",
        "customer_id",
        "order_status",
        F.col("order_purchase_timestamp").alias("purchase_ts"),
        F.col("order_approved_at").alias("approved_ts"),
        F.col("order_delivered_carrier_date").alias("carrier_ts"),
        F.col("order_delivered_customer_date").alias("delivered_ts"),
        F.col("order_estimated_delivery_date").alias("estimated_ts"),
    )
    items = tables["fact_order_items"].select(
        "order_id",
        F.col("order_item_id").alias("item_seq"),
        "product_id",
        "seller_id",
        "price",
        F.col("freight_value").alias("freight"),
    )
    payments = tables["fact_payments"].select(
        "order_id", F.col("payment_sequential").alias("payment_seq"), "payment_type", "payment_value"
    )
    customers = tables["dim_customers"].select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state"
    )
    products = tables["dim_products"].select(
        "product_id", F.col("product_category_name").alias("product_category")
    )
    return StarSchema(orders, items, payments, customers, products)


def bench_star(table: Callable[[str], DataFrame], open_is_unavailable: bool = False) -> StarSchema:
    """Bind the order/line/customer/part tables, read by name, to the same roles.

    Status F is delivered and P canceled; O is open, or unavailable on request. Metrics compare
    the stored codes, so a status filter reaches the scan. The delivery time is the last ship
    date of the order; hand-over and estimate are 5 and 60 days after the order date. That
    left join has a unique right side, so Catalyst drops it from plans that read no times.
    """
    raw_orders = table("orders")
    lines = table("lineitem")
    price, freight = F.col("l_extendedprice").cast(MONEY), (F.col("l_extendedprice") * F.col("l_tax")).cast(MONEY)
    # Times and totals of an order come from one aggregate of its lines; a plan reads what it needs of it.
    of_order = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min("l_shipdate").alias("approved_ts"),
        F.max("l_shipdate").alias("delivered_ts"),
        F.sum(price).alias("price"),
        F.sum(freight).alias("freight"),
        F.count("l_linenumber").alias("item_rows"),
    )
    with_items = raw_orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("purchase_ts"),
        (F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("carrier_ts"),
        (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("estimated_ts"),
    ).join(of_order, "order_id", "left")
    orders = with_items.drop("price", "freight", "item_rows")
    items = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("item_seq"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        freight.alias("freight"),
    )
    payments = raw_orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.lit(1).alias("payment_seq"),
        F.col("o_orderpriority").alias("payment_type"),
        F.col("o_totalprice").cast(MONEY).alias("payment_value"),
    )
    nation = table("nation")
    customers = (
        table("customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )
    products = table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.expr("nullif(p_type, 'PROMO')").alias("product_category"),
    )
    statuses = Statuses("F", "P", "O" if open_is_unavailable else "none")
    return StarSchema(orders, items, payments, customers, products, statuses, with_items)
