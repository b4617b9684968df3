"""Hand-computed stars: every metric family against known values."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from metricloom.operators.grain import fanout_report
from metricloom.plans.catalog import METRICS, AnalysisPlan, DimensionFilter, Period
from metricloom.plans.compiler import compile_metric, compile_plan, metric_pack
from metricloom.plans.reports import (
    category_top_n_report,
    mom_report,
    monthly_reconciliation,
    positive_category_gmv,
    state_monthly_canceled,
    yoy_report,
)
from metricloom.plans.star import RETAIL_SCHEMAS, retail_star


def build(spark, orders, items, payments, customers, products):
    """orders: (id, customer, status, purchase, delivered, carrier); items: (order, seq, product, price, freight)."""
    ts = lambda text: None if text is None else dt.datetime.fromisoformat(text)
    frames = {
        "fact_orders": [
            (o, c, st, ts(p), None, ts(h), ts(d), ts(p) + dt.timedelta(days=4)) for o, c, st, p, d, h in orders
        ],
        "fact_order_items": [
            (o, n, p, "s1", ts("2018-01-01"), Decimal(str(price)), Decimal(str(freight))) for o, n, p, price, freight in items
        ],
        "fact_payments": [(o, n, k, 1, Decimal(str(v))) for o, n, k, v in payments],
        "dim_customers": [(c, u, "0", city, state) for c, u, city, state in customers],
        "dim_products": [(p, cat, *([None] * 7)) for p, cat in products],
    }
    return retail_star({n: spark.createDataFrame(rows, RETAIL_SCHEMAS[n]) for n, rows in frames.items()})


@pytest.fixture(scope="module")
def seven(spark):
    """Seven delivered orders in four categories; freight is a tenth of each price."""
    plan = [
        ("o2017", "2017-01-01", [("A", 100)]),
        ("oa", "2018-01-01", [("A", 60), ("A", 40)]),
        ("ob", "2018-01-02", [("B", 90)]),
        ("oc", "2018-01-03", [("C", 90)]),
        ("od", "2018-01-04", [("D", 80)]),
        ("oe", "2018-02-01", [("A", 40)]),
        ("of", "2018-02-02", [("B", 60)]),
    ]
    orders, items, payments, customers = [], [], [], []
    for o, day, lines in plan:
        later = (dt.date.fromisoformat(day) + dt.timedelta(days=2)).isoformat()
        orders.append((o, f"c-{o}", "delivered", day, later, day))
        customers.append((f"c-{o}", f"u-{o}", "city", "SP"))
        for n, (cat, price) in enumerate(lines, 1):
            items.append((o, n, f"p{cat}", price, price / 10))
        if o == "oa":
            payments += [(o, 1, "card", 50), (o, 2, "voucher", 60)]
        else:
            payments.append((o, 1, "card", sum(p for _, p in lines) * 1.1))
    return build(spark, orders, items, payments, customers, [(f"p{c}", c) for c in "ABCD"])


def value(frame, column="value"):
    return frame.first()[column]


def test_scalars(seven):
    pack = {
        r["metric_id"]: r["value"]
        for r in metric_pack(
            seven,
            (
                "delivered_order_count",
                "delivered_customer_count",
                "delivered_gmv",
                "delivered_gmv_including_freight",
                "delivered_payment_amount",
                "delivered_freight_amount",
                "delivered_average_order_value",
                "terminal_cancellation_rate",
                "on_time_delivery_rate",
                "average_order_delivery_days",
            ),
        ).collect()
    }
    assert pack == {
        "delivered_order_count": 7,
        "delivered_customer_count": 7,
        "delivered_gmv": 560,
        "delivered_gmv_including_freight": 616,
        "delivered_payment_amount": 616,
        "delivered_freight_amount": 56,
        "delivered_average_order_value": 80,
        "terminal_cancellation_rate": 0,
        "on_time_delivery_rate": 1,
        "average_order_delivery_days": 2,
    }


def test_growth_and_ranks(seven):
    mom = {r["purchase_month"].isoformat(): r for r in mom_report(seven).collect()}
    assert mom["2018-02-01"]["mom_rate"] == -0.722222
    assert mom["2018-01-01"]["mom_rate"] is None
    yoy = {r["purchase_month"].isoformat(): r["yoy_rate"] for r in yoy_report(seven).collect()}
    assert yoy == {"2017-01-01": None, "2018-01-01": 2.6, "2018-02-01": None}
    ranks = {
        r["product_category"]: r["category_rank"]
        for r in category_top_n_report(seven, 3).collect()
        if r["purchase_month"].isoformat() == "2018-01-01"
    }
    assert ranks == {"A": 1, "B": 2, "C": 2, "D": 3}


def test_reconciliation_and_fanout(seven):
    january = [r for r in monthly_reconciliation(seven).collect() if r["purchase_month"].isoformat() == "2018-01-01"][0]
    assert (january["gmv"], january["freight"], january["payments"], january["reconciliation_difference"]) == (360, 36, 396, 0)
    base = seven.orders.filter(F.trunc("purchase_ts", "MM") == F.lit("2018-01-01").cast("date")).select("order_id")
    report = fanout_report(base, "order_id", (seven.items, "price"), (seven.payments, "payment_value")).first()
    assert (float(report["joined_left_total"]), float(report["joined_right_total"])) == (460, 506)
    assert (float(report["true_left_total"]), float(report["true_right_total"])) == (360, 396)


@pytest.fixture(scope="module")
def shared(spark):
    """Two customer records of one person, a NULL category and a canceled order."""
    return build(
        spark,
        [
            ("o001", "c001", "delivered", "2018-01-05", "2018-01-09", "2018-01-10"),
            ("o002", "c002", "delivered", "2018-01-06", "2018-01-20", "2018-01-07"),
            ("o003", "c003", "canceled", "2018-03-07", None, None),
            ("o004", "c003", "delivered", "2018-02-07", None, None),
        ],
        [("o001", 1, "p001", 100, 1), ("o001", 2, "p001", 50, 1), ("o002", 1, "p002", 20, 1), ("o003", 1, "p001", 999, 1)],
        [("o001", 1, "card", 152), ("o002", 1, "card", 21)],
        [("c001", "u001", "x", "SP"), ("c002", "u001", "y", "RJ"), ("c003", "u002", "x", "SP")],
        [("p001", "category_a"), ("p002", None)],
    )


def test_real_customers_and_unknown_category(shared):
    january = Period.of("2018-01-01", "2018-01-31")
    assert value(compile_metric(shared, "delivered_order_count", period=january)) == 2
    assert value(compile_metric(shared, "delivered_gmv")) == 170
    assert value(compile_metric(shared, "delivered_average_order_value", period=january)) == 85
    assert value(compile_metric(shared, "delivered_average_order_value")) == round(170 / 3, 2)
    assert value(compile_metric(shared, "delivered_customer_count")) == 2
    assert value(compile_metric(shared, "period_repeat_customer_count")) == 1
    by_state = {r["customer_state"]: r["value"] for r in compile_metric(shared, "period_repeat_customer_rate", ["customer_state"]).collect()}
    assert by_state == {"SP": 0, "RJ": 0}
    categories = {r["product_category"]: r["delivered_gmv"] for r in positive_category_gmv(shared).collect()}
    assert categories == {"category_a": 150, "unknown": 20}


def test_delivery_metrics(shared):
    assert value(compile_metric(shared, "invalid_carrier_delivery_sequence_count")) == 1
    carrier = compile_metric(shared, "average_carrier_delivery_days").first()
    assert (carrier["value"], carrier["excluded_order_count"]) == (13, 1)
    assert value(compile_metric(shared, "on_time_delivery_rate")) == 0.5
    assert value(compile_metric(shared, "terminal_cancellation_rate")) == 0.25
    assert value(compile_metric(shared, "average_items_per_delivered_order")) == 1
    february = Period.of("2018-02-01", "2018-02-28")
    assert value(compile_metric(shared, "historical_returning_customer_rate", period=february)) == 0
    assert value(compile_metric(shared, "delivered_average_order_value", period=february)) == 0


def test_zero_filled_calendar(shared):
    rows = [(r[0].isoformat(), r[1]) for r in state_monthly_canceled(shared, "SP", "2018-02-01", 3).collect()]
    assert rows == [("2018-02-01", 0), ("2018-03-01", 1), ("2018-04-01", 0)]


def test_empty_denominator_is_null(shared):
    assert value(compile_metric(shared, "delivered_freight_to_gmv_rate", period=Period.of("2010-01-01", "2010-12-31"))) is None


def test_filters_and_refusals(shared):
    sp = DimensionFilter("customer_state", "eq", "SP")
    assert value(compile_metric(shared, "delivered_gmv", filters=[sp])) == 150
    with pytest.raises(ValueError, match="does not support"):
        compile_metric(shared, "delivered_payment_amount", ["product_category"])
    with pytest.raises(ValueError, match="unknown metrics"):
        compile_plan(shared, AnalysisPlan(("revenue",)))
    with pytest.raises(ValueError, match="unknown dimensions"):
        compile_plan(shared, AnalysisPlan(("delivered_gmv",), ("marketing_channel",)))
    with pytest.raises(ValueError, match="non-empty"):
        compile_metric(shared, "delivered_gmv", filters=[DimensionFilter("seller", "in", [])]).collect()
    assert len(METRICS) == 27


def test_unused_delivery_join_leaves_the_plan(spark):
    from registry.common import bound_star

    star = bound_star(spark, "/root/testdata/sf0.001")
    frame = compile_metric(star, "delivered_order_count", period=Period.of("1996-01-01", "1996-12-31"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "Join" not in plan
    physical = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in physical
