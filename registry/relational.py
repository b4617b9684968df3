"""Scoping, projection, join and running-total operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scope import (
    capped,
    elapsed_days,
    equals_or_in,
    flag,
    in_period,
    month_start,
    run_named_sql,
    safe_ratio,
    schema_drift,
    scoped_view,
    unknown_bucket,
)
from metricloom.operators.grain import (
    cardinality_report,
    exists_in,
    fanout_report,
    orphans,
    preaggregate_then_join,
)
from metricloom.plans.star import RETAIL_SCHEMAS
from metricloom.session import shared_folder
from metricloom.sources.files import read_records, write_report
from metricloom.sources.loading import load_all, load_dedup, load_table, publish, published
from registry.common import MONEY, amount, bound_star, ratio, star, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _period(spark, folder):
    orders = tables(spark, folder)("orders")
    return orders.filter(in_period(orders, "o_orderdate", "1996-02-29", "1999-12-31")).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


QUERIES["scope_period_filter"] = _period
ORACLES["scope_period_filter"] = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-02-29' AND o_orderdate < TIMESTAMP '2000-01-01'"""


def _eq_in(spark, folder):
    customer = tables(spark, folder)("customer")
    keep = equals_or_in(F.col("c_mktsegment"), "in", ["BUILDING", "MACHINERY"]) | equals_or_in(
        F.col("c_nationkey"), "eq", 3
    )
    return customer.filter(keep).select("c_custkey", "c_mktsegment", "c_nationkey")


QUERIES["scope_equals_or_in"] = _eq_in
ORACLES["scope_equals_or_in"] = """SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey = 3"""

_NAMED = """SELECT count(DISTINCT o_orderkey) AS order_count FROM {orders}
WHERE o_orderstatus = :order_status AND o_orderdate >= CAST(:start_date AS TIMESTAMP_NTZ)
AND o_orderdate < CAST(:end_date_exclusive AS TIMESTAMP_NTZ)"""


def _named(spark, folder):
    params = {"order_status": "F", "start_date": "1996-01-01", "end_date_exclusive": "2001-01-01"}
    return run_named_sql(spark, _NAMED, params, params.keys(), orders=tables(spark, folder)("orders"))


QUERIES["scope_named_parameters"] = _named
ORACLES["scope_named_parameters"] = """SELECT count(DISTINCT o_orderkey) AS order_count FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'"""


def _capped(spark, folder):
    orders = tables(spark, folder)("orders").select("o_orderkey", "o_totalprice")
    return capped(orders, 1000, (F.col("o_totalprice").desc(), F.col("o_orderkey")))


QUERIES["scope_row_cap_with_flag"] = _capped
ORACLES["scope_row_cap_with_flag"] = """SELECT o_orderkey, o_totalprice, (SELECT count(*) > 1000 FROM orders) AS rows_truncated
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000"""

QUERIES["scope_allowed_columns"] = lambda spark, folder: scoped_view(
    tables(spark, folder)("supplier"), ("s_suppkey", "s_name", "s_nationkey"), ("s_nationkey", "s_suppkey")
)
ORACLES["scope_allowed_columns"] = "SELECT s_suppkey, s_nationkey FROM supplier"


def _projections(spark, folder):
    s = bound_star(spark, folder)
    return s.orders.select(
        "order_id",
        month_start("purchase_ts").alias("purchase_month"),
        F.round(elapsed_days("purchase_ts", "delivered_ts"), 6).alias("days"),
        flag(F.col("order_status") == s.statuses.delivered).alias("is_delivered"),
        flag(F.col("delivered_ts") <= F.col("estimated_ts")).alias("is_on_time"),
    )


QUERIES["project_month_days_flags"] = _projections
ORACLES["project_month_days_flags"] = f"""WITH {star()} SELECT oid AS order_id, purchase_month,
round(date_diff('microsecond', ts, arrived) / 86400000000.0, 6) AS days,
CAST(st = 'delivered' AS INTEGER) AS is_delivered, CAST(coalesce(arrived <= due, false) AS INTEGER) AS is_on_time FROM sales"""


def _unknown(spark, folder):
    products = bound_star(spark, folder).products
    return products.select(
        "product_id",
        unknown_bucket("product_category").alias("product_category"),
        flag(F.col("product_category").isNull()).alias("is_unknown"),
    )


QUERIES["project_unknown_bucket"] = _unknown
ORACLES["project_unknown_bucket"] = """SELECT p_partkey AS product_id, CASE p_type WHEN 'PROMO' THEN 'unknown' ELSE p_type END AS product_category,
CAST(p_type = 'PROMO' AS INTEGER) AS is_unknown FROM part"""


def _ratio(spark, folder):
    lines = tables(spark, folder)("lineitem")
    return lines.groupBy("l_returnflag", "l_linenumber").agg(
        F.round(
            safe_ratio(
                F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity").cast("bigint")).otherwise(0)),
                F.sum(F.when(F.col("l_linenumber") > 3, F.col("l_quantity").cast("bigint")).otherwise(0)),
            ),
            6,
        ).alias("quantity_ratio")
    )


QUERIES["project_null_safe_ratio"] = _ratio
ORACLES["project_null_safe_ratio"] = f"""SELECT l_returnflag, l_linenumber,
{ratio('sum(CASE WHEN l_discount > 0.05 THEN CAST(l_quantity AS BIGINT) ELSE 0 END)',
       'sum(CASE WHEN l_linenumber > 3 THEN CAST(l_quantity AS BIGINT) ELSE 0 END)')} AS quantity_ratio
FROM lineitem GROUP BY 1, 2"""

# ---------------------------------------------------------------- joins


def _facts_and_dims(spark, folder):
    s = bound_star(spark, folder)
    return (
        s.orders.select("order_id", "customer_id", "order_status")
        .join(s.payments, "order_id")
        .join(s.customers, "customer_id")
        .select("order_id", "order_status", "payment_type", F.col("payment_value").cast("double").alias("paid"), "customer_state")
    )


QUERIES["join_orders_payments_customers"] = _facts_and_dims
ORACLES["join_orders_payments_customers"] = f"""WITH {star()} SELECT oid AS order_id, o_orderstatus AS order_status, payment_type,
CAST(paid AS DOUBLE) AS paid, customer_state FROM sales JOIN pay USING (oid) JOIN cust USING (cid) JOIN orders ON o_orderkey = oid"""


def _history(spark, folder):
    orders = tables(spark, folder)("orders")
    current = orders.filter(in_period(orders, "o_orderdate", "1998-01-01", "1999-12-31")).select("o_custkey").distinct()
    before = orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast(orders.schema["o_orderdate"].dataType))
    return exists_in(current, before, ("o_custkey",), "seen_before")


QUERIES["join_existence_flag"] = _history
ORACLES["join_existence_flag"] = """SELECT DISTINCT o_custkey,
CAST(o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') AS INTEGER) AS seen_before
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'"""


def _preaggregated(spark, folder):
    s = bound_star(spark, folder)
    joined = preaggregate_then_join(
        s.orders.select("order_id", "order_status"),
        "order_id",
        [
            (s.items, {"gmv": F.sum("price"), "item_rows": F.count("item_seq")}),
            (s.payments, {"paid": F.sum("payment_value")}),
        ],
    )
    return joined.select(
        "order_id",
        "order_status",
        F.col("gmv").cast("double").alias("gmv"),
        F.coalesce("item_rows", F.lit(0)).alias("item_rows"),
        F.col("paid").cast("double").alias("paid"),
    )


QUERIES["join_preaggregated_facts"] = _preaggregated
ORACLES["join_preaggregated_facts"] = f"""WITH {star()},
g AS (SELECT oid, sum(price) AS gmv, count(*) AS n FROM line GROUP BY 1), p AS (SELECT oid, sum(paid) AS paid FROM pay GROUP BY 1)
SELECT oid AS order_id, o_orderstatus AS order_status, CAST(gmv AS DOUBLE) AS gmv, coalesce(n, 0) AS item_rows, CAST(p.paid AS DOUBLE) AS paid
FROM sales JOIN orders ON o_orderkey = oid LEFT JOIN g USING (oid) LEFT JOIN p USING (oid)"""


def _fanout_sides(spark, folder):
    t = tables(spark, folder)
    base = t("customer").select(F.col("c_custkey").alias("user_id"))
    orders = t("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast(MONEY).alias("total"))
    bought = t("events").filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("value").cast(MONEY).alias("value")
    )
    return base, orders, bought


def _fanout(per_key):
    def run(spark, folder):
        base, orders, bought = _fanout_sides(spark, folder)
        out = fanout_report(base, "user_id", (orders, "total"), (bought, "value"), per_key)
        money = [c for c in out.columns if c.endswith("_total")]
        return out.select(
            *[(F.round(c, 2).cast("double") if c in money else F.col(c).cast("bigint")).alias(c) for c in out.columns]
        )

    return run


_FANOUT = f"""WITH o AS (SELECT o_custkey AS user_id, CAST(o_totalprice AS {MONEY}) AS total FROM orders),
e AS (SELECT user_id, CAST(value AS {MONEY}) AS value FROM events WHERE event_type = 'purchase'),
j AS (SELECT c_custkey AS user_id, count(*) AS n, sum(total) AS lt, sum(value) AS rt
  FROM customer JOIN o ON o.user_id = c_custkey JOIN e ON e.user_id = c_custkey GROUP BY 1),
k AS (SELECT c_custkey AS user_id, coalesce(n, 0) AS joined_rows, coalesce(lt, 0) AS jl, coalesce(rt, 0) AS jr,
  coalesce((SELECT sum(total) FROM o WHERE o.user_id = c_custkey), 0) AS tl,
  coalesce((SELECT sum(value) FROM e WHERE e.user_id = c_custkey), 0) AS tr
  FROM customer LEFT JOIN j ON j.user_id = c_custkey)"""
QUERIES["fanout_report_by_customer"] = _fanout(True)
ORACLES["fanout_report_by_customer"] = f"""{_FANOUT} SELECT user_id, CAST(joined_rows AS BIGINT) AS joined_rows,
{amount('jl')} AS joined_left_total, {amount('jr')} AS joined_right_total, {amount('tl')} AS true_left_total, {amount('tr')} AS true_right_total FROM k"""
QUERIES["fanout_report_total"] = _fanout(False)
ORACLES["fanout_report_total"] = f"""{_FANOUT} SELECT count(*) AS base_rows, count(*) FILTER (joined_rows > 1) AS inflated_keys,
CAST(sum(joined_rows) AS BIGINT) AS joined_rows, {amount('sum(jl)')} AS joined_left_total, {amount('sum(jr)')} AS joined_right_total,
{amount('sum(tl)')} AS true_left_total, {amount('sum(tr)')} AS true_right_total FROM k"""


def _cardinality(spark, folder):
    t = tables(spark, folder)
    return cardinality_report(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey")


QUERIES["cardinality_orders_to_lines"] = _cardinality
ORACLES["cardinality_orders_to_lines"] = """WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT count(*) AS parents, count(*) FILTER (n > 0) AS parents_with_children, count(*) FILTER (n = 0) AS parents_without_children,
count(*) FILTER (n > 1) AS parents_with_several, max(n) AS largest_family FROM n"""


def _orphans(spark, folder):
    t = tables(spark, folder)
    return orphans(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey").select("o_orderkey", "o_orderstatus")


QUERIES["orphan_orders_without_lines"] = _orphans
ORACLES["orphan_orders_without_lines"] = """SELECT o_orderkey, o_orderstatus FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""


def _first_wins(spark, folder):
    lines = tables(spark, folder)("lineitem")
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    old = lines.filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    loaded = load_dedup(lines, ("l_orderkey", "l_linenumber"), order, old)
    return loaded.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice")


QUERIES["load_first_row_per_key"] = _first_wins
ORACLES["load_first_row_per_key"] = """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice,
    l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) x
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_shipdate < TIMESTAMP '1996-01-01'
  AND o.l_orderkey = x.l_orderkey AND o.l_linenumber = x.l_linenumber)"""


# ---------------------------------------------------------------- loading and publication, over given tables written as files


def _written(frame, form, **options):
    """The rows of a table as text files in the shared folder, where the loaders find them."""
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/raw-{uuid.uuid4().hex}"
    frame.write.options(**options).format(form).save(path)
    return path


_EVENT_FILE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def _load_table(spark, folder):
    events = tables(spark, folder)("events").select(*_EVENT_FILE.names)
    return load_table(spark, _written(events, "csv", header=True), _EVENT_FILE)


QUERIES["load_table_from_csv"] = _load_table
ORACLES["load_table_from_csv"] = "SELECT event_id, user_id, event_type, value FROM events"


def _sellers(spark, folder):
    """Suppliers as the sellers file, each twice."""
    suppliers = tables(spark, folder)("supplier")
    names = RETAIL_SCHEMAS["dim_sellers"].names
    rows = suppliers.select(F.col("s_suppkey").cast("string"), F.lpad(F.col("s_nationkey").cast("string"), 5, "0"), F.lower("s_name"), F.lit("SP")).toDF(*names)
    return _written(rows.unionByName(rows), "csv", header=True)


def _load_all(spark, folder):
    _, counts = load_all(spark, {"dim_sellers": _sellers(spark, folder)})
    return counts


QUERIES["load_all_reconciled"] = _load_all
ORACLES["load_all_reconciled"] = """SELECT 'dim_sellers' AS table_name, 2 * count(*) AS source_rows, count(*) AS target_rows, -count(*) AS row_count_difference,
0 AS row_count_matches FROM supplier"""


def _published(spark, folder):
    loaded, _ = load_all(spark, {"dim_sellers": _sellers(spark, folder)})
    target = f"{shared_folder(spark).rstrip('/')}/published-{uuid.uuid4().hex}"
    first = publish({"dim_sellers": loaded["dim_sellers"].filter("seller_id = '1'")}, target)
    publish(loaded, target)
    before, after = (published(spark, target, v)["dim_sellers"] for v in (first, None))
    # The version that a reader is pinned to stays as it was.
    return after.join(before.select(F.col("seller_id").alias("_first")), F.col("seller_id") == F.col("_first"), "left").select(*after.columns, F.col("_first").isNotNull().alias("in_first_version"))


QUERIES["load_publish_tables"] = _published
ORACLES["load_publish_tables"] = "SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix, lower(s_name) AS seller_city, 'SP' AS seller_state, s_suppkey = 1 AS in_first_version FROM supplier"


def _records(spark, folder):
    turns = tables(spark, folder)("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), "role", "text")
    return read_records(spark, _written(turns, "json"), T.StructType.fromDDL("record_id string, role string, text string"), "record_id")


QUERIES["load_records_from_json"] = _records
ORACLES["load_records_from_json"] = "SELECT conv_id || '-' || turn AS record_id, role, text FROM conversations"


def _write_report(spark, folder):
    counts = tables(spark, folder)("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"))
    path = f"{shared_folder(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    write_report(counts, path)
    return spark.read.schema(counts.schema).json(path)


QUERIES["load_report_written_as_json"] = _write_report
ORACLES["load_report_written_as_json"] = "SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY 1, 2"


def _drift(spark, folder):
    wanted = T.StructType.fromDDL("doc_id int, text string, lang string, origin string, n_chars bigint")
    return schema_drift(tables(spark, folder)("documents"), wanted)


QUERIES["scope_schema_drift"] = _drift
ORACLES["scope_schema_drift"] = """SELECT * FROM (VALUES ('doc_id', 'type_changed', 'int', 'bigint'), ('origin', 'missing', 'string', NULL), ('source', 'unexpected', NULL, 'string'))
v(column_name, issue, expected_type, actual_type) WHERE EXISTS (SELECT 1 FROM documents)"""
