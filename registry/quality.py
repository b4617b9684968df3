"""Profiles, key and constraint audits, event-order rules, reconciliation, file manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators.quality import (
    check_rules,
    constraint_report,
    duplicate_rows,
    event_order,
    fk_audit,
    key_audit,
    profile,
    quality_report,
    reject_numeric,
    row_reconcile,
    unmatched_reference,
)
from metricloom.sources.files import file_manifest
from registry.common import bound_star, star, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _dirty_orders(spark, folder):
    """The orders table as text, with blanks and unparsable cells where its own values say so."""
    o = tables(spark, folder)("orders")
    return o.select(
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(" ")).otherwise((F.col("o_orderkey") % 9000).cast("string")).alias("id"),
        F.when(F.col("o_custkey") % 50 == 0, F.lit("n/a"))
        .when(F.col("o_custkey") % 50 == 1, F.lit("bad"))
        .otherwise((F.col("o_custkey") - 40).cast("string"))
        .alias("score"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None))
        .when(F.col("o_orderstatus") == "P", F.lit("not-a-date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("event_time"),
        "o_orderpriority",
    )


_DIRTY = """d AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE CAST(o_orderkey % 9000 AS VARCHAR) END AS id,
  CASE o_custkey % 50 WHEN 0 THEN 'n/a' WHEN 1 THEN 'bad' ELSE CAST(o_custkey - 40 AS VARCHAR) END AS score,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'P' THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_time,
  o_orderpriority FROM orders)"""


def _profile(spark, folder):
    shipped = tables(spark, folder)("lineitem").select("l_orderkey").distinct().count()
    return profile(_dirty_orders(spark, folder), ("id",), ("score",), ("event_time",), target_rows=shipped)


_CELL = "SELECT '{c}' AS column_name, '{m}' AS measure, CAST({v} AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM d{w}"
_NUM = "CASE WHEN score <> 'n/a' THEN TRY_CAST(score AS DOUBLE) END"
_PROFILE = [
    ("table", "row_count", "count(*)", ""),
    ("table", "row_count_difference", "(SELECT count(DISTINCT l_orderkey) FROM lineitem) - count(*)", ""),
    ("id", "missing", "0", " LIMIT 1"),
    ("score", "missing", "count(*) FILTER (score = 'n/a')", ""),
    ("event_time", "missing", "count(*) FILTER (event_time IS NULL)", ""),
    ("o_orderpriority", "missing", "count(*) FILTER (o_orderpriority IS NULL)", ""),
    ("score", "invalid", "count(*) FILTER (score = 'bad')", ""),
    ("score", "negative", f"count(*) FILTER ({_NUM} < 0)", ""),
    ("score", "minimum", f"min({_NUM})", ""),
    ("score", "maximum", f"max({_NUM})", ""),
    ("event_time", "invalid", "count(*) FILTER (event_time = 'not-a-date')", ""),
    ("key", "missing", "count(*) FILTER (trim(id) = '')", ""),
    ("key", "duplicate", "count(*) FILTER (trim(id) <> '') - count(DISTINCT trim(id)) FILTER (trim(id) <> '')", ""),
]
QUERIES["quality_profile"] = _profile
ORACLES["quality_profile"] = (
    f"WITH {_DIRTY} "
    + " UNION ALL ".join(f"({_CELL.format(c=c, m=m, v=v, w=w)})" for c, m, v, w in _PROFILE)
    + " UNION ALL ".join(
        [""]
        + [
            f"SELECT 'event_time', '{m}', NULL, strftime({f}(TRY_CAST(event_time AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') FROM d"
            for m, f in (("earliest", "min"), ("latest", "max"))
        ]
    )
)

QUERIES["quality_key_audit_composite"] = lambda spark, folder: key_audit(
    tables(spark, folder)("lineitem"), ("l_orderkey", "l_linenumber")
)
ORACLES["quality_key_audit_composite"] = """SELECT count(*) AS row_count, 0 AS missing_key_rows,
count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem"""
QUERIES["quality_key_audit_text"] = lambda spark, folder: key_audit(_dirty_orders(spark, folder), ("id", "o_orderpriority"))
ORACLES["quality_key_audit_text"] = f"""WITH {_DIRTY}, k AS (SELECT trim(id) AS id, o_orderpriority AS p FROM d)
SELECT count(*) AS row_count, count(*) FILTER (id = '') AS missing_key_rows, count(DISTINCT (id, p)) FILTER (id <> '') AS distinct_keys,
count(*) FILTER (id <> '') - count(DISTINCT (id, p)) FILTER (id <> '') AS duplicate_rows FROM k"""


def _extra(spark, folder):
    lines = tables(spark, folder)("lineitem")
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return duplicate_rows(lines, ("l_orderkey", "l_linenumber"), order).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )


QUERIES["quality_duplicate_rows"] = _extra
ORACLES["quality_duplicate_rows"] = """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn > 1"""


def _reconcile(spark, folder):
    t = tables(spark, folder)
    lines = t("lineitem")
    return row_reconcile(lines, lines.select("l_orderkey", "l_linenumber").distinct(), "lineitem").unionByName(
        row_reconcile(t("orders"), t("orders").select("o_orderkey").distinct(), "orders")
    )


QUERIES["quality_row_reconcile"] = _reconcile
ORACLES["quality_row_reconcile"] = """WITH r AS (
SELECT 'lineitem' AS table_name, (SELECT count(*) FROM lineitem) AS source_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS target_rows
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(DISTINCT o_orderkey) FROM orders))
SELECT *, target_rows - source_rows AS row_count_difference, CAST(target_rows = source_rows AS INTEGER) AS row_count_matches FROM r"""


def _fk(spark, folder):
    t = tables(spark, folder)
    pairs = (
        ("lineitem.l_orderkey", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        ("orders.o_custkey", t("orders"), "o_custkey", t("customer"), "c_custkey"),
        ("events.user_id", t("events").withColumn("user_id", F.expr("CASE WHEN event_id % 7 = 0 THEN -user_id ELSE user_id END")), "user_id", t("orders"), "o_custkey"),
        ("documents.doc_id", t("documents"), "doc_id", t("labels"), "doc_id"),
    )
    out = None
    for name, child, column, parent, key in pairs:
        one = fk_audit(child, column, parent, key).select(F.lit(name).alias("reference"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _fk_sql(name, child, column, parent, key):
    return f"""SELECT '{name}' AS reference, (SELECT count(*) FROM {child}) AS child_rows, (SELECT count(DISTINCT {key}) FROM {parent}) AS parent_keys,
(SELECT count(*) FROM {child} WHERE {column} IS NULL) AS missing_references,
(SELECT count(*) FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})) AS orphan_rows"""


QUERIES["quality_foreign_key_audit"] = _fk
ORACLES["quality_foreign_key_audit"] = " UNION ALL ".join(
    [
        _fk_sql("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        _fk_sql("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
        _fk_sql("events.user_id", "(SELECT CASE WHEN event_id % 7 = 0 THEN -user_id ELSE user_id END AS user_id FROM events)", "user_id", "orders", "o_custkey"),
        _fk_sql("documents.doc_id", "documents", "doc_id", "labels", "doc_id"),
    ]
)


def _soft(spark, folder):
    t = tables(spark, folder)
    events = t("events").select(F.expr("CASE WHEN event_type <> 'view' THEN CASE WHEN event_id % 5 = 0 THEN -user_id ELSE user_id END END AS user_id"))
    return unmatched_reference(events, "user_id", t("orders"), "o_custkey")


QUERIES["quality_soft_reference"] = _soft
ORACLES["quality_soft_reference"] = """WITH e AS (SELECT CASE WHEN event_type <> 'view' THEN CASE WHEN event_id % 5 = 0 THEN -user_id ELSE user_id END END AS u FROM events),
p AS (SELECT DISTINCT o_custkey FROM orders)
SELECT count(*) AS child_rows, count(*) FILTER (u IS NULL) AS missing_references,
count(*) FILTER (u IS NOT NULL AND o_custkey IS NULL) AS unmatched_references, count(*) FILTER (o_custkey IS NOT NULL) AS matched_references
FROM e LEFT JOIN p ON u = o_custkey"""

_RULES = {
    "linenumber_from_1": "l_linenumber >= 1",
    "tax_below_8_percent": "l_tax < 0.08",
    "discount_not_negative": "l_discount >= 0",
    "returned_lines_are_filled": "l_returnflag <> 'R' OR l_linestatus = 'F'",
}
QUERIES["quality_check_rules"] = lambda spark, folder: check_rules(tables(spark, folder)("lineitem"), _RULES)
ORACLES["quality_check_rules"] = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (NOT ({r})) AS violations FROM lineitem" for n, r in _RULES.items()
)


def _constraints(spark, folder):
    t = tables(spark, folder)
    return constraint_report(
        {"orders": t("orders"), "lineitem": t("lineitem")},
        {"orders": ("o_orderkey", "o_orderdate")},
        {"orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber")},
        {"lineitem": {"quantity_below_50": "l_quantity < 50"}},
        (("lineitem", "l_orderkey", "orders", "o_orderkey"),),
    )


QUERIES["quality_constraint_report"] = _constraints
ORACLES["quality_constraint_report"] = """SELECT 'orders' AS table_name, 'o_orderkey not null' AS rule, count(*) FILTER (o_orderkey IS NULL) AS violations FROM orders
UNION ALL SELECT 'orders', 'o_orderdate not null', count(*) FILTER (o_orderdate IS NULL) FROM orders
UNION ALL SELECT 'orders', 'primary key', count(*) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'lineitem', 'quantity_below_50', count(*) FILTER (NOT l_quantity < 50) FROM lineitem
UNION ALL SELECT 'lineitem', 'primary key', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'lineitem', 'l_orderkey references orders', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem"""

_EVENTS = (
    ("approved_before_purchase", "approved_ts", "purchase_ts"),
    ("carrier_before_purchase", "carrier_ts", "purchase_ts"),
    ("customer_delivery_before_purchase", "delivered_ts", "purchase_ts"),
    ("estimated_delivery_before_purchase", "estimated_ts", "purchase_ts"),
    ("customer_delivery_before_carrier", "delivered_ts", "carrier_ts"),
)


def _event_order(spark, folder):
    out = event_order(bound_star(spark, folder).orders, _EVENTS, "order_id")
    return out.withColumn("example_ids", F.concat_ws(",", F.col("example_ids").cast("array<string>")))


_ROLE = {"approved_ts": "approved", "purchase_ts": "ts", "carrier_ts": "handed", "delivered_ts": "arrived", "estimated_ts": "due"}
QUERIES["quality_event_order"] = _event_order
ORACLES["quality_event_order"] = f"WITH {star()} " + " UNION ALL ".join(
    f"""SELECT '{n}' AS rule, '{a} >= {b}' AS expected, count(*) FILTER ({_ROLE[a]} IS NOT NULL AND {_ROLE[b]} IS NOT NULL) AS comparable_rows,
    count(*) FILTER ({_ROLE[a]} < {_ROLE[b]}) AS violations,
    coalesce((SELECT string_agg(CAST(oid AS VARCHAR), ',' ORDER BY oid) FROM (SELECT oid FROM sales WHERE {_ROLE[a]} < {_ROLE[b]} ORDER BY oid LIMIT 5)), '') AS example_ids FROM sales"""
    for n, a, b in _EVENTS
)


def _rejects(spark, folder):
    return reject_numeric(_dirty_orders(spark, folder), "score", "id").groupBy("raw_value", "reason").agg(
        F.count(F.lit(1)).alias("rows")
    )


QUERIES["quality_reject_numeric"] = _rejects
ORACLES["quality_reject_numeric"] = f"""WITH {_DIRTY} SELECT score AS raw_value, 'not_a_number' AS reason, count(*) AS rows
FROM d WHERE TRY_CAST(score AS DOUBLE) IS NULL GROUP BY 1, 2"""


# Tables of the report: columns, key, number and time. Lines have duplicate keys; orders as text have all kinds of faults.
_REPORTED = {
    "orders": ("o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", ("o_orderkey",), "o_totalprice", "o_orderdate"),
    "customer": ("c_custkey c_name c_nationkey c_acctbal c_mktsegment", ("c_custkey",), "c_acctbal", None),
    "events": ("event_id ts user_id event_type value props", ("event_id",), "value", "ts"),
    "lineitem": ("l_orderkey l_linenumber l_discount l_shipdate", ("l_orderkey", "l_linenumber"), "l_discount", "l_shipdate"),
}


def _report(spark, folder):
    t = tables(spark, folder)
    frames = {n: t(n).select(*columns.split()) for n, (columns, _, _, _) in _REPORTED.items()} | {"orders_as_text": _dirty_orders(spark, folder)}
    keys = {n: key for n, (_, key, _, _) in _REPORTED.items()} | {"orders_as_text": ("id",)}
    numbers = {n: (number,) for n, (_, _, number, _) in _REPORTED.items()} | {"orders_as_text": ("score",)}
    times = {n: (time,) for n, (_, _, _, time) in _REPORTED.items() if time} | {"orders_as_text": ("event_time",)}
    return quality_report(frames, keys, numbers, times)


def _reported(table: str) -> str:
    columns, key, number, time = _REPORTED[table]
    cells = [("table", "row_count", "count(*)"), *[(c, "missing", f"count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')") for c in columns.split()]]
    cells += [(number, m, v) for m, v in (("invalid", f"count({number}) - count(TRY_CAST({number} AS DOUBLE))"), ("negative", f"count(*) FILTER ({number} < 0)"), ("minimum", f"min({number})"), ("maximum", f"max({number})"))]
    cells += [(time, "invalid", f"count({time}) - count(TRY_CAST({time} AS TIMESTAMP))")] if time else []
    named = ", ".join(key)
    cells += [("key", "missing", f"count(*) FILTER ({' OR '.join(f'{k} IS NULL' for k in key)})"), ("key", "duplicate", f"count(*) - count(DISTINCT ({named}))")]
    numbers = [f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{m}' AS measure, CAST({v} AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM {table}" for c, m, v in cells]
    texts = [f"SELECT '{table}', '{time}', '{m}', NULL, strftime({f}({time}), '%Y-%m-%d %H:%M:%S') FROM {table}" for m, f in (("earliest", "min"), ("latest", "max")) if time]
    return " UNION ALL ".join([*numbers, *texts])


QUERIES["quality_report"] = _report
ORACLES["quality_report"] = " UNION ALL ".join(map(_reported, _REPORTED)) + (
    f" UNION ALL SELECT 'orders_as_text', * FROM ({ORACLES['quality_profile']}) WHERE measure <> 'row_count_difference'"
)
QUERIES["source_file_manifest"] = lambda spark, folder: file_manifest(spark, folder, "*.parquet")
