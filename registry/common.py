"""Shared pieces of the check SQL."""

from __future__ import annotations

from metricloom.plans.catalog import Period
from metricloom.plans.star import StarSchema, bench_star
from metricloom.sources.tables import spread, table_reader

_KNOWN: dict = {}


def tables(spark, folder):
    """Reader of the bench tables; each schema is inferred once per process.

    The text tables feed regular expressions over whole texts, so they are spread over the cores.
    """
    read = table_reader(spark, folder, _KNOWN)
    keys = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
    return lambda name: spread(read(name), keys[name]) if name in keys else read(name)


def bound_star(spark, folder, open_status: str = "open") -> StarSchema:
    return bench_star(tables(spark, folder), open_status == "unavailable")


# Five whole years inside the 80 months of data; both ends exercise the half-open range.
PERIOD = Period.of("1996-01-01", "2000-12-31")
IN_PERIOD = "ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '2001-01-01'"

MONEY = "DECIMAL(18,4)"


def star(open_status: str = "open") -> str:
    """Common table expressions giving the bench tables their retail roles."""
    return f"""
ship AS (
  SELECT l_orderkey AS oid, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
  FROM lineitem GROUP BY 1),
sales AS (
  SELECT o_orderkey AS oid, o_custkey AS cid, o_orderdate AS ts,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS purchase_month,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'canceled' ELSE '{open_status}' END AS st,
         o_orderdate + INTERVAL 5 DAY AS handed, last_ship AS arrived, first_ship AS approved,
         o_orderdate + INTERVAL 60 DAY AS due
  FROM orders LEFT JOIN ship ON ship.oid = o_orderkey),
line AS (
  SELECT l_orderkey AS oid, l_linenumber AS seq, l_partkey AS pid, l_suppkey AS seller,
         CAST(l_extendedprice AS {MONEY}) AS price, CAST(l_extendedprice * l_tax AS {MONEY}) AS freight
  FROM lineitem),
pay AS (
  SELECT o_orderkey AS oid, o_orderpriority AS payment_type, CAST(o_totalprice AS {MONEY}) AS paid FROM orders),
cust AS (
  SELECT c_custkey AS cid, c_custkey AS person, c_mktsegment AS customer_city, n_name AS customer_state
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
prod AS (
  SELECT p_partkey AS pid, coalesce(nullif(p_type, 'PROMO'), 'unknown') AS product_category FROM part)"""


def amount(expr: str) -> str:
    return f"CAST(round({expr}, 2) AS DOUBLE)"


def ratio(top: str, bottom: str, places: int = 6) -> str:
    return f"round(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0), {places})"
