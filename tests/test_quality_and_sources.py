"""Profiles, audits, loads and publication."""

import contextlib
import datetime as dt
import pathlib
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scope import schema_drift
from metricloom.operators.quality import (
    duplicate_rows,
    event_order,
    fk_audit,
    key_audit,
    profile,
    reject_numeric,
)
from metricloom.plans.star import RETAIL_SCHEMAS
from metricloom.sources.files import csv_shape, file_manifest, read_records, write_report
from metricloom.sources.loading import LoadError, load_all, load_dedup, load_table, publish, published, vacuum, versions


def cells(frame):
    return {(r.column_name, r.measure): r.number if r.text is None else r.text for r in frame.collect()}


def test_profile_of_a_dirty_table(spark):
    df = spark.createDataFrame(
        [("a", "10", "2020-01-01", "ok"), ("a", "-2", "not-a-date", None), ("b", "bad", None, "ok")],
        "id string, price string, event_time string, note string",
    )
    got = cells(profile(df, ("id",), ("price",), ("event_time",), target_rows=2))
    assert got["table", "row_count"] == 3 and got["table", "row_count_difference"] == -1
    assert got["key", "duplicate"] == 1 and got["note", "missing"] == 1
    assert [got["price", m] for m in ("invalid", "negative", "minimum", "maximum")] == [1, 1, -2, 10]
    assert [got["event_time", m] for m in ("missing", "invalid")] == [1, 1]
    assert got["event_time", "earliest"] == "2020-01-01 00:00:00"


def test_event_order(spark):
    t = dt.datetime
    df = spark.createDataFrame(
        [
            ("o001", t(2020, 1, 2), t(2020, 1, 1), t(2020, 1, 3), t(2020, 1, 2), t(2020, 1, 9)),
            ("o002", t(2020, 1, 2), None, None, None, t(2020, 1, 9)),
        ],
        "id string, purchase timestamp, approved timestamp, carrier timestamp, delivered timestamp, due timestamp",
    )
    rules = (("approved_before_purchase", "approved", "purchase"), ("delivery_before_carrier", "delivered", "carrier"), ("due_before_purchase", "due", "purchase"))
    got = {r.rule: r for r in event_order(df, rules, "id").collect()}
    assert (got["approved_before_purchase"].comparable_rows, got["approved_before_purchase"].violations) == (1, 1)
    assert got["approved_before_purchase"].example_ids == ["o001"]
    assert got["delivery_before_carrier"].violations == 1
    assert (got["due_before_purchase"].comparable_rows, got["due_before_purchase"].violations) == (2, 0)


def test_blank_and_repeated_keys(spark):
    df = spark.createDataFrame([("a", "1"), (" a ", "1"), ("", "2"), (None, "3"), ("b", " ")], "k string, n string")
    assert tuple(key_audit(df, ("k",)).first()) == (5, 2, 2, 1)
    assert tuple(key_audit(df, ("k", "n")).first()) == (5, 3, 1, 1)
    parent = spark.createDataFrame([("a",), ("a",), (" ",)], "id string")
    assert tuple(fk_audit(df, "k", parent, "id").first()) == (5, 1, 2, 1)


def test_duplicate_rows_keep_the_first(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2)], "k string, n int")
    assert sorted(r.n for r in duplicate_rows(df, ("k",), F.col("n")).collect()) == [2, 3]


def test_bad_measures_are_reported_with_their_order(spark):
    df = spark.createDataFrame([("o1", "12.5"), ("o2", None), ("o3", "twelve"), ("o4", " ")], "order_id string, price string")
    got = {r.order_id: r.reason for r in reject_numeric(df, "price", "order_id").collect()}
    assert got == {"o2": "absent", "o3": "not_a_number", "o4": "absent"}


FILES = {
    "dim_customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,01,sao paulo,SP\nc2,u1,02,\"rio, de janeiro\",RJ\n",
    "dim_products": ",".join(RETAIL_SCHEMAS["dim_products"].names) + "\np1,toys,1,2,3,4,5,6,7\np2,,,,,,,,\n",
    "dim_sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01,x,SP\n",
    "fact_orders": ",".join(RETAIL_SCHEMAS["fact_orders"].names)
    + "\no1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,,2018-01-03 00:00:00,2018-01-09 00:00:00\n",
    "fact_order_items": ",".join(RETAIL_SCHEMAS["fact_order_items"].names)
    + "\no1,1,p1,s1,2018-01-02 00:00:00,100.50,3.00\no1,1,p1,s1,2018-01-02 00:00:00,999.00,3.00\no1,2,p2,s1,2018-01-02 00:00:00,50,1\n",
    "fact_payments": ",".join(RETAIL_SCHEMAS["fact_payments"].names) + "\no1,1,card,1,154.50\n",
}


@pytest.fixture
def raw(tmp_path):
    paths = {}
    for name, text in FILES.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes("﻿".encode() + text.encode())
        paths[name] = str(path)
    return paths


def test_load_all_and_publish(spark, raw, tmp_path):
    tables, counts = load_all(spark, raw)
    got = {r.table_name: (r.source_rows, r.target_rows, r.row_count_matches) for r in counts.collect()}
    assert got["fact_order_items"] == (3, 2, 0) and got["dim_customers"] == (2, 2, 1)
    items = {r.order_item_id: float(r.price) for r in tables["fact_order_items"].collect()}
    assert items == {1: 100.5, 2: 50.0}
    assert {r.product_id: r.product_category_name for r in tables["dim_products"].collect()} == {"p1": "toys", "p2": None}
    target = str(tmp_path / "store")
    with pytest.raises(LoadError, match="no version yet"):
        published(spark, target)
    assert publish(tables, target) == 1 and published(spark, target)["fact_order_items"].count() == 2
    pinned = published(spark, target)
    fewer = dict(tables, fact_order_items=tables["fact_order_items"].filter("order_item_id = 1"))
    assert publish(fewer, target) == 2
    broken = dict(tables, fact_payments=tables["fact_payments"].withColumn("order_id", F.lit("nowhere")))
    with pytest.raises(LoadError, match="refused"):
        publish(broken, target)
    assert versions(spark, target) == [1, 2] and len(list((tmp_path / "store" / "data").iterdir())) == 2
    assert pinned["fact_order_items"].count() == 2 and published(spark, target)["fact_order_items"].count() == 1
    assert published(spark, target, 1)["fact_order_items"].count() == 2
    assert published(spark, target)["fact_payments"].first().order_id == "o1"
    assert vacuum(spark, target, 1) == [1] and versions(spark, target) == [2] and publish(tables, target) == 3
    with pytest.raises(LoadError, match="no version 1"):
        published(spark, target, 1)


def test_readers_see_one_whole_version_while_publishers_race(spark, tmp_path):
    target = str(tmp_path / "store")

    def tables(n):
        return {name: spark.range(n).select(F.lit(n).alias("n")) for name in ("a", "b")}

    publish(tables(1), target, audit=lambda t: t["a"].limit(0))
    stop, seen, failed = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                now = published(spark, target)
                seen.append({(r.n, name, now[name].count()) for name in now for r in now[name].limit(1).collect()})
            except Exception as error:  # noqa: BLE001 - any failure of a reader counts
                failed.append(error)

    def write(n):
        publish(tables(n), target, audit=lambda t: t["a"].limit(0))
        with contextlib.suppress(LoadError):
            publish(tables(n + 100), target, audit=lambda t: t["a"].limit(1))  # refused

    reader = threading.Thread(target=read)
    reader.start()
    writers = [threading.Thread(target=write, args=(n,)) for n in range(2, 7)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    stop.set()
    reader.join()
    assert not failed and seen and versions(spark, target) == [1, 2, 3, 4, 5, 6]
    for found in seen:
        assert len({n for n, _, _ in found}) == 1 and {name for _, name, _ in found} == {"a", "b"} and all(n == count < 100 for n, _, count in found)


def test_header_must_match(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("seller_id,seller_city,seller_zip_code_prefix,seller_state\ns,1,2,3\n")
    with pytest.raises(LoadError, match="differ"):
        load_table(spark, str(path), RETAIL_SCHEMAS["dim_sellers"])


def test_dedup_skips_stored_keys(spark):
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k int, v string, n int")
    old = spark.createDataFrame([(2,)], "k int")
    assert [(r.k, r.v) for r in load_dedup(new, ("k",), F.col("n"), old).collect()] == [(1, "a")]


def test_manifest_shape_records_and_reports(spark, raw, tmp_path):
    folder = str(pathlib.Path(raw["dim_customers"]).parent)
    import hashlib

    manifest = {r.file_name: r for r in file_manifest(spark, folder, "*.csv").collect()}
    data = pathlib.Path(raw["fact_orders"]).read_bytes()
    assert manifest["fact_orders.csv"].sha256 == hashlib.sha256(data).hexdigest()
    assert manifest["fact_orders.csv"].size_bytes == len(data)
    large = tmp_path / "large.bin"
    large.write_bytes(bytes(range(256)) * (20 << 12))  # more than two read buffers
    assert file_manifest(spark, folder, "large.bin").first().sha256 == hashlib.sha256(large.read_bytes()).hexdigest()
    shape = csv_shape(spark, raw["dim_customers"]).first()
    assert (shape.column_count, shape.row_count) == (5, 2)
    schema = T.StructType.fromDDL("case_id string, n int")
    path = tmp_path / "r.jsonl"
    path.write_text('{"case_id": "a", "n": 1}\n{"case_id": "b", "n": 2}\n')
    assert read_records(spark, str(path), schema, "case_id").count() == 2
    path.write_text('{"case_id": "a"}\n{"case_id": "a"}\n')
    with pytest.raises(ValueError, match="repeated"):
        read_records(spark, str(path), schema, "case_id")
    write_report(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_schema_drift(spark):
    df = spark.createDataFrame([(1, "x")], "a int, c string")
    got = {r.column_name: r.issue for r in schema_drift(df, T.StructType.fromDDL("a bigint, b string")).collect()}
    assert got == {"a": "type_changed", "b": "missing", "c": "unexpected"}
