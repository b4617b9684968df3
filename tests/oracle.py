"""Run a registered query beside its check SQL and compare rows by value, ignoring order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return str(sorted((str(k), _norm(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([_norm(v) for v in value])
    return str(value) if not isinstance(value, int) else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, run, sql, folder):
    started = time.time()
    frame = run(spark, folder)
    got_names, got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - started
    cursor = con.execute(sql)
    want_names, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}", spent, len(got)
    if got != want:
        extra = [r for r in got if r not in want][:3]
        lost = [r for r in want if r not in got][:3]
        return False, f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {lost}", spent, len(got)
    return True, "", spent, len(got)


if __name__ == "__main__":
    root = pathlib.Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    from metricloom.session import local_session
    from registry import all_oracles, all_queries

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = all_oracles()
    good = bad = 0
    for name, run in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            if name in oracles:
                ok, why, spent, n = compare(spark, con, run, oracles[name], folder)
            else:
                started = time.time()
                n = len(run(spark, folder).collect())
                ok, why, spent = True, "rows only", time.time() - started
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, why, spent, n = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0, 0
        good, bad = good + ok, bad + (not ok)
        print(f"{'ok  ' if ok else 'FAIL'} {spent:6.2f}s {n:7d} {name} {why}", flush=True)
    print(f"{good} ok, {bad} failed")
