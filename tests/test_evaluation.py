"""Result comparison against exhaustive matching, intervals, bootstrap, ledgers, logs, streams."""

import datetime as dt
import hashlib
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import result_diff
from metricloom.operators.ledger import changed_rows, first_breaches, input_hash, seal, sequence_audit, usage_ledger, verify_seal
from metricloom.operators.matching import maximum_matching
from metricloom.operators.ranking import MOST_BLOCKS, exact_quantiles, with_value_blocks
from metricloom.operators.result_diff import DiffRules, diff_results, unmatched_rows
from metricloom.operators.scoring import _drawn, md5_words, operational_summary, paired_difference, wilson
from metricloom.streaming.ledger import stream_first_breaches
from metricloom.streaming.logs import read_log_stream, run_available, stream_first_seen, stream_usage

RULES = DiffRules(("period", "value", "note"), {"value": (1e-6, 1e-9)}, position="n")


def verdict(spark, expected, actual, schema_e, schema_a, rules=RULES):
    return diff_results(spark.createDataFrame(expected, schema_e), spark.createDataFrame(actual, schema_a), rules).first()


def test_types_and_nulls(spark):
    text = "n int, period string, value double, note string"
    ok = verdict(spark, [(1, "2018-07-01", 1.0, None)], [(None, Decimal("1.0000004"), dt.date(2018, 7, 1), 1)], text, "note string, value decimal(12,7), period date, n int")
    assert (ok.result_correct, ok.issues) == (1, "")
    assert verdict(spark, [(1, "p", 1.0, None)], [(1, "p", 1.0, 0)], text, "n int, period string, value double, note int").result_correct == 0
    assert verdict(spark, [(1, "p", 1.0, "x")], [(1, "p", True, "x")], text, "n int, period string, value boolean, note string").result_correct == 0
    assert verdict(spark, [(1, "p", None, "x")], [(1, "p", 0.0, "x")], text, text).issues == "row_value_mismatch"
    assert verdict(spark, [(1, "p", float("nan"), "x")], [(1, "p", float("nan"), "x")], text, text).result_correct == 0
    lost = verdict(spark, [(1, "p", 1.0, None)], [(1, "p", 1.0)], text, "n int, period string, value double")
    assert (lost.columns_correct, lost.values_correct) == (0, 0)


def test_order_and_duplicates(spark):
    text = "n int, period string, value double, note string"
    rows = [(1, "2018-06-01", 1.0, None), (2, "2018-07-01", 2.0, None)]
    swapped = [(2, *rows[0][1:]), (1, *rows[1][1:])]
    r = verdict(spark, rows, swapped, text, text)
    assert (r.values_correct, r.order_correct, r.issues) == (1, 0, "row_order_mismatch")
    unordered = DiffRules(RULES.columns, RULES.tolerance)
    short = "period string, value double, note string"
    r = verdict(spark, [("a", 1.0, None)] * 2, [("a", 1.0, None), ("a", 2.0, None)], short, short, unordered)
    assert (r.row_count_correct, r.values_correct) == (1, 0)


def brute_matching(edges, wanted, offered):
    """Copies of wanted rows that stay over, by one augmenting path after another."""
    units_e = [i for i, n in wanted.items() for _ in range(n)]
    units_a = [j for j, n in offered.items() for _ in range(n)]
    matched = {}

    def place(u, seen):
        for v, j in enumerate(units_a):
            if v not in seen and (units_e[u], j) in edges:
                seen.add(v)
                if v not in matched or place(matched[v], seen):
                    matched[v] = u
                    return True
        return False

    return sum(not place(u, set()) for u in range(len(units_e)))


@pytest.mark.parametrize("seed", range(4))
def test_matching_is_maximum(spark, seed):
    rng = random.Random(seed)
    wanted = {i: rng.choice([1, 1, 2, 3]) for i in range(14)}
    offered = {j: rng.choice([1, 1, 2, 3]) for j in range(100, 114)}
    edges = {(rng.choice(list(wanted)), rng.choice(list(offered))) for _ in range(26)}
    if seed == 3:  # a path that greedy rounds are likely to block, and one that they cannot
        wanted, offered = {i: 1 for i in range(8)}, {100 + i: 1 for i in range(8)}
        edges = {(i, 100 + i) for i in range(8)} | {(i, 101 + i) for i in range(7)}
    frames = [spark.createDataFrame(list(x.items()), f"{k} bigint, n bigint") for k, x in (("e_id", wanted), ("a_id", offered))]
    # Distances that lure the first round away from a full matching.
    rows = [(e, a, float(100 + e - a) + 10.0) for e, a in edges]
    over = maximum_matching(spark.createDataFrame(rows, "e_id bigint, a_id bigint, distance double"), *frames).collect()
    assert sum(r["room"] for r in over) == brute_matching(edges, wanted, offered)
    assert all(0 < r["room"] <= wanted[r["e_id"]] for r in over)


def test_a_dense_chain_with_an_outlier_is_spread_over_cells(spark):
    """Rows closer than the tolerance to their neighbours, all linked, and one value a billion times as large."""
    n = 20_000
    rows = spark.range(n).select((F.col("id") * 0.004).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    outlier = spark.createDataFrame([(1e12, 1.0)], "x double, y double")
    rules = DiffRules(("x", "y"), {"x": (0.01, 1e-9), "y": (0.5, 0.0)})
    expected = rows.union(outlier)
    # Rows with a 3 move past their neighbours in x, so the sorted rows do not pair up.
    actual = rows.select((F.col("x") + F.when(F.col("y") == 3, 0.009).otherwise(0.001)).alias("x"), "y").union(outlier)
    assert diff_results(expected, actual, rules).first().result_correct == 1
    dirty = rows.select("x", F.lit("g").alias("_g"), F.monotonically_increasing_id().alias("_node"), F.lit(1).alias("e"), F.lit(1).alias("a"))
    cells = dirty.union(outlier.select("x", F.lit("g"), F.lit(-1).cast("long"), F.lit(1), F.lit(1))).groupBy(result_diff._cell(F.col("x"), (0.01, 1e-9))).count()
    assert cells.agg(F.max("count")).first()[0] < 10


@pytest.mark.parametrize("tolerance", [(0.5, 0.0), (0.0, 0.01), (1e-3, 0.01), (1e-9, 0.3), (0.0, 0.0), (0.0, 1e-12), (2.0, 0.95)])
def test_close_values_are_in_neighbouring_cells(spark, tolerance):
    rng = random.Random(1)
    absolute, relative = tolerance
    pairs = []
    for _ in range(400):
        x = rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) * rng.choice([0, 1, 1, 1])
        reach = max(absolute, relative * abs(x))
        pairs += [(x, x + reach * rng.uniform(-1, 1)), (x, x * (1 - relative)), (x, x + absolute)]
    frame = spark.createDataFrame(pairs, "x double, y double").filter(result_diff._close(F.col("x"), F.col("y"), tolerance))
    apart = frame.filter(F.abs(result_diff._cell(F.col("x"), tolerance) - result_diff._cell(F.col("y"), tolerance)) > 1)
    assert apart.collect() == [] and frame.count() > 100


def test_unmatched_rows(spark):
    expected = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("a", 2.0, 5.0), ("b", None, 1.0), ("c", float("nan"), 0.0)], "k string, x double, y double")
    actual = spark.createDataFrame([("a", 1.05, 1.0), ("a", 2.0, 5.3), ("b", None, 1.0), ("c", float("nan"), 0.0)], "k string, x double, y double")
    rules = DiffRules(("k", "x", "y"), {"x": (0.1, 0.0), "y": (0.1, 0.0)})
    got = sorted((r["k"], str(r["x"]), r["y"], r["unmatched"]) for r in unmatched_rows(expected, actual, rules).collect())
    assert got == [("a", "1.0", 1.0, 1), ("a", "2.0", 5.0, 1), ("c", "nan", 0.0, 1)]
    exact = DiffRules(("k",))
    over = unmatched_rows(expected.select("k"), actual.select("k"), exact).collect()
    assert [(r["k"], r["unmatched"]) for r in over] == [("a", 1)]


def full_pairing(expected, actual, close):
    matched = {}

    def place(i, seen):
        for j, a in enumerate(actual):
            if j not in seen and close(expected[i], a):
                seen.add(j)
                if j not in matched or place(matched[j], seen):
                    matched[j] = i
                    return True
        return False

    return len(expected) == len(actual) and all(place(i, set()) for i in range(len(expected)))


@pytest.mark.parametrize("numbers", [1, 2])
def test_pairing_matches_exhaustive_search(spark, numbers, monkeypatch):
    monkeypatch.setattr(result_diff, "RANKS_PER_BLOCK", 3)
    random.seed(numbers)
    names = [f"v{i}" for i in range(numbers)]
    tolerance = {n: (0.5, 0.0) for n in names}
    left, right, want = [], [], {}
    for case in range(40):
        size = random.randint(1, 6)
        e = [tuple(random.randint(0, 6) / 2 for _ in names) for _ in range(size)]
        a = [tuple(x + random.choice([-0.5, 0, 0.5, 0.5]) for x in row) for row in e]
        if case % 4 == 0:
            a[0] = tuple(x + 1 for x in a[0])
        random.shuffle(a)
        left += [(case, *row) for row in e]
        right += [(case, *row) for row in a]
        want[case] = int(full_pairing(e, a, lambda p, q: all(abs(x - y) <= 0.5 for x, y in zip(p, q))))
    schema = "case int, " + ", ".join(f"{n} double" for n in names)
    out = diff_results(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), DiffRules(tuple(names), tolerance), by=("case",))
    assert {r.case: r.values_correct for r in out.collect()} == want
    assert 0 < sum(want.values()) < 40


@pytest.mark.parametrize("tolerance", [(0.5, 0.0), (0.0, 0.3)])
def test_pairing_in_classes_matches_exhaustive_search(spark, tolerance, monkeypatch):
    """Every column is searched for classes: some fall apart, some are chains, signs and sizes differ."""
    monkeypatch.setattr(result_diff, "ROWS_PER_CELL", 0)
    rng = random.Random(7)
    absolute, relative = tolerance
    left, right, want = [], [], {}

    def near(x, y):
        return x == y or abs(x - y) <= max(relative * max(abs(x), abs(y)), absolute)

    for case in range(60):
        size = rng.randint(1, 6)
        e = [(rng.randint(0, 6) / 2, rng.choice([-8.0, -1.0, 0.25, 3.0, 3.5, 50.0])) for _ in range(size)]
        a = [tuple(x * (1 + rng.choice([-0.2, 0, 0.2])) if relative else x + rng.choice([-0.5, 0, 0.5]) for x in row) for row in e]
        if case % 5 == 0:
            a[0] = (a[0][0], 9.0)
        rng.shuffle(a)
        left += [(case, *row) for row in e]
        right += [(case, *row) for row in a]
        want[case] = int(full_pairing(e, a, lambda p, q: all(near(x, y) for x, y in zip(p, q))))
    schema = "case int, x double, y double"
    out = diff_results(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), DiffRules(("x", "y"), {"x": tolerance, "y": tolerance}), by=("case",))
    assert {r.case: r.values_correct for r in out.collect()} == want
    assert 0 < sum(want.values()) < 60


def test_a_chain_whose_other_column_falls_apart_needs_no_matching(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("sorted pairing decides")

    monkeypatch.setattr(result_diff, "maximum_matching", refuse)
    rows = spark.range(2000).select((F.col("id") * 0.004).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    actual = rows.select((F.col("x") + F.when(F.col("y") == 3, 0.009).otherwise(0.001)).alias("x"), "y")
    rules = DiffRules(("x", "y"), {"x": (0.01, 1e-9), "y": (0.5, 0.0)})
    assert diff_results(rows, actual, rules).first().result_correct == 1
    swapped = actual.withColumn("y", F.when(F.col("x") < 0.003, 1.0).otherwise(F.col("y")))
    assert diff_results(rows, swapped, rules).first().result_correct == 0


def test_cuts_of_value_blocks_do_not_grow_with_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(20_000, numPartitions=4).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", 600)
    try:
        blocks = with_value_blocks(rows, "v", "b").localCheckpoint()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 1000 < blocks.agg(F.max("b")).first()[0] < MOST_BLOCKS
    found = blocks.groupBy("b").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    assert all(x.high < y.low for x, y in zip(found, found[1:])) and max(r.n for r in found) < 30


def test_plans_over_value_blocks_do_not_double_with_each_cut(spark):
    """A join on the number of a block brings a filter, which was moved below each step of its search."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 500).cast("double").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", 128)
    try:
        found = exact_quantiles(rows, ("g",), "v", {"least": F.lit(1)})
        shown = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert shown.count("percentile_approx") <= 12
    assert {(r.g, r.n, r.least) for r in found.collect()} == {(g, len(range(g, 500, 3)), min(i * 7 % 500 for i in range(g, 500, 3))) for g in range(3)}


def test_wilson(spark):
    df = spark.createDataFrame([(60, 60), (0, 5), (26, 52), (0, 0)], "k int, n int")
    rows = [tuple(r) for r in df.select(*wilson("k", "n")).collect()]
    assert rows[0][0] == rows[0][2] == 1 and 0 < rows[0][1] < 1
    assert rows[1][1] == 0 and rows[3] == (None, None, None)
    assert rows[2][1] == pytest.approx(1 - rows[2][2]) and rows[2][1] == pytest.approx(0.3689, abs=1e-3)


def test_exact_quantiles_and_summary(spark):
    random.seed(9)
    values = [float(random.choice([7, 7, 7, random.randint(1, 500)])) for _ in range(999)]
    df = spark.createDataFrame([(v, 1 if v > 9 else None, "USD") for v in values], "v double, t int, c string")
    ordered = sorted(values)
    got = exact_quantiles(df, (), "v", {"p95": F.ceil(F.col("n") * 95 / 100), "low": F.lit(1)}).first()
    assert (got.p95, got.low, got.n) == (ordered[949], ordered[0], 999)
    r = operational_summary(df, (), "v", ("t",), "t", "c").first()
    assert (r.median_latency, r.p95_latency, r.t_total, r.currency) == (ordered[499], ordered[949], None, "USD")


def test_draws_are_those_of_one_hash_after_the_other():
    texts = [f"{seed}|{b}|{q}".encode() for seed, b, q in ((15015, 7, 1234), (15015, 9, 9999), (15015, 0, 1000))]
    words = md5_words(np.array([list(t) for t in texts], np.uint8))
    assert ["".join(f"{int(x):08x}" for x in row) for row in words] == [hashlib.md5(t).hexdigest() for t in texts]
    n, down, up, total = 4097 * 4 - 3, 1500, 2500, 0
    for q in range(4097):
        digest = hashlib.md5(f"15015|31|{q}".encode()).digest()
        spots = [int.from_bytes(digest[4 * k : 4 * k + 4], "big") % n for k in range(4) if 4 * q + k < n]
        total += sum(-1 if s < down else s >= n - up for s in spots)
    assert _drawn(15015, 31, 0, 1024, n, down, up) + _drawn(15015, 31, 1024, 4097, n, down, up) == total


def test_bootstrap_bounds(spark):
    n = 400
    left = spark.range(n).select(F.col("id").alias("case_id"), (F.col("id") % 10 < 3).alias("ok"))
    right = spark.range(n).select(F.col("id").alias("case_id"), (F.col("id") % 10 < 5).alias("ok"))
    draws = paired_difference(left, right, "ok", resamples=400).first()
    r = draws
    assert (r.paired_case_count, r.improved_count, r.regressed_count, r.right_minus_left) == (400, 80, 0, 0.2)
    assert r.bootstrap_low == pytest.approx(0.16, abs=0.02) and r.bootstrap_high == pytest.approx(0.24, abs=0.02)
    with pytest.raises(ValueError, match="same case ids"):
        paired_difference(left, right.limit(5), "ok")


def test_ledger_blocks_and_breaches(spark):
    rows = spark.range(1, 101).select(F.col("id").alias("sequence"), (F.col("id") % 7 == 0).alias("failed"))
    ledger = usage_ledger(rows, (), "sequence", F.lit(1), F.when(~F.col("failed"), 1000), F.when(~F.col("failed"), 10), block=9)
    by = {r.sequence: r for r in ledger.collect()}
    assert by[7].cost is None and by[7].total_calls == 7 and by[100].total_calls == 100
    assert by[100].total_input_tokens == 86_000 and float(by[100].total_cost) == pytest.approx(86 * (1000 * 0.3 + 10 * 1.2) / 1e6)
    breach = {r.limit_name: r.first_breach for r in first_breaches(ledger, (), "sequence", {"http_calls": 50, "output_tokens": 10_000}).collect()}
    assert breach == {"http_calls": 51, "output_tokens": None}


def test_a_ledger_stream_goes_on_where_it_stopped(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"run{i % 3}", i, rng.choice([None, rng.randint(0, 4000)]), rng.randint(0, 900)) for i in range(600)]
    schema = "run string, n bigint, prompt bigint, completion bigint"
    limits = {"http_calls": 100, "input_tokens": 250_000, "output_tokens": 60_000, "cost": 0.08}
    whole = spark.createDataFrame(rows, schema)
    ledger = usage_ledger(whole, ("run",), "n", F.lit(1), F.col("prompt"), F.col("completion"), block=50)
    want = {(r["run"], r["limit_name"]): r["first_breach"] for r in first_breaches(ledger, ("run",), "n", limits).collect() if r["first_breach"] is not None}
    folder, output = tmp_path / "log", str(tmp_path / "out")

    def run():
        events = read_log_stream(spark, str(folder), whole.schema, "*.parquet", files_per_trigger=1)
        return run_available(stream_first_breaches(events, ("run",), "n", F.lit(1), F.col("prompt"), F.col("completion"), limits=limits), output)

    sizes = []
    for low, high in ((0, 150), (150, 151), (151, 600)):
        whole.filter(F.col("n").between(low, high - 1)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(folder))
        found = {(r["run"], r["limit_name"]): r["first_breach"] for r in run().collect()}
        sizes.append(len(found))
        assert found == {key: at for key, at in want.items() if at < high}
    assert sizes[0] < sizes[-1] == len(want) > 6


def test_changed_rows_are_found_below_differing_nodes(spark):
    rows = [(i % 4, i, f"v{i}") for i in range(500)] + [(1, 7, "twice"), (1, 7, "twice")]
    schema = "g int, k int, v string"
    before = spark.createDataFrame(rows, schema)
    after = spark.createDataFrame([*rows[:40], (0, 40, "new"), *rows[41:-1]], schema).repartition(5)
    got = {tuple(r) for r in changed_rows(before, after, ("g",), ("k", "v")).collect()}
    assert got == {(0, 40, "v40", 1, 0), (0, 40, "new", 0, 1), (1, 7, "twice", 2, 1)}
    roots = [{r["g"]: (r["input_sha256"], r["input_rows"]) for r in input_hash(x, ("g",), ("k", "v")).collect()} for x in (before, before.repartition(3), after)]
    assert roots[0] == roots[1] and {g for g in range(4) if roots[0][g] != roots[2][g]} == {0, 1}
    assert changed_rows(before, before, (), schema.replace(" int", "").replace(" string", "").split(", ")).collect() == []
    assert changed_rows(before.limit(0), before.limit(0), (), ("k",)).collect() == []


def test_sequences_and_seals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3), ("c", 2), ("d", 1), ("d", 1)], "log string, n int")
    got = {r.log: (r.gaps, r.repeats, r.contiguous) for r in sequence_audit(df, ("log",), "n").collect()}
    assert got == {"a": (0, 0, 1), "b": (1, 0, 0), "c": (0, 0, 0), "d": (0, 1, 0)}
    sealed = seal(df, df.columns, 8)
    verify_seal(df.repartition(3), df.columns, sealed)
    with pytest.raises(ValueError, match="changed"):
        verify_seal(df.filter("n < 3").union(df.limit(1)), df.columns, sealed)
    with pytest.raises(ValueError, match="incomplete"):
        verify_seal(df, df.columns, seal(df, df.columns, 9))


def test_streams_drop_late_rows_and_repeats(spark, tmp_path):
    folder = str(tmp_path / "log")

    def write(rows):
        spark.createDataFrame(rows, "at timestamp, who string, v int").coalesce(1).write.mode("append").parquet(folder)

    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "at timestamp, who string, v int"
    from pyspark.sql.types import StructType

    def usage():
        stream = read_log_stream(spark, folder, StructType.fromDDL(schema), "*.parquet")
        return run_available(stream_usage(stream, "at", "1 hour", "30 minutes", ("who",), {"total": F.col("v")}), str(tmp_path / "usage"))

    write([(t(1), "a", 1), (t(1, 20), "a", 2), (t(3), "a", 5)])
    usage()
    write([(t(1, 50), "a", 100), (t(5), "a", 7), (t(5, 1), "b", 7)])
    got = {(r.window_start.hour, r.who): (r.calls, r.total) for r in usage().collect()}
    assert got == {(1, "a"): (2, 3), (3, "a"): (1, 5)}
    stream = read_log_stream(spark, folder, StructType.fromDDL(schema), "*.parquet", 1).select("at", "v")
    assert sorted(r.v for r in run_available(stream_first_seen(stream, "at", "1 day", ("v",))).collect()) == [1, 2, 5, 7, 100]
