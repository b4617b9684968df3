"""Tolerant comparison of expected and actual result sets, for many cases at once.

Rows match when every column does: NULL only NULL, booleans never numbers, dates and times as full
ISO text, numbers within ``max(relative * larger magnitude, absolute)``. Integers and decimals
without a tolerance compare digit by digit; NaN and infinity match nothing. Unordered results match
when a one-to-one pairing of all rows exists.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.joins import join_on
from metricloom.functions.scope import flag
from metricloom.operators.matching import maximum_matching
from metricloom.operators.ranking import with_value_blocks
from metricloom.operators.windows import running_totals
from metricloom.session import written

RANKS_PER_BLOCK = 10_000
# Rows for each cell, on average, from which a column is searched for classes.
ROWS_PER_CELL = 4


@dataclass(frozen=True)
class DiffRules:
    """``tolerance`` maps numeric columns to (absolute, relative), ``default_tolerance`` holds for the
    numeric columns it does not name; without either, values compare exactly.

    ``position`` names a row-number column of both sides when the order must match too.
    """

    columns: tuple[str, ...]
    tolerance: dict[str, tuple[float, float]] = field(default_factory=dict)
    position: str | None = None
    allow_extra: bool = False
    default_tolerance: tuple[float, float] | None = None

    def of(self, column: str) -> tuple[float, float] | None:
        return self.tolerance.get(column, self.default_tolerance)


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    return "text"


def _inexact(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def _comparable(df: DataFrame, column: str, as_double: bool, mark: str) -> Column:
    """Text form that is equal exactly when two values of any type are equal.

    ``as_double`` says that one of the sides holds doubles; ``mark`` is the side's own, so that
    what is not finite equals nothing on the other side.
    """
    data_type = df.schema[column].dataType
    kind = _kind(data_type)
    if kind == "number" and as_double:
        value = F.col(column).cast("double") + F.lit(0.0)
        finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
        shown = F.when(value.isNotNull(), F.when(finite, value.cast("string")).otherwise(mark))
    elif kind == "number":
        plain = F.col(column).cast("string")
        shown = F.regexp_replace(plain, r"(\.\d*?)0+$", "$1") if isinstance(data_type, T.DecimalType) else plain
        shown = F.regexp_replace(F.regexp_replace(shown, r"\.$", ""), "^-0$", "0")
    elif isinstance(data_type, T.TimestampType):
        shown = F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(data_type, T.TimestampNTZType):
        shown = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        shown = F.col(column).cast("string")
    return F.concat(F.lit(kind[0]), shown)


def _close(a: Column, b: Column, tolerance: tuple[float, float]) -> Column:
    absolute, relative = tolerance
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return finite & (
        (a == b) | (F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)))
    )


def _exact_columns(expected: DataFrame, actual: DataFrame, rules: DiffRules) -> list[str]:
    """Columns without a tolerance, or that are not numbers on both sides."""

    def number(df: DataFrame, c: str) -> bool:
        return c in df.columns and _kind(df.schema[c].dataType) == "number"

    return [c for c in rules.columns if not (rules.of(c) and number(expected, c) and number(actual, c))]


def _aligned(expected: DataFrame, actual: DataFrame, by: Sequence[str], rules: DiffRules):
    """Both sides as (*by, x0.. exact text, v0.. tolerant doubles[, position]).

    A column one side lacks, or holds as another kind, can match nothing but NULL.
    """
    exact = _exact_columns(expected, actual, rules)
    tolerant = [c for c in rules.columns if c not in exact]
    doubles = {c for c in exact if any(c in d.columns and _inexact(d.schema[c].dataType) for d in (expected, actual))}

    def side(df: DataFrame, absent_mark: str) -> DataFrame:
        texts = [
            (_comparable(df, c, c in doubles, absent_mark) if c in df.columns else F.lit(absent_mark)).alias(f"x{i}") for i, c in enumerate(exact)
        ]
        numbers = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(tolerant)]
        place = [F.col(rules.position).alias("position")] if rules.position else []
        return df.select(*by, *texts, *numbers, *place)

    names = [f"x{i}" for i in range(len(exact))], [f"v{i}" for i in range(len(tolerant))]
    return side(expected, "absent in expected"), side(actual, "absent in actual"), *names, [rules.of(c) for c in tolerant]


def _pair_runs(dirty: DataFrame, key: list[str], values: list[str], tolerances: Sequence[tuple[float, float]]) -> DataFrame:
    """Keys whose rows, paired in sorted order of ``values``, contain a pair outside the tolerances.

    For one number sorted pairing is optimal, because closeness never improves by crossing. Each
    distinct row covers a range of ranks on its side; ranges are clipped to blocks of ranks and
    the two sides are read together inside each block.
    """
    row = F.struct(*values)
    counts = dirty.groupBy(*key, *values).agg(F.sum("e").alias("e"), F.sum("a").alias("a")).withColumn("_row", row)
    # The cuts and their search both read the counts; they are found once.
    placed = with_value_blocks(written(counts), values[0], "_cut_block")
    ranked = running_totals(placed, key, "_row", F.col("_cut_block"), {"_e_end": F.col("e"), "_a_end": F.col("a")})
    none = F.lit(None).cast(counts.schema["_row"].dataType)
    sides = F.array(
        F.struct(F.col("e").alias("n"), F.col("_e_end").alias("end"), F.col("_row").alias("_e"), none.alias("_a")),
        F.struct(F.col("a").alias("n"), F.col("_a_end").alias("end"), none.alias("_e"), F.col("_row").alias("_a")),
    )
    runs = ranked.select(*key, F.explode(sides).alias("s")).filter(F.col("s.n") > 0)
    first, last = F.col("s.end") - F.col("s.n"), F.col("s.end") - 1
    block = F.explode(F.sequence(F.floor(first / RANKS_PER_BLOCK), F.floor(last / RANKS_PER_BLOCK)))
    both = runs.select(*key, first.alias("_first"), "s._e", "s._a", block.alias("_block")).withColumn(
        "_at", F.greatest("_first", F.col("_block") * RANKS_PER_BLOCK)
    )
    starts = both.groupBy(*key, "_block", "_at").agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    along = Window.partitionBy(*key, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    paired = starts.select(
        *key, F.last("_e", ignorenulls=True).over(along).alias("_e"), F.last("_a", ignorenulls=True).over(along).alias("_a")
    )
    near = reduce(lambda p, q: p & q, [_close(F.col(f"_e.{v}"), F.col(f"_a.{v}"), t) for v, t in zip(values, tolerances)])
    return paired.filter(~F.coalesce(near, F.lit(False))).select(*key).distinct()


def _cell(value: Column, tolerance: tuple[float, float]) -> Column:
    """A number that differs by at most one between close values, whatever their size.

    It grows evenly where the absolute tolerance rules and with the logarithm where the relative one
    does, so one very large value does not widen the cells of the others. Values of different signs
    are close only near zero. It stays a double: beyond its precision neighbours are equal numbers.
    """
    absolute, relative = tolerance
    if relative >= 0.9:
        return F.lit(0.0)
    size = F.abs(value)
    if relative > 0:
        turn = absolute / relative
        start = math.log(turn) if turn > 0 else math.log(5e-324)
        per_step = -math.log1p(-relative)
        # A value in the logarithmic part is one cell and its logarithm away from the turn.
        base = size / absolute if absolute > 0 else F.lit(0.0)
        grown = F.lit(1 / relative if absolute > 0 else 0.0) + (F.log(F.greatest(size, F.lit(5e-324))) - start) / per_step
        scaled = F.when(size <= turn, base).otherwise(grown + (0.0 if absolute > 0 else 2.0))
    else:
        scaled = size / absolute if absolute > 0 else size
    signed = F.when(value < 0, -scaled).otherwise(scaled) / 1.25
    return signed - F.pmod(signed, F.lit(1.0))


def _close_pairs(dirty: DataFrame, key: list[str], values: list[str], tolerances: Sequence[tuple[float, float]]) -> DataFrame:
    """(e_id, a_id, distance) of all rows that are close, met in the cells of the first two numbers."""
    gridded = list(zip(values, tolerances))[:2]
    cells = [f"_c{i}" for i in range(len(gridded))]
    rows = dirty.withColumns({c: _cell(F.col(v), t) for c, (v, t) in zip(cells, gridded)})
    e = rows.filter("e > 0").select(*key, *cells, F.col("_node").alias("e_id"), *[F.col(v).alias(f"e_{v}") for v in values])
    for c in cells:
        e = e.withColumn(c, F.explode(F.array_distinct(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))))
    a = rows.filter("a > 0").select(*key, *cells, F.col("_node").alias("a_id"), *[F.col(v).alias(f"a_{v}") for v in values])
    near = reduce(lambda p, q: p & q, [_close(F.col(f"e_{v}"), F.col(f"a_{v}"), t) for v, t in zip(values, tolerances)])
    apart = [F.coalesce(F.abs(F.col(f"e_{v}") - F.col(f"a_{v}")) / F.lit(t[0] if t[0] > 0 else 1.0), F.lit(0.0)) for v, t in zip(values, tolerances)]
    return e.join(a, [*key, *cells]).filter(near).select("e_id", "a_id", reduce(lambda p, q: p + q, apart).alias("distance"))


def _unmatched(dirty: DataFrame, key: list[str], values: list[str], tolerances: Sequence[tuple[float, float]]) -> DataFrame:
    """(e_id, room): expected rows, and how many of their copies, that a maximum matching leaves over."""
    wanted = dirty.filter("e > 0").select(F.col("_node").alias("e_id"), F.col("e").alias("n"))
    offered = dirty.filter("a > 0").select(F.col("_node").alias("a_id"), F.col("a").alias("n"))
    return maximum_matching(_close_pairs(dirty, key, values, tolerances), wanted, offered)


def _in_classes(dirty: DataFrame, key: list[str], values: list[str], tolerances: Sequence[tuple[float, float]]) -> DataFrame | None:
    """``dirty`` with ``_part``, beyond which no row has a close one, and ``_open``: the columns that still decide in it.

    Along a column, cells follow each other in one class as long as the last value of one is close to the
    first of the next. If the least and the largest value of a class are close, so are all of its values,
    and the column decides nothing there. None if no column has cells with many rows.
    """
    cells = [_cell(F.col(v), t) for v, t in zip(values, tolerances)]
    seen = dirty.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.struct(*key, c)).alias(v) for v, c in zip(values, cells)]).first()
    searched = [v for v, (_, relative) in zip(values, tolerances) if relative < 1 and seen[v] * ROWS_PER_CELL <= seen["n"]]
    if not searched:
        return None
    for v, cell, t in zip(values, cells, tolerances):
        if v not in searched:
            continue
        # A little more than the tolerance between classes and a little less inside one, so that rounding does no harm.
        more, less = (tuple(x * (1 + by) for x in t) for by in (1e-9, -1e-9))
        spans = written(dirty.groupBy(*key, cell.alias("_c")).agg(F.min(v).alias("_low"), F.max(v).alias("_high")))
        before = spans.select(*key, (F.col("_c") + 1).alias("_c"), F.col("_high").alias("_before"))
        starts = spans.join(before, [*key, "_c"], "left").withColumn("_starts", flag(~F.coalesce(_close(F.col("_before"), F.col("_low"), more), F.lit(False))))
        placed = with_value_blocks(starts.select(*key, "_c", "_low", "_high", "_starts"), "_low", "_cut_block")
        numbered = written(running_totals(placed, key, "_low", F.col("_cut_block"), {"_class": F.col("_starts")}))
        classes = numbered.groupBy(*key, "_class").agg(_close(F.min("_low"), F.max("_high"), less).alias(f"_whole_{v}"))
        labels = written(numbered.select(*key, "_c", "_class").join(classes, [*key, "_class"]).withColumnRenamed("_class", f"_class_{v}"))
        dirty = dirty.withColumn("_c", cell).join(labels, [*key, "_c"]).drop("_c")
    part = F.concat_ws("|", *[F.col(f"_class_{v}").cast("string") for v in searched])
    still = F.concat_ws(",", *[F.when(~F.col(f"_whole_{v}"), v) if v in searched else F.lit(v) for v in values])
    return written(dirty.withColumns({"_part": part, "_open": still}).drop(*[f"_{x}_{v}" for v in searched for x in ("class", "whole")]))


def _without_pairing(dirty: DataFrame, key: list[str], values: list[str], tolerances: Sequence[tuple[float, float]]) -> DataFrame:
    """Keys without a full pairing of their rows.

    With several numbers, rows are first taken apart by the classes of each column; where one column is left
    that decides, sorted pairing does. Only parts with more of them are matched.
    """
    if len(values) == 1:
        return _pair_runs(dirty, key, values, tolerances)
    rows = _in_classes(dirty, key, values, tolerances)
    if rows is None:
        return _undecided_matched(dirty, key, values, tolerances)
    within = [*key, "_part"]
    uneven = written(rows.groupBy(*within).agg((F.sum("e") - F.sum("a")).alias("_over")).filter("_over != 0").select(*key).distinct())
    rows = written(rows.join(uneven, key, "left_anti"))
    failing = [uneven]
    for v, t in zip(values, tolerances):
        one = rows.filter(F.col("_open") == v)
        if not one.isEmpty():
            failing.append(_pair_runs(one, within, [v], [t]).select(*key))
    several = rows.filter(F.col("_open").contains(","))
    if not several.isEmpty():
        failing.append(_undecided_matched(several, within, values, tolerances).select(*key))
    return reduce(lambda p, q: p.union(q), failing).distinct()


def _undecided_matched(dirty: DataFrame, key: list[str], values: list[str], tolerances: Sequence[tuple[float, float]]) -> DataFrame:
    """Keys without a full pairing of their rows, which have several numbers.

    A key fails if one number alone has no full pairing, and passes if the sorted rows pair up as they
    stand. Both are running counts; only what is then undecided is matched.
    """
    alone = written(reduce(lambda p, q: p.union(q), [_pair_runs(dirty, key, [v], [t]) for v, t in zip(values, tolerances)]).distinct())
    rest = written(dirty.join(alone, key, "left_anti"))
    if rest.isEmpty():
        return alone
    open_keys = written(_pair_runs(rest, key, values, tolerances))
    rest = written(rest.join(open_keys, key, "left_semi"))
    if rest.isEmpty():
        return alone
    over = _unmatched(rest, key, values, tolerances)
    return alone.union(rest.join(over, F.col("_node") == F.col("e_id"), "left_semi").select(*key).distinct())


@dataclass(frozen=True)
class _Counted:
    """Both sides as counted rows: ``cells`` have the ``key`` columns, ``values``, ``e``, ``a``, ``_node`` and ``_g``."""

    cells: DataFrame
    expected: DataFrame
    actual: DataFrame
    exact: list[str]
    values: list[str]
    tolerances: list[tuple[float, float]]
    key: list[str]


def _counted(expected: DataFrame, actual: DataFrame, rules: DiffRules, by: Sequence[str]) -> _Counted:
    e, a, exact, values, tolerances = _aligned(expected, actual, by, rules)
    nulls = [F.col(v).isNull().alias(f"n_{v}") for v in values]
    key = [*by, *exact, *[f"n_{v}" for v in values]]
    filled = [F.coalesce(v, F.lit(0.0)).alias(v) for v in values]

    def side(rows: DataFrame, mine: str, other: str) -> DataFrame:
        return rows.select(*by, *exact, *nulls, *filled, F.lit(1).alias(mine), F.lit(0).alias(other))

    rows = side(e, "e", "a").unionByName(side(a, "a", "e"))
    # One text key per group keeps the later joins free of null-safe comparisons: each part is
    # written after its own length, so no two groups share a key.
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key]
    group = F.concat_ws("|", *[x for p in parts for x in (F.length(p), p)]) if key else F.lit("all")
    # Both results are computed once and kept as counts; every later step reads those.
    cells = rows.groupBy(*key, *values).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    cells = written(cells.withColumns({"_node": F.monotonically_increasing_id(), "_g": group}))
    return _Counted(cells, e, a, exact, values, tolerances, key)


def unmatched_rows(expected: DataFrame, actual: DataFrame, rules: DiffRules, by: Sequence[str] = ()) -> DataFrame:
    """Expected rows that no actual row is left for, with the number of copies in ``unmatched``.

    They come from a maximum matching, so their number is the least there can be; where several rows
    compete for one partner, which of them stays over is not fixed. Columns are ``by``, the exact columns
    as compared text and the tolerant ones as numbers, under their own names.
    """
    c = _counted(expected, actual, rules, by)
    finite = reduce(lambda p, q: p & q, [~(F.isnan(v) | (F.abs(v) == float("inf"))) for v in c.values], F.lit(True))
    surplus = c.cells.filter((F.col("e") > 0) & ((F.col("e") > F.col("a")) | ~finite | F.lit(bool(c.values))))
    if not c.values:
        over = surplus.select(F.col("_node").alias("e_id"), (F.col("e") - F.col("a")).alias("room"))
    else:
        groups = c.cells.groupBy("_g").agg(F.max(flag((F.col("e") != F.col("a")) | ~finite)).alias("_differs")).filter("_differs = 1").select("_g")
        dirty = written(c.cells.join(groups, "_g", "left_semi"))
        lost = dirty.filter(~finite & (F.col("e") > 0)).select(F.col("_node").alias("e_id"), F.col("e").alias("room"))
        over = lost.unionByName(_unmatched(dirty.filter(finite), ["_g"], c.values, c.tolerances))
    exact = _exact_columns(expected, actual, rules)
    tolerant = [x for x in rules.columns if x not in exact]
    shown = [F.substring(f"x{i}", 2, 1 << 30).alias(n) for i, n in enumerate(exact)] + [F.when(~F.col(f"n_v{i}"), F.col(f"v{i}")).alias(n) for i, n in enumerate(tolerant)]
    return c.cells.join(over, F.col("_node") == F.col("e_id")).select(*by, *shown, F.col("room").cast("bigint").alias("unmatched"))


def _columns_ok(expected: DataFrame, actual: DataFrame, rules: DiffRules, by: Sequence[str] = ()) -> bool:
    have, want = set(actual.columns) - {*by, rules.position}, set(expected.columns) - {*by, rules.position}
    return want == set(rules.columns) and (want <= have if rules.allow_extra else want == have)


def diff_results(expected: DataFrame, actual: DataFrame, rules: DiffRules, by: Sequence[str] = ()) -> DataFrame:
    """One verdict per case: columns, row count, values, order, and the issue codes.

    Equal rows cancel as counts, so only keys that differ somewhere go on to the tolerant
    pairing; the usual cost is one aggregation over both sides.
    """
    case = list(by)
    columns_ok = _columns_ok(expected, actual, rules, case)
    counted = _counted(expected, actual, rules, case)
    cells, e, a, exact, values, tolerances = counted.cells, counted.expected, counted.actual, counted.exact, counted.values, counted.tolerances
    totals = cells.groupBy(*counted.key, "_g").agg(
        F.sum("e").alias("_te"),
        F.sum("a").alias("_ta"),
        F.max(flag(F.col("e") != F.col("a"))).alias("_differs"),
        F.max(
            flag(reduce(lambda p, q: p | q, [F.isnan(v) | (F.abs(v) == float("inf")) for v in values], F.lit(False)))
        ).alias("_not_finite"),
    )
    settled = totals.select("_g", *case, "_te", "_ta", "_differs", "_not_finite")
    bad = (F.col("_te") != F.col("_ta")) | (F.col("_not_finite") == 1)
    failing = settled.filter(bad).select("_g")
    if values:
        open_groups = settled.filter(~bad & (F.col("_differs") == 1)).select("_g")
    if values and not open_groups.isEmpty():
        dirty = written(cells.join(open_groups, "_g", "left_semi").select("_g", *values, "e", "a", "_node"))
        failing = failing.union(_without_pairing(dirty, ["_g"], values, tolerances))
    marked = settled.join(failing.distinct().withColumn("_failed", F.lit(1)), "_g", "left")
    verdict = marked.groupBy(*case).agg(
        F.sum("_te").alias("expected_rows"),
        F.sum("_ta").alias("actual_rows"),
        F.sum(F.coalesce("_failed", F.lit(0))).alias("_failed_groups"),
    )
    count_ok = F.col("expected_rows") == F.col("actual_rows")
    verdict = verdict.withColumn("_values_ok", count_ok & (F.col("_failed_groups") == 0))
    if rules.position:
        place = [*case, "position"]
        left = e.select(*place, *[F.col(c).alias(f"e_{c}") for c in [*exact, *values]], F.lit(1).alias("_e"))
        right = a.select(*place, *[F.col(c).alias(f"a_{c}") for c in [*exact, *values]], F.lit(1).alias("_a"))
        tests = [F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")) for c in exact] + [
            (F.col(f"e_{v}").isNull() & F.col(f"a_{v}").isNull())
            | F.coalesce(_close(F.col(f"e_{v}"), F.col(f"a_{v}"), t), F.lit(False))
            for v, t in zip(values, tolerances)
        ]
        same = reduce(lambda p, q: p & q, tests, F.col("_e").isNotNull() & F.col("_a").isNotNull())
        moved = join_on(left, right, place, "full").filter(~same).groupBy(*case).agg(F.count(F.lit(1)).alias("_moved"))
        if case:
            verdict = join_on(verdict, moved, case, "left")
        else:
            verdict = verdict.withColumn("_moved", moved.scalar())
        order_ok = count_ok & (F.coalesce(F.col("_moved"), F.lit(0)) == 0)
    else:
        order_ok = F.lit(True)
    verdict = verdict.withColumn("_order_ok", order_ok).withColumn("_columns_ok", F.lit(columns_ok))
    codes = F.concat_ws(
        ",",
        F.when(~F.col("_columns_ok"), "column_mismatch"),
        F.when(~count_ok, "row_count_mismatch"),
        F.when(~F.col("_values_ok"), "row_value_mismatch"),
        F.when(F.col("_values_ok") & ~F.col("_order_ok"), "row_order_mismatch"),
    )
    return verdict.select(
        *case,
        flag(F.col("_columns_ok")).alias("columns_correct"),
        flag(count_ok).alias("row_count_correct"),
        flag(F.col("_values_ok")).alias("values_correct"),
        flag(F.col("_order_ok")).alias("order_correct"),
        flag(F.col("_columns_ok") & count_ok & F.col("_values_ok") & F.col("_order_ok")).alias("result_correct"),
        "expected_rows",
        "actual_rows",
        codes.alias("issues"),
    )


def _cases(checks: dict[str, tuple[DataFrame, DataFrame, DiffRules]]) -> DataFrame:
    """Verdicts of references whose tolerant columns have the same tolerances, as cases of one comparison."""
    sides: tuple[list[DataFrame], list[DataFrame]] = [], []
    shapes, tolerances, ordered = {}, [], False
    for name, (saved, fresh, rules) in checks.items():
        e, a, exact, values, tolerances = _aligned(saved, fresh, (), rules)
        shapes[name] = e, a, exact, values
        ordered = rules.position is not None
    most = max(len(exact) for _, _, exact, _ in shapes.values())
    texts, numbers = [f"x{i}" for i in range(most)], [f"v{i}" for i in range(len(tolerances))]
    for name, (e, a, exact, values) in shapes.items():
        for rows, out in zip((e, a), sides, strict=True):
            padded = [F.col(x) if x in exact else F.lit(None).cast("string").alias(x) for x in texts]
            out.append(rows.select(F.lit(name).alias("name"), *padded, *values, *(["position"] if ordered else [])))
    expected, actual = (reduce(lambda p, q: p.unionByName(q), side) for side in sides)
    rules = DiffRules((*texts, *numbers), dict(zip(numbers, tolerances, strict=True)), "position" if ordered else None)
    return diff_results(expected, actual, rules, by=("name",))


def verify_references(checks: dict[str, tuple[DataFrame, DataFrame, DiffRules]]) -> DataFrame:
    """Recomputed queries against their saved rows: one verdict per name.

    Rows of all references that share their tolerances are cases of one comparison, so any number of
    references costs the jobs of one. Columns are a matter of the frames and are compared beside it; a
    reference without any row on either side is correct.
    """
    alike: dict[tuple, dict] = {}
    for name, (saved, fresh, rules) in checks.items():
        exact = _exact_columns(saved, fresh, rules)
        shared = tuple(rules.of(c) for c in rules.columns if c not in exact), rules.position is not None
        alike.setdefault(shared, {})[name] = saved, fresh, rules
    verdicts = reduce(lambda p, q: p.unionByName(q), [_cases(group) for group in alike.values()])
    spark = verdicts.sparkSession
    columns = [(name, int(_columns_ok(saved, fresh, rules))) for name, (saved, fresh, rules) in checks.items()]
    named = spark.createDataFrame(columns, "name string, _columns int")
    found = named.join(verdicts.drop("columns_correct"), "name", "left").na.fill(1, ["row_count_correct", "values_correct", "order_correct", "result_correct"]).na.fill(0, ["expected_rows", "actual_rows"]).na.fill("", ["issues"])
    issues = F.concat_ws(",", F.when(F.col("_columns") == 0, "column_mismatch"), F.when(F.col("issues") != "", F.col("issues")))
    return found.select(
        "name",
        F.col("_columns").alias("columns_correct"),
        "row_count_correct",
        "values_correct",
        "order_correct",
        (F.col("result_correct") * F.col("_columns")).alias("result_correct"),
        "expected_rows",
        "actual_rows",
        issues.alias("issues"),
    )
