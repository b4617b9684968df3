"""Table profiling, key and constraint audits, event-order rules and load reconciliation.

Counts come from conditional aggregates in as few passes as the question allows. Keys are
counted before they are joined, so one key holding a third of the rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scope import flag
from metricloom.operators.windows import first_n_per_group

# Text read as missing.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _blank(df: DataFrame, column: str) -> Column:
    missing = F.col(column).isNull()
    return missing | (F.trim(column) == "") if _is_text(df, column) else missing


def _absent(df: DataFrame, column: str, tokens: Sequence[str]) -> Column:
    missing = F.col(column).isNull()
    return missing | F.col(column).isin(*tokens) if _is_text(df, column) else missing


def _rows(items: Sequence[Column]) -> Column:
    return F.explode(F.array(*items)).alias("r")


# --------------------------------------------------------------------------- profile


def profile(
    df: DataFrame,
    key: Sequence[str],
    numeric: Sequence[str] = (),
    dates: Sequence[str] = (),
    target_rows: int | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
) -> DataFrame:
    """Tall profile ``(column_name, measure, number, text)`` of one table.

    One aggregation covers all columns; key duplicates come from the key audit. Numbers are
    parsed leniently so text tables can be profiled before any typed load: what fails to parse
    is counted as invalid, never raised.
    """
    aggregates: list[Column] = [F.count(F.lit(1)).alias("table.row_count")]
    for column in df.columns:
        aggregates.append(F.sum(flag(_absent(df, column, null_tokens))).alias(f"{column}.missing"))
    for column in numeric:
        absent = _absent(df, column, null_tokens)
        number = F.when(~absent, F.col(column).try_cast("double"))
        aggregates += [
            F.sum(flag(~absent & F.col(column).try_cast("double").isNull())).alias(f"{column}.invalid"),
            F.sum(flag(number < 0)).alias(f"{column}.negative"),
            F.min(number).alias(f"{column}.minimum"),
            F.max(number).alias(f"{column}.maximum"),
        ]
    for column in dates:
        absent = _absent(df, column, null_tokens)
        moment = F.when(~absent, F.col(column).try_cast("timestamp_ntz"))
        aggregates += [
            F.sum(flag(~absent & moment.isNull())).alias(f"{column}.invalid"),
            F.min(moment).alias(f"{column}.earliest"),
            F.max(moment).alias(f"{column}.latest"),
        ]
    wide = df.agg(*aggregates)
    cells = []
    for name in wide.columns:
        column, measure = name.rsplit(".", 1)
        is_time = measure in ("earliest", "latest")
        cells.append(
            F.struct(
                F.lit(column).alias("column_name"),
                F.lit(measure).alias("measure"),
                (F.lit(None) if is_time else F.col(f"`{name}`")).cast("double").alias("number"),
                (F.date_format(F.col(f"`{name}`"), "yyyy-MM-dd HH:mm:ss") if is_time else F.lit(None))
                .cast("string")
                .alias("text"),
            )
        )
    if target_rows is not None:
        cells.append(
            F.struct(
                F.lit("table").alias("column_name"),
                F.lit("row_count_difference").alias("measure"),
                (F.lit(target_rows) - F.col("`table.row_count`")).cast("double").alias("number"),
                F.lit(None).cast("string").alias("text"),
            )
        )
    columns = wide.select(_rows(cells)).select("r.*")
    keys = key_audit(df, key).select(
        _rows(
            [
                F.struct(
                    F.lit("key").alias("column_name"),
                    F.lit(measure).alias("measure"),
                    F.col(source).cast("double").alias("number"),
                    F.lit(None).cast("string").alias("text"),
                )
                for measure, source in (("missing", "missing_key_rows"), ("duplicate", "duplicate_rows"))
            ]
        )
    ).select("r.*")
    return columns.unionByName(keys)


# --------------------------------------------------------------------------- keys


def key_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with a blank key part, distinct keys, and rows beyond the first per key."""
    parts = [F.trim(k).alias(f"_p{i}") if _is_text(df, k) else F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)]
    blank = reduce(lambda a, b: a | b, [_blank(df, k) for k in keys])
    marked = df.select(*parts, blank.alias("_blank"))
    groups = marked.groupBy(*[f"_p{i}" for i in range(len(keys))], "_blank").agg(F.count(F.lit(1)).alias("_n"))
    present = ~F.col("_blank")
    zero = F.lit(0)
    return groups.agg(
        F.coalesce(F.sum("_n"), zero).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("_blank"), F.col("_n"))), zero).alias("missing_key_rows"),
        F.coalesce(F.sum(flag(present)), zero).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(present, F.col("_n") - 1)), zero).alias("duplicate_rows"),
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """The rows beyond the first of each repeated key, first meaning smallest ``position``.

    The first position per key is a combinable minimum; rows later than it are the extras. No
    key's rows are sorted in one task, and unique keys leave before the join back.
    """
    marked = df.withColumn("_position", position)
    firsts = (
        marked.groupBy(*keys)
        .agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )
    return (
        marked.join(firsts, list(keys))
        .filter(F.col("_position") > F.col("_first"))
        .select(*df.columns)
    )


def row_reconcile(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """Row counts on both sides of a load and whether they agree."""
    n, m = F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("m")
    return source.agg(n).select(
        F.lit(name).alias("table_name"),
        F.col("n").alias("source_rows"),
        target.agg(m).scalar().alias("target_rows"),
    ).select(
        "*",
        (F.col("target_rows") - F.col("source_rows")).alias("row_count_difference"),
        flag(F.col("target_rows") == F.col("source_rows")).alias("row_count_matches"),
    )


def fk_audit(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows, distinct parent keys, missing references and orphan rows."""

    def clean(df, column):
        value = F.trim(column) if _is_text(df, column) else F.col(column)
        return F.when(~_blank(df, column), value)

    counted = (
        child.select(clean(child, foreign_key).alias("_key"))
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    known = (
        parent.select(clean(parent, key).alias("_key"))
        .filter(F.col("_key").isNotNull())
        .distinct()
        .withColumn("_known", F.lit(1))
    )
    joined = counted.join(known, "_key", "full")
    missing = F.col("_key").isNull()
    zero = F.lit(0)
    return joined.agg(
        F.coalesce(F.sum("_n"), zero).alias("child_rows"),
        F.count("_known").alias("parent_keys"),
        F.coalesce(F.sum(F.when(missing, F.col("_n"))), zero).alias("missing_references"),
        F.coalesce(F.sum(F.when(~missing & F.col("_known").isNull(), F.col("_n"))), zero).alias("orphan_rows"),
    )


def unmatched_reference(child: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """For a soft reference: missing values, and present values the dimension does not list."""
    audit = fk_audit(child, column, dimension, key)
    present = F.col("child_rows") - F.col("missing_references")
    return audit.select(
        "child_rows",
        "missing_references",
        F.col("orphan_rows").alias("unmatched_references"),
        (present - F.col("orphan_rows")).alias("matched_references"),
    )


# --------------------------------------------------------------------------- rules


def check_rules(df: DataFrame, rules: dict[str, str | Column]) -> DataFrame:
    """Violations per rule in one pass. As in SQL, a rule that evaluates to NULL holds."""
    tests = {n: (F.expr(r) if isinstance(r, str) else r) for n, r in rules.items()}
    wide = df.agg(
        *[F.coalesce(F.sum(flag(~test)), F.lit(0)).alias(name) for name, test in tests.items()]
    )
    return wide.select(
        _rows([F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in tests])
    ).select("r.*")


def constraint_report(
    tables: dict[str, DataFrame],
    required: dict[str, Sequence[str]],
    primary: dict[str, Sequence[str]],
    checks: dict[str, dict[str, str]],
    foreign: Sequence[tuple[str, str, str, str]],
) -> DataFrame:
    """Violations of every declared NOT NULL, CHECK, primary and foreign key, one row each."""
    frames = []
    for name, df in tables.items():
        rules: dict[str, str | Column] = {f"{c} not null": F.col(c).isNotNull() for c in required.get(name, ())}
        rules |= checks.get(name, {})
        if rules:
            frames.append(check_rules(df, rules).select(F.lit(name).alias("table_name"), "rule", "violations"))
        if name in primary:
            audit = key_audit(df, primary[name])
            frames.append(
                audit.select(
                    F.lit(name).alias("table_name"),
                    F.lit("primary key").alias("rule"),
                    (F.col("missing_key_rows") + F.col("duplicate_rows")).alias("violations"),
                )
            )
    for child, column, parent, key in foreign:
        if child in tables and parent in tables:
            audit = fk_audit(tables[child], column, tables[parent], key)
            frames.append(
                audit.select(
                    F.lit(child).alias("table_name"),
                    F.lit(f"{column} references {parent}").alias("rule"),
                    F.col("orphan_rows").alias("violations"),
                )
            )
    return reduce(lambda a, b: a.unionByName(b), frames)


def event_order(
    df: DataFrame, rules: Sequence[tuple[str, str, str]], row_id: str, examples: int = 5
) -> DataFrame:
    """Per rule (later >= earlier): comparable rows, violations, and the first few row ids.

    The counts are one pass of conditional sums. Examples take the smallest ids through an
    early-limited rank, so violations are never gathered as a list.
    """
    wide = df.agg(
        *[
            c
            for name, later, earlier in rules
            for c in (
                F.count(F.when(F.col(later).isNotNull() & F.col(earlier).isNotNull(), 1)).alias(f"{name}.comparable"),
                F.count(F.when(F.col(later) < F.col(earlier), 1)).alias(f"{name}.violations"),
            )
        ]
    )
    counts = wide.select(
        _rows(
            [
                F.struct(
                    F.lit(name).alias("rule"),
                    F.lit(f"{later} >= {earlier}").alias("expected"),
                    F.col(f"`{name}.comparable`").alias("comparable_rows"),
                    F.col(f"`{name}.violations`").alias("violations"),
                )
                for name, later, earlier in rules
            ]
        )
    ).select("r.*")
    broken = F.array_compact(
        F.array(*[F.when(F.col(later) < F.col(earlier), F.lit(name)) for name, later, earlier in rules])
    )
    offenders = df.select(F.col(row_id).alias("_id"), F.explode(broken).alias("rule"))
    shown = (
        first_n_per_group(offenders, ("rule",), (F.col("_id"),), examples, "_n")
        .groupBy("rule")
        .agg(F.array_sort(F.collect_list("_id")).alias("example_ids"))
    )
    return counts.join(shown, "rule", "left")


def reject_numeric(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Rows whose measure is absent or is not a number, with the id of their order."""
    absent = F.col(column).isNull() | ((F.trim(column) == "") if _is_text(df, column) else F.lit(False))
    bad = ~absent & F.col(column).try_cast("double").isNull()
    return df.select(
        F.col(row_id),
        F.col(column).cast("string").alias("raw_value"),
        F.when(absent, "absent").when(bad, "not_a_number").alias("reason"),
    ).filter(F.col("reason").isNotNull())


def quality_report(
    tables: dict[str, DataFrame],
    keys: dict[str, Sequence[str]],
    numeric: dict[str, Sequence[str]],
    dates: dict[str, Sequence[str]],
) -> DataFrame:
    """The profiles of all tables as one tall frame."""
    frames = [
        profile(df, keys[name], numeric.get(name, ()), dates.get(name, ())).select(
            F.lit(name).alias("table_name"), "*"
        )
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)
