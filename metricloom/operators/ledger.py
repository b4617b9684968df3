"""Usage ledgers, lineage hashes, sequence audits, first-seen registries, resumption, seals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.joins import join_on
from metricloom.functions.scope import flag
from metricloom.operators.windows import running_totals
from metricloom.session import written

# Default prices per million tokens and authorised limits.
INPUT_PRICE, OUTPUT_PRICE = "0.30", "1.20"
LIMITS = {"http_calls": 480, "input_tokens": 2_400_000, "output_tokens": 180_000, "cost": 0.90}
LEDGER_BLOCK = 50_000


def estimated_tokens(text: Column | str) -> Column:
    """Half the characters rounded down, at least one: a cautious size of mixed-language text."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("bigint")


def usage_ledger(
    events: DataFrame,
    by: Sequence[str],
    sequence: str,
    calls: Column,
    prompt: Column,
    completion: Column,
    prices: tuple[str, str] = (INPUT_PRICE, OUTPUT_PRICE),
    block: int = LEDGER_BLOCK,
) -> DataFrame:
    """Per event its exact cost and the running calls, tokens and cost up to it.

    A failed call has NULL usage and cost but still counts as a call. ``sequence`` counts events
    without gaps, so its quotient bounds the rows one task sums.
    """
    price_in, price_out = (F.lit(p).cast("decimal(10,4)") for p in prices)
    per_million = F.lit("0.000001").cast("decimal(7,6)")
    rows = events.select(
        "*",
        calls.cast("bigint").alias("http_attempts"),
        prompt.cast("bigint").alias("prompt_tokens"),
        completion.cast("bigint").alias("completion_tokens"),
    )
    raw = F.col("prompt_tokens").cast("decimal(12,0)") * price_in + F.col("completion_tokens").cast("decimal(12,0)") * price_out
    rows = rows.withColumn("cost", (raw.cast("decimal(18,4)") * per_million).cast("decimal(24,10)"))
    return running_totals(
        rows,
        by,
        sequence,
        F.floor(F.col(sequence) / block),
        {
            "total_calls": F.col("http_attempts"),
            "total_input_tokens": F.col("prompt_tokens"),
            "total_output_tokens": F.col("completion_tokens"),
            "total_cost": F.col("cost"),
        },
    )


def first_breaches(ledger: DataFrame, by: Sequence[str], sequence: str, limits: dict = LIMITS) -> DataFrame:
    """(limit, first sequence above it, total) per ledger; NULL where a limit held."""
    totals = {
        "http_calls": "total_calls",
        "input_tokens": "total_input_tokens",
        "output_tokens": "total_output_tokens",
        "cost": "total_cost",
    }
    wide = ledger.groupBy(*by).agg(
        *[
            c
            for name, bound in limits.items()
            for c in (
                F.min(F.when(F.col(totals[name]) > F.lit(str(bound)).cast("decimal(20,6)"), F.col(sequence))).alias(f"at_{name}"),
                F.max(totals[name]).cast("double").alias(f"sum_{name}"),
            )
        ]
    )
    cells = [
        F.struct(
            F.lit(name).alias("limit_name"),
            F.lit(float(bound)).alias("limit_value"),
            F.col(f"sum_{name}").alias("total"),
            F.col(f"at_{name}").alias("first_breach"),
        )
        for name, bound in limits.items()
    ]
    return wide.select(*by, F.explode(F.array(*cells)).alias("r")).select(*by, "r.*")


# --------------------------------------------------------------------------- lineage


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON with its keys in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


HEX = "0123456789abcdef"


def hash_tree(rows: DataFrame, by: Sequence[str], columns: Sequence[str], depth: int = 2) -> DataFrame:
    """Merkle tree of each group over the prefixes of its row hashes: (*by, level, prefix, node_sha256, rows).

    A leaf, of ``depth`` hex digits, covers the row hashes with its prefix: their number and the sums of
    their four 64-bit parts, which combine across tasks, so that repeated and lost rows show and no row is
    gathered. A node above hashes the hashes of its sixteen places, an absent one being empty. The root has
    level 0 and the empty prefix. Nothing depends on the order of the rows.
    """
    if not 0 <= depth <= 8:
        raise ValueError("a depth of 0 to 8 hex digits")
    hashed = rows.select(*by, row_hash(columns).alias("_h"))
    parts = [F.sum(F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    level = hashed.groupBy(*by, F.substring("_h", 1, depth).alias("prefix")).agg(
        F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("node_sha256"), F.count(F.lit(1)).alias("rows")
    )
    levels = [level.withColumn("level", F.lit(depth))]
    for d in range(depth - 1, -1, -1):
        digit = F.substring("prefix", d + 1, 1)
        places = [F.coalesce(F.max(F.when(digit == x, F.col("node_sha256"))), F.lit("")) for x in HEX]
        level = level.groupBy(*by, F.substring("prefix", 1, d).alias("prefix")).agg(F.sha2(F.concat_ws("|", *places), 256).alias("node_sha256"), F.sum("rows").alias("rows"))
        levels.append(level.withColumn("level", F.lit(d)))
    return reduce(lambda x, y: x.unionByName(y), levels).select(*by, "level", "prefix", "node_sha256", "rows")


def input_hash(rows: DataFrame, by: Sequence[str], columns: Sequence[str], depth: int = 2) -> DataFrame:
    """One hash per calculation over its input rows, whatever their number and order: the root of its tree."""
    roots = hash_tree(rows, by, columns, depth).filter("level = 0")
    return roots.select(*by, F.col("node_sha256").alias("input_sha256"), F.col("rows").alias("input_rows"))


def changed_leaves(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, prefix) of the leaves that differ between two trees of one depth.

    Descends from the roots: a level is compared only below nodes that differ.
    """
    depth = after.agg(F.max("level")).first()[0] if not after.isEmpty() else before.agg(F.max("level")).first()[0] or 0
    trees = [written(t) for t in (before, after)]
    open_nodes = None
    for d in range(depth + 1):
        sides = []
        for name, tree in zip("ba", trees, strict=True):
            nodes = tree.filter(F.col("level") == d).select(*by, "prefix", F.col("node_sha256").alias(f"_{name}"))
            if open_nodes is not None:
                parents = nodes.withColumn("_parent", F.substring("prefix", 1, d - 1))
                nodes = join_on(parents, open_nodes.withColumnRenamed("prefix", "_parent"), [*by, "_parent"], "left_semi").drop("_parent")
            sides.append(nodes)
        met = join_on(*sides, [*by, "prefix"], "full")
        open_nodes = written(met.filter(~F.col("_b").eqNullSafe(F.col("_a"))).select(*by, "prefix"))
    return open_nodes


def changed_rows(before: DataFrame, after: DataFrame, by: Sequence[str], columns: Sequence[str], depth: int = 4) -> DataFrame:
    """Rows whose number of copies differs: (*by, *columns, before_rows, after_rows).

    Only rows under a leaf that differs are counted; an unchanged table costs its two trees.
    """
    leaves = changed_leaves(hash_tree(before, by, columns, depth), hash_tree(after, by, columns, depth), by)
    carried = [*by, *[c for c in columns if c not in by]]

    def side(rows: DataFrame, mine: str, other: str) -> DataFrame:
        hashed = rows.select(*carried, row_hash(columns).alias("_h"))
        near = join_on(hashed.withColumn("prefix", F.substring("_h", 1, depth)), leaves, [*by, "prefix"], "left_semi")
        return near.select(*carried, "_h", F.lit(1).alias(mine), F.lit(0).alias(other))

    both = side(before, "_b", "_a").unionByName(side(after, "_a", "_b"))
    counted = both.groupBy("_h", *carried).agg(F.sum("_b").alias("before_rows"), F.sum("_a").alias("after_rows"))
    return counted.filter("before_rows <> after_rows").drop("_h")


def lineage_check(calculations: DataFrame, runs: DataFrame) -> DataFrame:
    """Calculations whose parent run exists and whose source attempt is one of its attempts."""
    known = runs.select(F.col("run_id").alias("parent_run_id"), F.col("attempts").alias("_attempts"))
    joined = calculations.join(known, "parent_run_id", "left")
    return joined.withColumn(
        "lineage_status",
        F.when(F.col("_attempts").isNull(), "unknown_run")
        .when(~F.coalesce(F.col("source_attempt").between(F.lit(1), F.col("_attempts")), F.lit(False)), "attempt_out_of_range")
        .otherwise("linked"),
    ).drop("_attempts")


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Content digest, rows and bytes of a table of any size, independent of row order.

    Each row hash is cut into four 64-bit numbers whose sums combine across tasks; the digest
    covers the sums and the row count, so changed, lost and repeated rows all show.
    """
    hashed = df.select(row_hash(columns).alias("h"), F.length(F.to_json(F.struct(*sorted(columns)))).alias("b"))
    parts = [F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = hashed.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("byte_count"),
        *[F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{i}") for i, p in enumerate(parts)],
    )
    text = F.concat_ws("|", F.col("row_count").cast("string"), "s0", "s1", "s2", "s3")
    return sums.select(F.sha2(text, 256).alias("content_sha256"), "row_count", "byte_count")


def seal(df: DataFrame, columns: Sequence[str], expected_rows: int) -> DataFrame:
    """A table's digest and whether it holds the complete set."""
    return table_digest(df, columns).withColumn("complete", F.col("row_count") == expected_rows)


def verify_seal(df: DataFrame, columns: Sequence[str], sealed: DataFrame) -> None:
    """Refuse a table that is incomplete or has changed since it was sealed."""
    kept, now = sealed.first(), table_digest(df, columns).first()
    if not kept["complete"]:
        raise ValueError("an incomplete table can not be scored")
    if now["content_sha256"] != kept["content_sha256"]:
        raise ValueError("the table changed after sealing")


# --------------------------------------------------------------------------- logs


def sequence_audit(log: DataFrame, by: Sequence[str], sequence: str) -> DataFrame:
    """Per log: rows, first and last number, repeats, gaps, and whether it runs 1, 2, 3, ...

    A gap is a number without its predecessor, found by one equi-join on (log, number): no log
    is ordered in a single task, however long it is.
    """
    numbers = log.groupBy(*by, sequence).agg(F.count(F.lit(1)).alias("_n"))
    previous = numbers.select(*by, (F.col(sequence) + 1).alias(sequence), F.lit(1).alias("_has"))
    linked = join_on(numbers, previous, [*by, sequence], "left")
    out = linked.groupBy(*by).agg(
        F.sum("_n").alias("rows"),
        F.min(sequence).alias("first_number"),
        F.max(sequence).alias("last_number"),
        F.sum(F.col("_n") - 1).alias("repeats"),
        F.sum(flag(F.col("_has").isNull())).alias("_starts"),
    )
    return out.select(
        *by,
        "rows",
        "first_number",
        "last_number",
        "repeats",
        (F.col("_starts") - 1).alias("gaps"),
        flag((F.col("first_number") == 1) & (F.col("repeats") == 0) & (F.col("_starts") == 1)).alias("contiguous"),
    )


def record_audit(records: DataFrame, manifest: DataFrame, payload: str) -> DataFrame:
    """(check, violations) of stored records against their manifest and their own hashes.

    ``records``: case_id, ordinal, ``payload``, payload_sha256, attempt, source_attempt.
    ``manifest``: case_id, ordinal.
    """
    planned = manifest.select("case_id", F.col("ordinal").alias("_planned"))
    rows = records.join(planned, "case_id", "left")
    later = F.col("attempt") > 1
    rules = {
        "unknown_case": F.col("_planned").isNull(),
        "ordinal_differs": F.col("_planned").isNotNull() & (F.col("ordinal") != F.col("_planned")),
        "payload_hash_differs": F.sha2(payload, 256) != F.col("payload_sha256"),
        "first_attempt_has_source": ~later & F.col("source_attempt").isNotNull(),
        "later_attempt_without_earlier_source": later
        & ~F.coalesce((F.col("source_attempt") >= 1) & (F.col("source_attempt") < F.col("attempt")), F.lit(False)),
    }
    wide = rows.agg(*[F.coalesce(F.sum(flag(t)), F.lit(0)).alias(n) for n, t in rules.items()])
    cells = [F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in rules]
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def first_seen(log: DataFrame, by: Sequence[str], identity: Column, sequence: str) -> DataFrame:
    """Each row with the first number its text had in the same run, and whether it repeats it.

    The first number per text is a combinable minimum joined back, not a window: copies of one
    text are never gathered.
    """
    rows = log.withColumn("text_sha256", F.sha2(identity, 256))
    firsts = rows.groupBy(*by, "text_sha256").agg(F.min(sequence).alias("first_seen"))
    return join_on(rows, firsts, [*by, "text_sha256"]).withColumn(
        "is_duplicate", flag(F.col(sequence) > F.col("first_seen"))
    )


def resume(cases: DataFrame, done: DataFrame, case_id: str, order: str, most: int | None = None) -> DataFrame:
    """Cases not yet recorded, in manifest order, at most ``most`` new ones if asked."""
    if most is not None and most < 1:
        raise ValueError("the number of new cases must be positive")
    left = cases.join(done.select(case_id).distinct(), case_id, "left_anti").orderBy(order, case_id)
    return left if most is None else left.limit(most)
