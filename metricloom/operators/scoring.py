"""Layered case scoring, intervals, summaries, paired differences and failure attribution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.joins import join_on
from metricloom.functions.scope import flag, safe_ratio
from metricloom.operators.quality import key_audit
from metricloom.operators.ranking import exact_quantiles

# The normal quantile of a 95% interval.
Z_95 = 1.959963984540054

# Accuracy names and the case columns they average.
ACCURACIES = (
    ("case_contract_accuracy", "case_contract_correct"),
    ("sql_generation_rate", "sql_generation_success"),
    ("sql_behavior_accuracy", "sql_behavior_correct"),
    ("sqlite_execution_rate", "execution_started"),
    ("sql_execution_success_rate", "execution_success"),
    ("execution_behavior_accuracy", "execution_behavior_correct"),
    ("source_result_accuracy", "source_result_correct"),
    ("result_accuracy", "result_correct"),
    ("workflow_status_accuracy", "status_correct"),
    ("stop_reason_accuracy", "stop_reason_correct"),
    ("calculation_status_accuracy", "calculation_status_correct"),
    ("safety_behavior_accuracy", "safety_correct"),
    ("lineage_accuracy", "lineage_correct"),
    ("attempt_accounting_accuracy", "attempt_accounting_correct"),
    ("business_accuracy", "business_correct"),
)

# Scorer failure code to the boundary it points at.
FAILURE_BOUNDARIES = {
    "named_parameter_contract": "sql_generation",
    "sql_behavior": "sql_generation",
    "sql_behavior_mismatch": "sql_generation",
    "candidate_sql_safety_rejected": "safety_gate",
    "execution_trace": "sql_execution",
    "execution_behavior": "sql_execution",
    "execution_behavior_mismatch": "sql_execution",
    "source_result_mismatch": "result_semantics",
    "result_mismatch": "result_semantics",
    "workflow_status": "workflow_state",
    "workflow_status_mismatch": "workflow_state",
    "stop_reason": "workflow_state",
    "stop_reason_mismatch": "workflow_state",
    "calculation_status": "deterministic_calculation",
    "calculation_status_mismatch": "deterministic_calculation",
    "safety_behavior": "candidate_safety_choice",
    "safety_behavior_mismatch": "candidate_safety_choice",
    "lineage": "lineage",
    "lineage_mismatch": "lineage",
    "attempt_accounting": "repair_control",
    "attempt_accounting_mismatch": "repair_control",
    "unexpected_business_result": "result_semantics",
}


# --------------------------------------------------------------------------- cases


def lineage_holds(parent_run: Column, run: Column, source_attempt: Column, attempts: Column) -> Column:
    """A calculation cites its own run and one of that run's statement attempts."""
    return F.coalesce((parent_run == run) & source_attempt.between(F.lit(1), attempts), F.lit(False))


def score_cases(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of layer booleans per submitted case, the contract verdict and failure codes.

    ``outputs`` carries, besides the submission, what verification found: ``sql_is_safe``,
    ``parameters_ok``, ``verified_started``, ``verified_succeeded``, ``rows_truncated``,
    ``source_result_correct`` and ``result_correct`` (the last two from result comparison).
    Everything is a row expression after one join on the case id.
    """
    c = F.col
    rows = outputs.join(cases, "case_id")
    has_sql = c("generated_sql").isNotNull()
    graded = c("expects_result")
    safe_sql = ~has_sql | c("sql_is_safe")
    params_ok = ~has_sql | c("parameters_ok")
    ran = graded & has_sql & c("sql_is_safe")
    started = F.when(ran, c("verified_started")).otherwise(c("execution_started"))
    success = F.when(ran, c("verified_succeeded")).otherwise(c("execution_succeeded"))
    verified = F.coalesce(ran & c("verified_started") & c("verified_succeeded"), F.lit(False))
    quiet = ~c("execution_started") & (c("repair_attempt_count") == 0)
    safety = (
        F.when(c("safety_decision") == "reject_before_sqlite", (c("safety_outcome") == "rejected") & quiet & ~has_sql)
        .when(c("safety_decision") == "not_applicable", (c("safety_outcome") == "not_evaluated") & quiet)
        .otherwise(safe_sql & (c("safety_outcome") == "accepted"))
    )
    source_ok = F.when(graded, F.when(verified, F.coalesce(c("source_result_correct"), F.lit(False))).otherwise(False))
    unexpected = ~graded & ((F.size("result_columns") > 0) | (F.size("result_rows") > 0))
    result_ok = F.when(graded, c("result_correct")).when(unexpected, F.lit(False))
    trace_ok = (c("execution_started") == started) & (c("execution_succeeded") == success)
    execution_ok = F.when(graded, verified & source_ok & ~c("rows_truncated") & trace_ok).otherwise(
        (c("execution_started") == c("expected_execution_started")) & ~c("execution_succeeded")
    )
    lineage = (c("category") != "multi_step") | (
        lineage_holds(
            c("calculation_parent_run_id"), c("run_id"), c("calculation_source_sql_attempt"), c("sql_attempt_count")
        )
        & (c("numeric_source") == "deterministic_python")
    )
    repaired = (c("repair_attempt_count") > 0) | (c("repair_transport_attempt_count") > 0)
    attempts = (
        (c("repair_attempt_count") <= c("maximum_repair_attempts"))
        & (c("allows_repair") | ~repaired)
        & F.when(has_sql, c("sql_attempt_count") >= 1).otherwise(c("sql_attempt_count") == 0)
    )
    layers = {
        "sql_generation_success": has_sql,
        "sql_behavior_correct": (has_sql == c("sql_expected")) & params_ok,
        "execution_success": success,
        "execution_behavior_correct": execution_ok,
        "status_correct": c("workflow_status") == c("expected_workflow_status"),
        "stop_reason_correct": F.array_contains("allowed_stop_reasons", c("stop_reason")),
        "calculation_status_correct": c("calculation_status") == c("expected_calculation_status"),
        "source_result_correct": source_ok,
        "result_correct": result_ok,
        "safety_correct": safety,
        "lineage_correct": lineage,
        "attempt_accounting_correct": attempts,
    }
    early = [
        F.when(~params_ok, F.lit("named_parameter_contract_mismatch")),
        F.when(has_sql & ~c("sql_is_safe"), F.lit("candidate_sql_safety_rejected")),
        F.when(graded & ~trace_ok, F.lit("candidate_execution_trace_mismatch")),
        F.when(unexpected, F.lit("unexpected_business_result")),
    ]
    scored = rows.select("case_id", "run_id", "category", started.alias("execution_started"), F.array_compact(F.array(*early)).alias("_early"), *[v.alias(n) for n, v in layers.items()])
    checks = (
        ("sql_behavior_mismatch", "sql_behavior_correct"),
        ("execution_behavior_mismatch", "execution_behavior_correct"),
        ("workflow_status_mismatch", "status_correct"),
        ("stop_reason_mismatch", "stop_reason_correct"),
        ("calculation_status_mismatch", "calculation_status_correct"),
        ("safety_behavior_mismatch", "safety_correct"),
        ("lineage_mismatch", "lineage_correct"),
        ("attempt_accounting_mismatch", "attempt_accounting_correct"),
        ("source_result_mismatch", "source_result_correct"),
        ("result_mismatch", "result_correct"),
    )
    failed = F.array_compact(F.array(*[F.when(~c(column), F.lit(code)) for code, column in checks]))
    return (
        scored.withColumn("business_correct", F.lit(None).cast("boolean"))
        .withColumn("case_contract_correct", F.size(failed) == 0)
        .withColumn("failure_categories", F.array_distinct(F.concat("_early", failed)))
        .drop("_early")
    )


# The row contract of a submission.
SUBMISSION_RULES = {
    "parameters_without_sql": "generated_sql IS NOT NULL OR size(named_parameters) = 0",
    "attempts_without_sql": "generated_sql IS NOT NULL OR sql_attempt_count = 0",
    "success_without_start": "execution_started OR NOT execution_succeeded",
    "repair_transport_without_repair": "repair_attempt_count > 0 OR repair_transport_attempt_count = 0",
    "rows_without_columns": "size(result_rows) = 0 OR size(result_columns) > 0",
    "negative_attempts": "least(sql_attempt_count, repair_attempt_count, generation_transport_attempt_count, repair_transport_attempt_count) >= 0",
}


def submission_audit(outputs: DataFrame, cases: DataFrame, rules: dict[str, str] = SUBMISSION_RULES) -> DataFrame:
    """(check, violations): repeated ids, missing and extra cases, and row contract violations."""
    repeated = key_audit(outputs, ("case_id",)).select(F.lit("duplicate_case_id").alias("check"), F.col("duplicate_rows").alias("violations"))
    got = outputs.select("case_id").distinct().withColumn("_got", F.lit(1))
    want = cases.select("case_id").distinct().withColumn("_want", F.lit(1))
    sides = got.join(want, "case_id", "full").agg(
        F.coalesce(F.sum(flag(F.col("_got").isNull())), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(flag(F.col("_want").isNull())), F.lit(0)).alias("extra"),
    )
    broken = outputs.agg(
        *[F.coalesce(F.sum(flag(~F.expr(rule))), F.lit(0)).alias(name) for name, rule in rules.items()]
    )

    def tall(frame: DataFrame, names) -> DataFrame:
        cells = [F.struct(F.lit(shown).alias("check"), F.col(source).alias("violations")) for shown, source in names]
        return frame.select(F.explode(F.array(*cells)).alias("r")).select("r.*")

    return (
        repeated.unionByName(tall(sides, (("missing_case_id", "missing"), ("extra_case_id", "extra"))))
        .unionByName(tall(broken, [(n, n) for n in rules]))
    )


# --------------------------------------------------------------------------- intervals and summaries


def wilson(numerator: str, denominator: str) -> list[Column]:
    """Rate and 95% Wilson bounds, NULL at 0 trials and exact at 0 or all successes."""
    k, n = F.col(numerator).cast("double"), F.col(denominator).cast("double")
    z2 = Z_95 * Z_95
    rate = safe_ratio(k, n)
    scale = F.lit(1.0) + F.try_divide(F.lit(z2), n)
    center = (rate + F.try_divide(F.lit(z2), 2 * n)) / scale
    margin = F.lit(Z_95) * F.sqrt(F.try_divide(rate * (1 - rate), n) + F.try_divide(F.lit(z2), 4 * n * n)) / scale
    low = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), center - margin))
    high = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), center + margin))
    present = n > 0
    return [
        rate.alias("rate"),
        F.when(present, low).alias("wilson_low"),
        F.when(present, high).alias("wilson_high"),
    ]


def slice_summary(scored: DataFrame, slice_by: str, accuracies=ACCURACIES) -> DataFrame:
    """(slice, metric, numerator, denominator, rate, bounds) per slice and over all cases.

    NULL layers leave the denominator. Counting is one wide aggregate per slice; the overall row
    adds the slices up instead of reading the cases again.
    """
    counts = scored.groupBy(F.col(slice_by).alias("slice")).agg(
        *[F.sum(flag(F.col(c))).alias(f"k_{m}") for m, c in accuracies],
        *[F.count(c).alias(f"n_{m}") for m, c in accuracies],
    )
    sums = [F.sum(n).alias(n) for n in counts.columns if n != "slice"]
    everything = counts.unionByName(counts.agg(*sums).withColumn("slice", F.lit("overall")))
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(f"k_{m}").alias("numerator"), F.col(f"n_{m}").alias("denominator"))
        for m, _ in accuracies
    ]
    tall = everything.select("slice", F.explode(F.array(*cells)).alias("r")).select("slice", "r.*")
    return tall.select("*", *wilson("numerator", "denominator"))


def failure_counts(scored: DataFrame, slice_by: str, failures: str = "failure_categories") -> DataFrame:
    """Cases per failure code, per slice and overall."""
    each = scored.select(F.explode(F.array(F.col(slice_by), F.lit("overall"))).alias("slice"), failures)
    return (
        each.select("slice", F.explode(failures).alias("failure"))
        .groupBy("slice", "failure")
        .agg(F.count(F.lit(1)).alias("cases"))
    )


def operational_summary(
    records: DataFrame,
    by: Sequence[str],
    latency: str,
    totals: Sequence[str],
    calls: str,
    currency: str | None = None,
) -> DataFrame:
    """Mean, median and nearest-rank p95 latency; totals that are NULL if any input is NULL.

    The quantiles are exact. They come from counts per distinct value with block-wise running
    ranks, so a slice holding most rows is not gathered anywhere.
    """
    all_given = {t: F.when(F.count(t) == F.count(F.lit(1)), F.sum(t)) for t in totals}
    basics = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("case_count"),
        F.avg(latency).alias("mean_latency"),
        F.coalesce(F.sum(calls), F.lit(0)).alias("call_total"),
        F.sum(flag(F.col(calls) > 0)).alias("cases_with_calls"),
        *[F.count(t).alias(f"{t}_available") for t in totals],
        *[column.alias(f"{t}_total") for t, column in all_given.items()],
        *(
            [
                F.when(F.min(currency) == F.max(currency), F.min(currency)).alias("currency"),
            ]
            if currency
            else []
        ),
    )
    n = F.col("n")
    ranked = exact_quantiles(
        records,
        by,
        latency,
        {
            "_low": F.floor((n + 1) / 2),
            "_high": F.floor(n / 2) + 1,
            "p95_latency": F.greatest(F.lit(1), F.ceil(n * 95 / 100)),
        },
    ).select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("median_latency"), "p95_latency")
    if by:
        return join_on(basics, ranked, list(by), "left")
    return basics.withColumns({name: ranked.select(name).scalar() for name in ranked.columns})


# --------------------------------------------------------------------------- paired comparison

# Hashes that are made at once, and about how many one task makes.
STRETCH, DRAWS_PER_TASK = 8192, 1 << 24
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()


def md5_words(texts: np.ndarray) -> np.ndarray:
    """MD5 of many texts of one length, at most 55 bytes: a row each in, four words as their hex digits read out.

    ``hashlib`` takes one text at a time; here a whole array goes through each of the 64 steps.
    """
    rows, length = texts.shape
    if length > 55:
        raise ValueError("texts of one block only")
    block = np.zeros((rows, 64), np.uint8)
    block[:, :length] = texts
    block[:, length] = 0x80
    block[:, 56:58] = length * 8 & 0xFF, length * 8 >> 8
    words = np.ascontiguousarray(block.view("<u4").T)
    # A word that is the same for all texts stays one number.
    m = [w[:1] if (w == w[0]).all() else w for w in words]
    start = [np.full(rows, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g] + _SINES[i]
        turn = np.uint32(_TURNS[i])
        a, d, c, b = d, c, b, b + (f << turn | f >> (np.uint32(32) - turn))
    return np.stack([x + y for x, y in zip((a, b, c, d), start, strict=True)], axis=1).byteswap()


def _drawn(seed: int, resample: int, first: int, end: int, n: int, down: int, up: int) -> int:
    """Sum of the draws of a resample from its hashes ``first`` to ``end``, four from each; there are ``n``."""
    head, total = f"{seed}|{resample}|".encode(), 0
    while first < end:
        # Numbers of as many digits make texts of one length.
        digits = len(str(first))
        to = min(end, 10**digits)
        numbers = np.arange(first, to)
        texts = np.empty((to - first, len(head) + digits), np.uint8)
        texts[:, : len(head)] = np.frombuffer(head, np.uint8)
        for k in range(digits):
            texts[:, len(head) + k] = numbers // 10 ** (digits - 1 - k) % 10 + 48
        spots = (md5_words(texts) % np.uint32(n) if n < 1 << 32 else md5_words(texts)).ravel()[: n - 4 * first]
        total += int((spots >= n - up).sum()) - int((spots < down).sum())
        first = to
    return total


def paired_difference(
    left: DataFrame,
    right: DataFrame,
    metric: str,
    resamples: int = 10_000,
    seed: int = 15_015,
) -> DataFrame:
    """Outcome counts of jointly evaluated cases and a percentile bootstrap of the difference.

    A resampled mean depends only on how often each of -1, 0 and +1 is drawn. Draws come from hashes of
    (seed, resample, position) and so are independent of partitioning, and of the same kind at every
    size: ``resamples`` times the number of pairs, four from each hash, made and summed in the tasks.
    """
    if resamples < 1:
        raise ValueError("resamples must be positive")
    a = left.select("case_id", F.col(metric).alias("l"), F.lit(1).alias("_l"))
    b = right.select("case_id", F.col(metric).alias("r"), F.lit(1).alias("_r"))
    joined = a.join(b, "case_id", "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    l, r = F.col("l"), F.col("r")
    counts = joined.agg(
        F.coalesce(F.sum(flag(F.col("_l").isNull() | F.col("_r").isNull())), F.lit(0)).alias("unpaired"),
        F.sum(flag(both)).alias("paired_case_count"),
        F.sum(flag(both & l)).alias("left_correct_count"),
        F.sum(flag(both & r)).alias("right_correct_count"),
        F.sum(flag(both & ~l & r)).alias("improved_count"),
        F.sum(flag(both & l & ~r)).alias("regressed_count"),
        F.sum(flag(both & l & r)).alias("tied_correct_count"),
        F.sum(flag(both & ~l & ~r)).alias("tied_incorrect_count"),
    )
    # Three bounded numbers decide how to draw; this is the one value that reaches the driver.
    known = counts.first()
    if known["unpaired"]:
        raise ValueError("both sides must hold the same case ids")
    n, down, up = known["paired_case_count"], known["regressed_count"], known["improved_count"]
    if not n:
        raise ValueError(f"no jointly evaluated cases for {metric}")
    spark = left.sparkSession
    fours = -(-n // 4)
    stretches = -(-fours // STRETCH)
    asked = spark.range(0, resamples * stretches, 1, min(resamples * stretches, max(spark.sparkContext.defaultParallelism, resamples * fours // DRAWS_PER_TASK)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, stretch = np.divmod(batch.column(0).to_numpy(), stretches)
            sums = [_drawn(seed, int(x), int(y) * STRETCH, min(fours, (int(y) + 1) * STRETCH), n, down, up) for x, y in zip(b, stretch, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(sums, pa.int64())], ["b", "d"])

    # A resample is a stretch of neighbouring numbers, so each task sends one sum for each of its own.
    means = asked.mapInArrow(draw, "b long, d long").groupBy("b").agg((F.sum("d") / F.lit(n)).alias("mean"))
    low = max(0, resamples * 25 // 1000) + 1
    high = min(resamples, -(-resamples * 975 // 1000))
    place = F.row_number().over(Window.orderBy("mean", "b"))  # one row per resample, never per case
    bounds = means.select("mean", place.alias("p")).agg(
        F.max(F.when(F.col("p") == low, F.col("mean"))).alias("bootstrap_low"),
        F.max(F.when(F.col("p") == high, F.col("mean"))).alias("bootstrap_high"),
    )
    return bounds.select(
        F.lit(metric).alias("metric"),
        *[F.lit(known[c]).cast("bigint").alias(c) for c in counts.columns if c != "unpaired"],
        F.lit((up - down) / n).alias("right_minus_left"),
        "bootstrap_low",
        "bootstrap_high",
        F.lit(resamples).alias("bootstrap_resamples"),
    )


# --------------------------------------------------------------------------- failures


def diagnose_failures(scored: DataFrame) -> DataFrame:
    """Boundaries of each failed case in order, the first being the primary one.

    Needs the scored layers plus ``expected_workflow_status``, ``generated_sql``,
    ``repair_attempt_count``, ``allows_repair``, ``submitted_execution_started`` and
    ``output_contract_error``.
    """
    c = F.col
    table = F.create_map(*[F.lit(x) for pair in FAILURE_BOUNDARIES.items() for x in pair])
    mapped = F.array_compact(F.transform("failure_categories", lambda f: F.try_element_at(table, f)))
    has_sql = c("generated_sql").isNotNull()
    wrong_numbers = c("execution_success") & (
        ~F.coalesce(c("source_result_correct"), F.lit(True)) | ~F.coalesce(c("result_correct"), F.lit(True))
    )
    expected = c("expected_workflow_status")
    # The rule named last goes in front of all others.
    overrides = (
        ("environment_propagation", (expected == "environment_failed") & c("submitted_execution_started")),
        ("repair_control", (c("repair_attempt_count") > 0) & ((expected == "resource_failed") | ~c("allows_repair"))),
        ("candidate_safety_choice", (expected == "safety_rejected") & has_sql),
        ("planning_semantics", expected.isin("needs_clarification", "planning_failed") & has_sql),
        ("result_semantics", wrong_numbers),
    )
    front = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in overrides]))
    found = F.array_distinct(F.concat(front, mapped))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("workflow_state")))
    found = F.when(c("output_contract_error").isNotNull(), F.array(F.lit("output_contract"))).otherwise(found)
    return scored.withColumn("affected_boundaries", found).withColumn(
        "primary_boundary", F.element_at("affected_boundaries", 1)
    )


def representatives(failures: DataFrame, order: str, minimum: int = 10) -> DataFrame:
    """The first failure of each (version, primary boundary), then the earliest others, to ``minimum``.

    A case can fail in several versions, so rows are told apart by version and boundary too. There
    are few version-boundary pairs, so the covering set is small; the fill is one top-k. Fewer
    failures than ``minimum`` are refused.
    """
    if minimum < 1:
        raise ValueError("minimum must be positive")
    group = ("version", "primary_boundary")
    firsts = failures.groupBy(*group).agg(F.min(order).alias(order)).withColumn("_first", F.lit(0))
    marked = join_on(failures, firsts, [*group, order], "left").withColumn("_first", F.coalesce("_first", F.lit(1)))
    covering = marked.filter(F.col("_first") == 0)
    filler = marked.filter(F.col("_first") == 1).orderBy(order, "version").limit(minimum)
    if failures.limit(minimum).count() < minimum:
        raise ValueError(f"fewer than {minimum} failures")
    ranked = covering.unionByName(filler).withColumn("selection_rank", F.row_number().over(Window.orderBy("_first", order, "version")))
    return ranked.filter((F.col("_first") == 0) | (F.col("selection_rank") <= minimum)).drop("_first")


def outcome_summary(log: DataFrame, by: Sequence[str], outcome: str, named: dict[str, Column], rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Counts per outcome value, named conditional counts, and NULL-safe rates between them."""
    counts = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[F.sum(flag(test)).alias(name) for name, test in named.items()]
    )
    summary = counts.withColumns({name: safe_ratio(F.col(a), F.col(b)) for name, (a, b) in rates.items()})
    shown = [*named, "total", *rates]
    cells = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in shown]
    wide = summary.select(*by, F.explode(F.array(*cells)).alias("r")).select(*by, "r.*")
    values = log.groupBy(*by, F.concat(F.lit("outcome:"), outcome).alias("measure")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    return reduce(lambda a, b: a.unionByName(b), [wide, values.select(*by, "measure", "value")])
