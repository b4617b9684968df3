"""Result comparison, scoring statistics, ledgers, lineage and record audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.text import squeezed
from metricloom.operators.ledger import (
    changed_rows,
    estimated_tokens,
    first_breaches,
    first_seen,
    input_hash,
    lineage_check,
    record_audit,
    resume,
    seal,
    sequence_audit,
    usage_ledger,
)
from metricloom.operators.result_diff import DiffRules, diff_results, unmatched_rows, verify_references
from metricloom.operators.scoring import (
    diagnose_failures,
    failure_counts,
    operational_summary,
    outcome_summary,
    paired_difference,
    representatives,
    score_cases,
    slice_summary,
    submission_audit,
    wilson,
)
from metricloom.plans.catalog import CUSTOMER_STATE, PURCHASE_MONTH
from metricloom.plans.reports import REPORTS
from metricloom.plans.series_metrics import monthly_gmv
from metricloom.session import written
from registry.common import MONEY, PERIOD, bound_star, star, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- result comparison


def _line_sides(spark, folder):
    """Prices per line number, and the same prices moved, dropped or left alone by line number."""
    lines = tables(spark, folder)("lineitem")
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    moved = (
        F.when(n == 1, price + 0.004)
        .when((n == 3) & (F.col("l_quantity") > 49), price + 0.02)
        .when(n == 5, price + F.when(F.col("l_discount") > 0.05, 0.009).otherwise(-0.009))
        .otherwise(price)
    )
    gone = (n == 4) & (F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50)
    expected = lines.select("l_linenumber", "l_returnflag", price.alias("price"))
    actual = lines.filter(~gone).select("l_linenumber", "l_returnflag", moved.alias("price"))
    return expected, actual


def _diff_lines(spark, folder):
    expected, actual = _line_sides(spark, folder)
    rules = DiffRules(("l_returnflag", "price"), {"price": (0.01, 0.0)})
    return diff_results(expected, actual, rules, by=("l_linenumber",))


QUERIES["evaluate_result_diff_multiset"] = _diff_lines
ORACLES["evaluate_result_diff_multiset"] = """WITH a AS (SELECT l_linenumber, l_returnflag, CASE WHEN l_linenumber = 1 THEN l_extendedprice + 0.004
    WHEN l_linenumber = 3 AND l_quantity > 49 THEN l_extendedprice + 0.02
    WHEN l_linenumber = 5 THEN l_extendedprice + CASE WHEN l_discount > 0.05 THEN 0.009 ELSE -0.009 END ELSE l_extendedprice END AS v
  FROM lineitem WHERE NOT (l_linenumber = 4 AND l_returnflag = 'R' AND l_quantity = 50)),
er AS (SELECT l_linenumber, l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_linenumber, l_returnflag ORDER BY l_extendedprice) AS rk FROM lineitem),
ar AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber, l_returnflag ORDER BY v) AS rk FROM a),
j AS (SELECT coalesce(er.l_linenumber, ar.l_linenumber) AS n, er.v AS ev, ar.v AS av FROM er FULL JOIN ar ON er.l_linenumber = ar.l_linenumber AND er.l_returnflag = ar.l_returnflag AND er.rk = ar.rk),
s AS (SELECT n, count(ev) AS e, count(av) AS a, count(*) FILTER (ev IS NULL OR av IS NULL OR NOT abs(ev - av) <= 0.01) AS bad FROM j GROUP BY 1)
SELECT n AS l_linenumber, 1 AS columns_correct, CAST(e = a AS INTEGER) AS row_count_correct, CAST(e = a AND bad = 0 AS INTEGER) AS values_correct, 1 AS order_correct,
CAST(e = a AND bad = 0 AS INTEGER) AS result_correct, e AS expected_rows, a AS actual_rows,
concat_ws(',', CASE WHEN e <> a THEN 'row_count_mismatch' END, CASE WHEN NOT (e = a AND bad = 0) THEN 'row_value_mismatch' END) AS issues FROM s"""


def _diff_ordered(spark, folder):
    events = tables(spark, folder)("events")
    base = events.select("event_type", "user_id", "value", F.col("event_id").alias("position"))
    shifted = events.select(
        "event_type",
        F.when(F.col("event_type") == "error", F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        (F.col("value") + F.when(F.col("event_type") == "click", 0.001).otherwise(0.0)).alias("value"),
        F.when(F.col("event_type") == "view", -F.col("event_id")).otherwise(F.col("event_id")).alias("position"),
    )
    rules = DiffRules(("user_id", "value"), {"value": (0.01, 1e-9)}, position="position")
    return diff_results(base, shifted, rules, by=("event_type",))


QUERIES["evaluate_result_diff_ordered"] = _diff_ordered
ORACLES["evaluate_result_diff_ordered"] = """SELECT event_type, 1 AS columns_correct, 1 AS row_count_correct, CAST(event_type <> 'error' AS INTEGER) AS values_correct,
CAST(event_type NOT IN ('error', 'view') AS INTEGER) AS order_correct, CAST(event_type NOT IN ('error', 'view') AS INTEGER) AS result_correct,
count(*) AS expected_rows, count(*) AS actual_rows, CASE event_type WHEN 'error' THEN 'row_value_mismatch' WHEN 'view' THEN 'row_order_mismatch' ELSE '' END AS issues FROM events GROUP BY 1"""


def _two_numbers(spark, folder):
    customers = tables(spark, folder)("customer")
    expected = customers.select("c_nationkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 1.0).alias("y"))
    wrong = (F.col("c_nationkey") == 4) & (F.col("c_mktsegment") == "BUILDING")
    actual = customers.select(
        "c_nationkey",
        (F.col("c_acctbal") + 0.004).alias("x"),
        F.when(wrong, F.col("c_custkey") + 0.4).otherwise(F.col("c_custkey") + 0.2).alias("y"),
    )
    return expected, actual, DiffRules(("x", "y"), {"x": (0.01, 0.0), "y": (0.25, 0.0)})


def _diff_two_numbers(spark, folder):
    """Two tolerant columns without any exact column: the general pairing."""
    expected, actual, rules = _two_numbers(spark, folder)
    return diff_results(expected, actual, rules, by=("c_nationkey",))


def _unmatched(spark, folder):
    expected, actual, rules = _two_numbers(spark, folder)
    return unmatched_rows(expected, actual, rules, by=("c_nationkey",))


QUERIES["evaluate_unmatched_rows"] = _unmatched
ORACLES["evaluate_unmatched_rows"] = """SELECT c_nationkey, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y, CAST(1 AS BIGINT) AS unmatched FROM customer
WHERE c_nationkey = 4 AND c_mktsegment = 'BUILDING'"""


def _diff_chain(spark, folder):
    """Every order close to its neighbours, in one chain, and one value a billion times as large."""
    orders = tables(spark, folder)("orders")
    place = F.col("o_orderkey") * 0.004
    outlier = spark.range(1).select(F.lit("F").alias("o_orderstatus"), F.lit(1e12).alias("x"), F.lit(1.0).alias("y"))
    expected = orders.select("o_orderstatus", place.alias("x"), (F.col("o_custkey") % 7).cast("double").alias("y"))
    moved = F.when(F.col("o_custkey") % 7 == 3, 0.009).otherwise(0.001)
    lost = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") == F.lit(orders.filter("o_orderstatus = 'P'").agg(F.min("o_orderkey")).scalar()))
    actual = orders.select("o_orderstatus", (place + moved).alias("x"), F.when(lost, 1e6).otherwise((F.col("o_custkey") % 7).cast("double")).alias("y"))
    rules = DiffRules(("x", "y"), {"x": (0.01, 1e-9), "y": (0.5, 0.0)})
    return diff_results(expected.union(outlier), actual.union(outlier), rules, by=("o_orderstatus",))


QUERIES["evaluate_result_diff_dense_chain"] = _diff_chain
ORACLES["evaluate_result_diff_dense_chain"] = """SELECT o_orderstatus, 1 AS columns_correct, 1 AS row_count_correct, CAST(o_orderstatus <> 'P' AS INTEGER) AS values_correct, 1 AS order_correct,
CAST(o_orderstatus <> 'P' AS INTEGER) AS result_correct, count(*) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS expected_rows, count(*) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS actual_rows,
CASE WHEN o_orderstatus = 'P' THEN 'row_value_mismatch' ELSE '' END AS issues FROM orders GROUP BY 1"""


QUERIES["evaluate_result_diff_two_tolerances"] = _diff_two_numbers
ORACLES["evaluate_result_diff_two_tolerances"] = """SELECT c_nationkey, 1 AS columns_correct, 1 AS row_count_correct, CAST(c_nationkey <> 4 AS INTEGER) AS values_correct, 1 AS order_correct,
CAST(c_nationkey <> 4 AS INTEGER) AS result_correct, count(*) AS expected_rows, count(*) AS actual_rows, CASE WHEN c_nationkey = 4 THEN 'row_value_mismatch' ELSE '' END AS issues FROM customer GROUP BY 1"""


def _verify(spark, folder):
    s = bound_star(spark, folder)
    checks = {}
    for name, key in (("gmv_by_month", PURCHASE_MONTH), ("payments_by_type", "payment_type"), ("gmv_by_seller_top10", "seller")):
        fresh = REPORTS[name](s, PERIOD)
        value = [c for c in fresh.columns if c != key][0]
        # Saved rows are files: they are written here and read back.
        saved = written(fresh.withColumn(value, F.col(value) + (0.5 if name == "payments_by_type" else 0.005)))
        checks[name] = (saved, fresh, DiffRules((key, value), {value: (0.01, 0.0)}))
    return verify_references(checks)


QUERIES["evaluate_verify_references"] = _verify
ORACLES["evaluate_verify_references"] = f"""WITH {star()}, n AS (
SELECT 'gmv_by_month' AS name, (SELECT count(DISTINCT purchase_month) FROM sales WHERE st = 'delivered' AND year(purchase_month) BETWEEN 1996 AND 2000) AS n, 1 AS ok
UNION ALL SELECT 'payments_by_type', (SELECT count(DISTINCT payment_type) FROM pay), 0 UNION ALL SELECT 'gmv_by_seller_top10', 10, 1)
SELECT name, 1 AS columns_correct, 1 AS row_count_correct, ok AS values_correct, 1 AS order_correct, ok AS result_correct, n AS expected_rows, n AS actual_rows,
CASE WHEN ok = 0 THEN 'row_value_mismatch' ELSE '' END AS issues FROM n"""

# ---------------------------------------------------------------- cases, derived from documents, labels and events


def _cases(spark, folder):
    docs = tables(spark, folder)("documents")
    long = F.col("n_chars") > 800
    return docs.select(
        F.col("doc_id").alias("case_id"),
        F.when(F.col("lang") == "en", "single_metric").when(F.col("lang") == "fr", "multi_step").otherwise("aggregate_filter_join").alias("category"),
        long.alias("sql_expected"),
        long.alias("expects_result"),
        F.when(long, "completed").otherwise("needs_clarification").alias("expected_workflow_status"),
        F.when(long, F.array(F.lit("done"), F.lit("done_with_notes"))).otherwise(F.array(F.lit("ask"))).alias("allowed_stop_reasons"),
        F.lit("computed").alias("expected_calculation_status"),
        F.when(long, "allow_read_only_execution").otherwise("not_applicable").alias("safety_decision"),
        F.lit(False).alias("expected_execution_started"),
        F.lit(1).alias("maximum_repair_attempts"),
        (F.col("source") != "src3").alias("allows_repair"),
    )


def _outputs(spark, folder):
    docs = tables(spark, folder)("documents")
    labels = tables(spark, folder)("labels")
    rows = docs.join(labels, "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    long = F.col("n_chars") > 800
    sql = F.when(long | toxic, F.lit("SELECT 1"))
    ran = sql.isNotNull() & good
    return rows.select(
        F.col("doc_id").alias("case_id"),
        F.concat(F.lit("run-"), "source").alias("run_id"),
        F.when(long & good, "completed").when(long, "failed").otherwise("needs_clarification").alias("workflow_status"),
        F.when(long, "done").when(toxic, "other").otherwise("ask").alias("stop_reason"),
        F.when(good, "computed").otherwise("not_computed").alias("calculation_status"),
        sql.alias("generated_sql"),
        F.create_map().cast("map<string,string>").alias("named_parameters"),
        F.when(sql.isNull(), "not_evaluated").when(good, "accepted").otherwise("rejected").alias("safety_outcome"),
        ran.alias("execution_started"),
        ran.alias("execution_succeeded"),
        F.when(ran, F.array(F.lit("v"))).otherwise(F.array().cast("array<string>")).alias("result_columns"),
        F.when(ran, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")).alias("result_rows"),
        F.when(F.col("lang") == "fr", "deterministic_python").otherwise("sql").alias("numeric_source"),
        F.when(sql.isNull(), 0).otherwise(1 + F.col("toxic")).alias("sql_attempt_count"),
        F.col("toxic").alias("repair_attempt_count"),
        F.lit(1).alias("generation_transport_attempt_count"),
        F.col("toxic").alias("repair_transport_attempt_count"),
        F.when(F.col("source") != "src5", F.concat(F.lit("run-"), "source")).alias("calculation_parent_run_id"),
        F.lit(1).alias("calculation_source_sql_attempt"),
        good.alias("sql_is_safe"),
        (F.col("doc_id") % 6 != 0).alias("parameters_ok"),
        (ran & (F.col("doc_id") % 7 != 0)).alias("verified_started"),
        (ran & (F.col("doc_id") % 5 != 0)).alias("verified_succeeded"),
        (F.col("doc_id") % 8 == 0).alias("rows_truncated"),
        (~toxic).alias("source_result_correct"),
        (good & ~toxic).alias("result_correct"),
    )


def _scored(spark, folder):
    return score_cases(_outputs(spark, folder), _cases(spark, folder))


def _score_rows(spark, folder):
    out = _scored(spark, folder)
    flags = [f.name for f in out.schema.fields if f.dataType.simpleString() == "boolean"]
    return out.select(
        "case_id", "run_id", "category", *[F.col(n).cast("int").alias(n) for n in flags],
        F.concat_ws(",", "failure_categories").alias("failure_categories"),
    )


_CASES = """x AS (SELECT d.*, quality = 1 AS good, toxic = 1 AS tox, toxic, n_chars > 800 AS lng, n_chars > 800 OR toxic = 1 AS sql FROM documents d JOIN labels USING (doc_id)),
y AS (SELECT *, sql AND good AS ran, CASE lang WHEN 'en' THEN 'single_metric' WHEN 'fr' THEN 'multi_step' ELSE 'aggregate_filter_join' END AS category FROM x),
w AS (SELECT *, CASE WHEN lng AND good THEN ran AND doc_id % 7 <> 0 ELSE ran END AS started, CASE WHEN lng AND good THEN ran AND doc_id % 5 <> 0 ELSE ran END AS success FROM y),
z AS (SELECT doc_id AS case_id, 'run-' || source AS run_id, category, sql AS sql_generation_success, sql = lng AND (NOT sql OR doc_id % 6 <> 0) AS sql_behavior_correct, started AS execution_started, success AS execution_success,
  CASE WHEN lng THEN started AND success AND good AND NOT tox AND doc_id % 8 <> 0 AND ran ELSE NOT ran END AS execution_behavior_correct, NOT lng OR good AS status_correct, lng OR NOT tox AS stop_reason_correct, good AS calculation_status_correct,
  CASE WHEN lng THEN good AND started AND success AND NOT tox END AS source_result_correct, CASE WHEN lng THEN good AND NOT tox WHEN ran THEN false END AS result_correct,
  CASE WHEN lng THEN good ELSE NOT sql AND NOT ran AND NOT tox END AS safety_correct,
  category <> 'multi_step' OR (source <> 'src5' AND sql) AS lineage_correct, source <> 'src3' OR NOT tox AS attempt_accounting_correct,
  sql AND NOT good AS unsafe, NOT lng AND ran AS stray, sql AND doc_id % 6 = 0 AS unnamed, lng AND (ran <> started OR ran <> success) AS untraced, tox, sql, source, lng, ran FROM w),
scored AS (SELECT *, CAST(NULL AS BOOLEAN) AS business_correct, list_filter(['sql_behavior_mismatch', 'execution_behavior_mismatch', 'workflow_status_mismatch', 'stop_reason_mismatch', 'calculation_status_mismatch',
    'safety_behavior_mismatch', 'lineage_mismatch', 'attempt_accounting_mismatch', 'source_result_mismatch', 'result_mismatch'],
    lambda f, i: NOT coalesce([sql_behavior_correct, execution_behavior_correct, status_correct, stop_reason_correct, calculation_status_correct, safety_correct, lineage_correct,
      attempt_accounting_correct, source_result_correct, result_correct][i], true)) AS late,
  list_filter([CASE WHEN unnamed THEN 'named_parameter_contract_mismatch' END, CASE WHEN unsafe THEN 'candidate_sql_safety_rejected' END,
    CASE WHEN untraced THEN 'candidate_execution_trace_mismatch' END, CASE WHEN stray THEN 'unexpected_business_result' END], lambda f: f IS NOT NULL) AS early FROM z)"""
_LAYERS = (
    "execution_started sql_generation_success sql_behavior_correct execution_success execution_behavior_correct status_correct stop_reason_correct calculation_status_correct "
    "source_result_correct result_correct safety_correct lineage_correct attempt_accounting_correct business_correct"
).split()
QUERIES["evaluate_score_cases"] = _score_rows
ORACLES["evaluate_score_cases"] = f"""WITH {_CASES} SELECT case_id, run_id, category, {', '.join(f'CAST({n} AS INTEGER) AS {n}' for n in _LAYERS)},
CAST(len(late) = 0 AS INTEGER) AS case_contract_correct, array_to_string(list_concat(early, late), ',') AS failure_categories FROM scored"""


def _slices(spark, folder):
    out = slice_summary(_scored(spark, folder), "category")
    return out.withColumns({n: F.round(n, 9) for n in ("rate", "wilson_low", "wilson_high")})


_WILSON = """CASE WHEN n > 0 THEN round(k / n, 9) END AS rate, CASE WHEN n > 0 THEN CASE WHEN k = 0 THEN 0.0 ELSE round(greatest(0, (k / n + z2 / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 9) END END AS wilson_low,
CASE WHEN n > 0 THEN CASE WHEN k = n THEN 1.0 ELSE round(least(1, (k / n + z2 / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 9) END END AS wilson_high"""
_Z = "(SELECT CAST(k AS DOUBLE) AS k, CAST(n AS DOUBLE) AS n, * EXCLUDE (k, n), 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS z2 FROM {t})"
_METRIC = dict(
    zip(
        "case_contract_correct sql_generation_success sql_behavior_correct execution_started execution_success execution_behavior_correct source_result_correct result_correct status_correct stop_reason_correct calculation_status_correct safety_correct lineage_correct attempt_accounting_correct business_correct".split(),
        "case_contract_accuracy sql_generation_rate sql_behavior_accuracy sqlite_execution_rate sql_execution_success_rate execution_behavior_accuracy source_result_accuracy result_accuracy workflow_status_accuracy stop_reason_accuracy calculation_status_accuracy safety_behavior_accuracy lineage_accuracy attempt_accounting_accuracy business_accuracy".split(),
    )
)
QUERIES["evaluate_slice_summary"] = _slices
ORACLES["evaluate_slice_summary"] = f"""WITH {_CASES}, b AS (SELECT *, len(late) = 0 AS case_contract_correct, unnest([category, 'overall']) AS slice FROM scored),
t AS ({' UNION ALL '.join(f"SELECT slice, '{m}' AS metric, count(*) FILTER ({c}) AS k, count({c}) AS n FROM b GROUP BY 1" for c, m in _METRIC.items())})
SELECT slice, metric, CAST(k AS BIGINT) AS numerator, CAST(n AS BIGINT) AS denominator, {_WILSON} FROM {_Z.format(t='t')}"""
QUERIES["evaluate_failure_counts"] = lambda spark, folder: failure_counts(_scored(spark, folder), "category")
ORACLES["evaluate_failure_counts"] = f"""WITH {_CASES}, b AS (SELECT unnest([category, 'overall']) AS slice, list_concat(early, late) AS f FROM scored)
SELECT slice, failure, count(*) AS cases FROM (SELECT slice, unnest(f) AS failure FROM b) GROUP BY 1, 2"""


def _wilson_by(spark, folder):
    t = tables(spark, folder)
    counts = t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source").agg(
        F.sum("quality").alias("numerator"), F.count(F.lit(1)).alias("denominator")
    )
    return counts.select("lang", "source", "numerator", "denominator", *[F.round(c, 9).alias(n) for c, n in zip(wilson("numerator", "denominator"), ("rate", "wilson_low", "wilson_high"))])


QUERIES["evaluate_wilson_intervals"] = _wilson_by
ORACLES["evaluate_wilson_intervals"] = f"""WITH t AS (SELECT lang, source, sum(quality) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, source, CAST(k AS BIGINT) AS numerator, CAST(n AS BIGINT) AS denominator, {_WILSON} FROM {_Z.format(t='t')}"""


def _submission(spark, folder):
    """Outputs with cases repeated, added and missing, and every row rule broken by some."""
    d, text = F.col("case_id"), F.array(F.lit("1"))
    rows = _outputs(spark, folder).withColumns(
        {
            "named_parameters": F.when(d % 7 == 0, F.create_map(F.lit("p"), F.lit("1"))).otherwise(F.col("named_parameters")),
            "sql_attempt_count": F.when(d % 5 == 0, 2).otherwise(F.col("sql_attempt_count")),
            "execution_succeeded": F.col("execution_succeeded") | (d % 9 == 0),
            "repair_transport_attempt_count": F.when(d % 17 == 0, 1).otherwise(F.col("repair_transport_attempt_count")),
            "result_rows": F.when(d % 19 == 0, text).otherwise(F.col("result_rows")),
            "generation_transport_attempt_count": F.when(d % 23 == 0, -1).otherwise(F.col("generation_transport_attempt_count")),
        }
    )
    return rows.unionByName(rows.filter(d % 11 == 0)).unionByName(rows.filter(d % 13 == 0).withColumn("case_id", -d - 1))


QUERIES["evaluate_submission_audit"] = lambda spark, folder: submission_audit(_submission(spark, folder), _cases(spark, folder))
ORACLES["evaluate_submission_audit"] = f"""WITH {_CASES}, s AS (SELECT case_id, case_id AS d, sql, ran, tox FROM z UNION ALL SELECT case_id, case_id, sql, ran, tox FROM z WHERE case_id % 11 = 0
  UNION ALL SELECT -case_id - 1, case_id, sql, ran, tox FROM z WHERE case_id % 13 = 0)
SELECT 'duplicate_case_id' AS "check", count(*) - count(DISTINCT case_id) AS violations FROM s UNION ALL SELECT 'missing_case_id', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT case_id FROM s))
UNION ALL SELECT 'extra_case_id', count(DISTINCT case_id) FILTER (case_id < 0) FROM s UNION ALL SELECT 'parameters_without_sql', count(*) FILTER (NOT sql AND d % 7 = 0) FROM s
UNION ALL SELECT 'attempts_without_sql', count(*) FILTER (NOT sql AND d % 5 = 0) FROM s UNION ALL SELECT 'success_without_start', count(*) FILTER (NOT ran AND d % 9 = 0) FROM s
UNION ALL SELECT 'repair_transport_without_repair', count(*) FILTER (NOT tox AND d % 17 = 0) FROM s UNION ALL SELECT 'rows_without_columns', count(*) FILTER (NOT ran AND d % 19 = 0) FROM s
UNION ALL SELECT 'negative_attempts', count(*) FILTER (d % 23 = 0) FROM s"""


def _failed(spark, folder):
    scored = _scored(spark, folder).filter(~F.col("case_contract_correct"))
    extra = _outputs(spark, folder).select(
        "case_id", "generated_sql", "repair_attempt_count", F.col("execution_started").alias("submitted_execution_started")
    )
    more = _cases(spark, folder).select("case_id", "expected_workflow_status", "allows_repair")
    full = scored.join(extra, "case_id").join(more, "case_id").withColumn("output_contract_error", F.lit(None).cast("string"))
    return diagnose_failures(full)


def _diagnosed(spark, folder):
    return _failed(spark, folder).select("case_id", "primary_boundary", F.concat_ws(",", "affected_boundaries").alias("affected"))


_BOUNDARY = "MAP {'sql_behavior_mismatch': 'sql_generation', 'candidate_sql_safety_rejected': 'safety_gate', 'execution_behavior_mismatch': 'sql_execution', 'source_result_mismatch': 'result_semantics', 'result_mismatch': 'result_semantics', 'workflow_status_mismatch': 'workflow_state', 'stop_reason_mismatch': 'workflow_state', 'calculation_status_mismatch': 'deterministic_calculation', 'safety_behavior_mismatch': 'candidate_safety_choice', 'lineage_mismatch': 'lineage', 'attempt_accounting_mismatch': 'repair_control', 'unexpected_business_result': 'result_semantics'}"
_DIAGNOSED = f"""{_CASES}, bm AS (SELECT unnest(map_keys(m)) AS code, unnest(map_values(m)) AS boundary FROM (SELECT {_BOUNDARY} AS m)),
fr AS (SELECT case_id, run_id, 0 AS part, i, b FROM (SELECT case_id, run_id, unnest([
    CASE WHEN tox AND source = 'src3' THEN 'repair_control' END, CASE WHEN NOT lng AND sql THEN 'planning_semantics' END,
    CASE WHEN execution_success AND (NOT coalesce(source_result_correct, true) OR NOT coalesce(result_correct, true)) THEN 'result_semantics' END]) AS b, unnest([1, 2, 3]) AS i FROM scored WHERE len(late) > 0) WHERE b IS NOT NULL),
cd AS (SELECT case_id, run_id, 1 AS part, i, boundary AS b FROM (SELECT case_id, run_id, unnest(f) AS code, generate_subscripts(f, 1) AS i FROM (SELECT case_id, run_id, list_concat(early, late) AS f FROM scored WHERE len(late) > 0)) JOIN bm USING (code)),
u AS (SELECT case_id, run_id, b, min(part * 100 + i) AS o FROM (SELECT * FROM fr UNION ALL SELECT * FROM cd) GROUP BY 1, 2, 3),
dg AS (SELECT case_id, run_id, arg_min(b, o) AS primary_boundary, string_agg(b, ',' ORDER BY o) AS affected FROM u GROUP BY 1, 2)"""
QUERIES["evaluate_diagnose_failures"] = _diagnosed
ORACLES["evaluate_diagnose_failures"] = f"WITH {_DIAGNOSED} SELECT case_id, primary_boundary, affected FROM dg"


def _representatives(spark, folder):
    failed = _failed(spark, folder).withColumn("version", F.col("category"))
    return representatives(failed, "case_id", 15).select("case_id", "version", "primary_boundary", F.col("selection_rank"))


QUERIES["evaluate_representative_failures"] = _representatives
ORACLES["evaluate_representative_failures"] = f"""WITH {_DIAGNOSED}, v AS (SELECT case_id, category AS version, primary_boundary FROM dg JOIN z USING (case_id)),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY version, primary_boundary ORDER BY case_id) > 1 AS INTEGER) AS later FROM v),
r AS (SELECT *, row_number() OVER (ORDER BY later, case_id) AS selection_rank FROM f) SELECT case_id, version, primary_boundary, selection_rank FROM r WHERE later = 0 OR selection_rank <= 15"""


def _shared_failures(spark, folder):
    """Every document fails under two versions, so case ids are shared."""
    docs = tables(spark, folder)("documents")
    version = F.explode(F.array(F.lit("first"), F.lit("second"))).alias("version")
    boundary = F.concat(F.col("source"), F.when(F.col("version") == "first", F.col("lang")).otherwise(F.lit("any")))
    failed = docs.select(F.col("doc_id").alias("case_id"), "lang", "source", version).withColumn("primary_boundary", boundary)
    return representatives(failed, "case_id", 150).select("case_id", "version", "primary_boundary", "selection_rank")


QUERIES["evaluate_representatives_of_versions"] = _shared_failures
ORACLES["evaluate_representatives_of_versions"] = """WITH v AS (
SELECT doc_id AS case_id, version, source || CASE WHEN version = 'first' THEN lang ELSE 'any' END AS primary_boundary FROM documents, (VALUES ('first'), ('second')) x(version)),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY version, primary_boundary ORDER BY case_id) > 1 AS INTEGER) AS later FROM v),
r AS (SELECT *, row_number() OVER (ORDER BY later, case_id, version) AS selection_rank FROM f) SELECT case_id, version, primary_boundary, selection_rank FROM r WHERE later = 0 OR selection_rank <= 150"""


def _paired(spark, folder):
    labels = tables(spark, folder)("labels")
    left = labels.select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") > 20, F.col("toxic") == 1).alias("ok"))
    right = labels.select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("ok"))
    out = paired_difference(left, right, "ok")
    return out.withColumns({n: F.round(n, 9) for n in ("right_minus_left", "bootstrap_low", "bootstrap_high")})


QUERIES["evaluate_paired_bootstrap"] = _paired
ORACLES["evaluate_paired_bootstrap"] = """WITH p AS (SELECT toxic = 1 AS l, quality = 1 AS r FROM labels WHERE doc_id > 20),
c AS (SELECT count(*) AS n, count(*) FILTER (l) AS lc, count(*) FILTER (r) AS rc, count(*) FILTER (NOT l AND r) AS up, count(*) FILTER (l AND NOT r) AS down,
  count(*) FILTER (l AND r) AS tied, count(*) FILTER (NOT l AND NOT r) AS neither FROM p),
h AS (SELECT b, q, md5('15015|' || b || '|' || q) AS h, n, up, down FROM c, range(10000) x(b), range((n + 3) // 4) y(q)),
d AS (SELECT b, CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) % n AS i, n, up, down FROM h, range(4) z(k) WHERE 4 * q + k < n),
m AS (SELECT b, sum(CASE WHEN i < down THEN -1 WHEN i >= n - up THEN 1 ELSE 0 END) / any_value(n) AS mean FROM d GROUP BY 1),
o AS (SELECT mean, row_number() OVER (ORDER BY mean, b) AS p FROM m)
SELECT 'ok' AS metric, n AS paired_case_count, lc AS left_correct_count, rc AS right_correct_count, up AS improved_count, down AS regressed_count, tied AS tied_correct_count, neither AS tied_incorrect_count,
round((up - down) / n, 9) AS right_minus_left, (SELECT round(mean, 9) FROM o WHERE p = 251) AS bootstrap_low, (SELECT round(mean, 9) FROM o WHERE p = 9750) AS bootstrap_high, 10000 AS bootstrap_resamples FROM c"""


def _operational(spark, folder):
    events = tables(spark, folder)("events")
    rows = events.select(
        "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("prompt_tokens"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("completion_tokens"),
        (F.col("value") > 10).cast("int").alias("calls"),
        F.when((F.col("event_type") == "view") & (F.col("value") > 50), "CNY").otherwise("USD").alias("currency"),
    )
    out = operational_summary(rows, ("event_type",), "value", ("prompt_tokens", "completion_tokens"), "calls", "currency")
    return out.withColumns({n: F.round(n, 6) for n in ("mean_latency", "median_latency", "p95_latency")})


QUERIES["evaluate_operational_summary"] = _operational
ORACLES["evaluate_operational_summary"] = """SELECT event_type, count(*) AS case_count, round(avg(value), 6) AS mean_latency, CAST(count(*) FILTER (value > 10) AS BIGINT) AS call_total, count(*) FILTER (value > 10) AS cases_with_calls,
count(*) AS prompt_tokens_available, CASE WHEN event_type <> 'error' THEN count(*) ELSE 0 END AS completion_tokens_available, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens_total,
CASE WHEN event_type <> 'error' THEN CAST(sum(user_id) AS BIGINT) END AS completion_tokens_total, CASE WHEN event_type <> 'view' THEN 'USD' END AS currency,
round(median(value), 6) AS median_latency, round(quantile_disc(value, 0.95), 6) AS p95_latency FROM events GROUP BY event_type"""

# ---------------------------------------------------------------- ledgers


def _ledger(spark, folder):
    events = tables(spark, folder)("events")
    failed = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("bigint")
    return usage_ledger(
        events.select("event_id", "event_type", "value", "props"), (), "event_id", F.lit(1),
        F.when(~failed, k * 20), F.when(~failed, F.floor("value")), block=1000,
    )


def _ledger_rows(spark, folder):
    return _ledger(spark, folder).select(
        "event_id", F.round("cost", 10).cast("double").alias("cost"), F.col("total_calls").cast("bigint").alias("total_calls"),
        F.col("total_input_tokens").cast("bigint").alias("total_input_tokens"), F.col("total_output_tokens").cast("bigint").alias("total_output_tokens"),
        F.round("total_cost", 8).cast("double").alias("total_cost"),
    )


_LEDGER = """u AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 20 END AS i, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS o FROM events),
l AS (SELECT event_id, (i * 30 + o * 120) AS c, count(*) OVER w AS calls, coalesce(sum(i) OVER w, 0) AS ti, coalesce(sum(o) OVER w, 0) AS t_o, coalesce(sum(i * 30 + o * 120) OVER w, 0) AS tc FROM u WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""
QUERIES["evaluate_usage_ledger"] = _ledger_rows
ORACLES["evaluate_usage_ledger"] = f"""WITH {_LEDGER} SELECT event_id, CAST(CAST(c AS DECIMAL(30,8)) * 0.00000001 AS DOUBLE) AS cost, calls AS total_calls, CAST(ti AS BIGINT) AS total_input_tokens, CAST(t_o AS BIGINT) AS total_output_tokens,
CAST(CAST(tc AS DECIMAL(30,0)) * CAST(0.00000001 AS DECIMAL(8,8)) AS DOUBLE) AS total_cost FROM l"""
QUERIES["evaluate_ledger_first_breaches"] = lambda spark, folder: first_breaches(_ledger(spark, folder), (), "event_id").withColumn("total", F.round("total", 8))
ORACLES["evaluate_ledger_first_breaches"] = f"""WITH {_LEDGER} SELECT 'http_calls' AS limit_name, 480.0::DOUBLE AS limit_value, CAST(max(calls) AS DOUBLE) AS total, min(event_id) FILTER (calls > 480) AS first_breach FROM l
UNION ALL SELECT 'input_tokens', 2400000, max(ti), min(event_id) FILTER (ti > 2400000) FROM l UNION ALL SELECT 'output_tokens', 180000, max(t_o), min(event_id) FILTER (t_o > 180000) FROM l
UNION ALL SELECT 'cost', 0.9, round(max(tc) / 100000000.0, 8), min(event_id) FILTER (tc > 90000000) FROM l"""
QUERIES["evaluate_estimated_tokens"] = lambda spark, folder: tables(spark, folder)("conversations").groupBy("conv_id").agg(
    F.sum(estimated_tokens("text")).alias("prompt_tokens")
)
ORACLES["evaluate_estimated_tokens"] = "SELECT conv_id, CAST(sum(greatest(1, length(text) // 2)) AS BIGINT) AS prompt_tokens FROM conversations GROUP BY 1"

# ---------------------------------------------------------------- lineage and logs


def _tree(by, depth):
    """SQL of the root of a hash tree over ``h`` (*by, h): leaves of ``depth`` digits, then level by level."""
    keys = "".join(f"{c}, " for c in by)
    sums = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))
    level = f"SELECT {keys}substr(h, 1, {depth}) AS prefix, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {sums})) AS node, count(*) AS n FROM h GROUP BY ALL"
    for d in range(depth - 1, -1, -1):
        places = ", ".join(f"coalesce(max(CASE WHEN substr(prefix, {d + 1}, 1) = '{x}' THEN node END), '')" for x in "0123456789abcdef")
        level = f"SELECT {keys}left(prefix, {d}) AS prefix, sha256(concat_ws('|', {places})) AS node, sum(n) AS n FROM ({level}) GROUP BY ALL"
    return f"SELECT {keys}node AS input_sha256, n AS input_rows FROM ({level})"


def _inputs(spark, folder):
    series = monthly_gmv(bound_star(spark, folder), None, (CUSTOMER_STATE,))
    rows = series.select(CUSTOMER_STATE, F.col(PURCHASE_MONTH).cast("string").alias("period"), (F.col("gmv") * 100).cast("bigint").alias("cents"))
    return input_hash(rows, (CUSTOMER_STATE,), ("period", "cents", CUSTOMER_STATE))


QUERIES["evaluate_input_hash"] = _inputs
ORACLES["evaluate_input_hash"] = f"""WITH {star()}, s AS (SELECT customer_state, CAST(purchase_month AS VARCHAR) AS period, CAST(trunc(sum(price) * 100) AS BIGINT) AS cents FROM sales JOIN line USING (oid) JOIN cust USING (cid) WHERE st = 'delivered' GROUP BY 1, 2),
h AS (SELECT customer_state, sha256('{{"cents":' || cents || ',"customer_state":"' || customer_state || '","period":"' || period || '"}}') AS h FROM s)
SELECT customer_state, input_sha256, CAST(input_rows AS BIGINT) AS input_rows FROM ({_tree(('customer_state',), 2)}) t"""


def _changed(spark, folder):
    orders = tables(spark, folder)("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    moved = (F.col("o_custkey") % 97 == 5) & (F.col("o_orderstatus") == "F")
    after = orders.withColumn("o_orderstatus", F.when(moved, "P").otherwise(F.col("o_orderstatus"))).filter("o_orderkey % 500 <> 3")
    return changed_rows(orders, after, (), orders.columns)


QUERIES["evaluate_changed_rows"] = _changed
ORACLES["evaluate_changed_rows"] = """WITH a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 97 = 5 AND o_orderstatus = 'F' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 500 <> 3),
b AS (SELECT o_orderkey, o_custkey, o_orderstatus, 1 AS b, 0 AS a FROM orders UNION ALL SELECT *, 0, 1 FROM a)
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(sum(b) AS BIGINT) AS before_rows, CAST(sum(a) AS BIGINT) AS after_rows FROM b GROUP BY 1, 2, 3 HAVING sum(a) <> sum(b)"""


def _lineage(spark, folder):
    t = tables(spark, folder)
    runs = t("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.max("l_linenumber").alias("attempts"))
    calculations = t("orders").select(
        F.col("o_orderkey").alias("calculation_id"), F.col("o_orderkey").alias("parent_run_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("source_attempt")
    )
    return lineage_check(calculations, runs).select("calculation_id", "lineage_status")


QUERIES["evaluate_lineage_check"] = _lineage
ORACLES["evaluate_lineage_check"] = """SELECT o_orderkey AS calculation_id, CASE WHEN m IS NULL THEN 'unknown_run' WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) > m THEN 'attempt_out_of_range' ELSE 'linked' END AS lineage_status
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


def _sequences(spark, folder):
    lines = tables(spark, folder)("lineitem").select(F.col("l_orderkey").alias("log"), F.col("l_linenumber").alias("number"))
    return sequence_audit(lines, ("log",), "number")


QUERIES["evaluate_sequence_audit"] = _sequences
ORACLES["evaluate_sequence_audit"] = """WITH d AS (SELECT l_orderkey AS log, l_linenumber AS number, count(*) AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, number - lag(number) OVER (PARTITION BY log ORDER BY number) > 1 AS gap FROM d)
SELECT log, CAST(sum(n) AS BIGINT) AS rows, min(number) AS first_number, max(number) AS last_number, CAST(sum(n - 1) AS BIGINT) AS repeats, count(*) FILTER (gap) AS gaps,
CAST(min(number) = 1 AND sum(n - 1) = 0 AND count(*) FILTER (gap) = 0 AS INTEGER) AS contiguous FROM g GROUP BY 1"""


def _records(spark, folder):
    turns = tables(spark, folder)("conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    records = turns.select(
        key.alias("case_id"), (F.col("turn") + F.when(F.col("role") == "system", 1).otherwise(0)).alias("ordinal"), "text",
        F.sha2(F.when(F.length("text") < 100, F.lower("text")).otherwise(F.col("text")), 256).alias("payload_sha256"),
        (F.col("turn") + 1).alias("attempt"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("source_attempt"),
    )
    manifest = turns.filter(F.length("text") > 60).select(key.alias("case_id"), F.col("turn").alias("ordinal"))
    return record_audit(records, manifest, "text")


QUERIES["evaluate_record_audit"] = _records
ORACLES["evaluate_record_audit"] = """SELECT unnest(['unknown_case', 'ordinal_differs', 'payload_hash_differs', 'first_attempt_has_source', 'later_attempt_without_earlier_source']) AS "check",
unnest([count(*) FILTER (length(text) <= 60), count(*) FILTER (length(text) > 60 AND role = 'system'), count(*) FILTER (length(text) < 100 AND lower(text) <> text), 0, count(*) FILTER (turn > 0 AND turn % 3 = 0)]) AS violations FROM conversations"""


def _seen(spark, folder):
    docs = tables(spark, folder)("documents")
    return first_seen(docs, ("source",), squeezed("text"), "doc_id").select("doc_id", "source", "first_seen", "is_duplicate")


QUERIES["evaluate_first_seen"] = _seen
ORACLES["evaluate_first_seen"] = r"""WITH t AS (SELECT doc_id, source, trim(regexp_replace(trim(regexp_replace(lower(text), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')), ';$', '')) AS x FROM documents)
SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source, x) AS first_seen, CAST(doc_id > min(doc_id) OVER (PARTITION BY source, x) AS INTEGER) AS is_duplicate FROM t"""


def _resume(spark, folder):
    t = tables(spark, folder)
    return resume(t("documents").select("doc_id", "lang"), t("labels"), "doc_id", "doc_id", 250)


QUERIES["evaluate_resume"] = _resume
QUERIES["evaluate_resume_all"] = lambda spark, folder: resume(tables(spark, folder)("documents").select("doc_id", "lang"), tables(spark, folder)("labels"), "doc_id", "doc_id")
ORACLES["evaluate_resume_all"] = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLES["evaluate_resume"] = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 250"


def _seal(spark, folder):
    orders = tables(spark, folder)("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    shipped = tables(spark, folder)("lineitem").select("l_orderkey").distinct().count()
    return seal(orders, orders.columns, shipped).withColumn("complete", F.col("complete").cast("int"))


QUERIES["evaluate_seal"] = _seal
ORACLES["evaluate_seal"] = """WITH j AS (SELECT '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS j FROM orders),
h AS (SELECT sha256(j) AS h, length(j) AS b FROM j),
s AS (SELECT count(*) AS n, CAST(sum(b) AS BIGINT) AS b, """ + ", ".join(
    f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS s{i}" for i in range(4)
) + """ FROM h) SELECT sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS content_sha256, n AS row_count, b AS byte_count, CAST(n = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS INTEGER) AS complete FROM s"""


def _outcomes(spark, folder):
    events = tables(spark, folder)("events").withColumn("version", F.when(F.col("user_id") < 50, "a").otherwise("b"))
    kind = F.col("event_type")
    return outcome_summary(
        events, ("version",), "event_type",
        {
            "expectation_met": F.col("value") <= 50,
            "eligible": kind.isin("purchase", "error"),
            "successes": kind == "purchase",
            "rejected_but_executed": (kind == "error") & (F.col("value") > 100),
            "never": F.lit(False),
        },
        {"success_rate": ("successes", "eligible"), "undefined_rate": ("successes", "never")},
    ).withColumn("value", F.round("value", 9))


QUERIES["evaluate_outcome_summary"] = _outcomes
ORACLES["evaluate_outcome_summary"] = """WITH e AS (SELECT *, CASE WHEN user_id < 50 THEN 'a' ELSE 'b' END AS version FROM events),
s AS (SELECT version, count(*) AS total, count(*) FILTER (value <= 50) AS met, count(*) FILTER (event_type IN ('purchase', 'error')) AS el, count(*) FILTER (event_type = 'purchase') AS ok,
  count(*) FILTER (event_type = 'error' AND value > 100) AS rej FROM e GROUP BY 1)
SELECT version, unnest(['total', 'expectation_met', 'eligible', 'successes', 'rejected_but_executed', 'never', 'success_rate', 'undefined_rate']) AS measure,
unnest([CAST(total AS DOUBLE), met, el, ok, rej, 0, round(ok / el, 9), NULL]) AS value FROM s
UNION ALL SELECT version, 'outcome:' || event_type, CAST(count(*) AS DOUBLE) FROM e GROUP BY version, event_type"""
