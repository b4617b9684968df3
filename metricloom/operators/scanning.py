"""Secret scanning with line numbers and ordered error classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.text import WHITESPACE_RUN

# Secret patterns by rule name.
SECRET_RULES = (
    ("openai_style_secret", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    (
        "assigned_deepseek_key",
        r"(?i)DEEPSEEK_API_KEY\s*=\s*['\"]?(?!<|your-|example|\$\{|os\.|None\b)[^\s'\"]+",
    ),
)
USER_PATH_RULE = ("windows_user_absolute_path", r"[A-Za-z]:\\Users\\[^\\\s]+\\")

# Database errors a rewritten statement may fix, by rule id.
REPAIRABLE_ERRORS = (
    ("sqlite_missing_scalar_function", r"(?i)^no such function: [A-Za-z_][A-Za-z0-9_]*$"),
    (
        "sqlite_function_argument_count",
        r"(?i)^wrong number of arguments to function [A-Za-z_][A-Za-z0-9_]*\(\)$",
    ),
    (
        "sqlite_compound_select_column_count",
        r"(?i)^SELECTs to the left and right of (?:UNION|UNION ALL|INTERSECT|EXCEPT) do not have the same number of result columns$",
    ),
    ("sqlite_cte_column_count", r"(?i)^table .+ has \d+ values for \d+ columns$"),
    ("sqlite_escape_width", r"(?i)^ESCAPE expression must be a single character$"),
    ("sqlite_window_argument", r"(?i)^second argument to nth_value must be a positive integer$"),
)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def secret_scan(
    docs: DataFrame,
    doc_id: str,
    text: str,
    rules: Sequence[tuple[str, str]] = SECRET_RULES,
    excluded: Column | None = None,
) -> DataFrame:
    """(doc_id, rule, line) for every match in the whole text.

    The text is cut at the matches: the line of a match is the newlines in all pieces and
    matches before it, so a match may itself span lines. Found values never leave the task.
    """
    rows = docs if excluded is None else docs.filter(~F.coalesce(excluded, F.lit(False)))
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(text).rlike(pattern),
                    F.struct(
                        F.lit(rule).alias("rule"),
                        F.transform(F.split(text, pattern, -1), _newlines).alias("pieces"),
                        F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), _newlines).alias("matches"),
                    ),
                )
                for rule, pattern in rules
            ]
        )
    )
    found = rows.select(F.col(doc_id).alias("doc_id"), F.explode(hits).alias("h"))

    # One running pass: only the newlines are kept, with a mark where each match begins.
    marks = F.zip_with(
        "h.pieces",
        "h.matches",
        lambda piece, match: F.when(match.isNotNull(), F.concat(F.repeat(F.lit("\n"), piece), F.lit("|"), F.repeat(F.lit("\n"), match))).otherwise(""),
    )
    per_line = F.split(F.array_join(marks, ""), "\n")
    lines = F.flatten(F.transform(per_line, lambda marked, i: F.array_repeat(i + 1, F.length(marked))))
    return found.select("doc_id", "h.rule", F.explode(lines).alias("line"))


def scan_summary(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Scanned documents, findings, and whether none was found."""
    n = findings.agg(F.count(F.lit(1)).alias("n")).scalar()
    return docs.agg(F.count(F.lit(1)).alias("scanned_documents")).select(
        "scanned_documents", n.alias("finding_count"), (n == 0).cast("int").alias("passed")
    )


def classify_errors(
    log: DataFrame,
    succeeded: Column,
    error_type: Column,
    started: Column,
    message: Column,
    repairable: Sequence[tuple[str, str]] = REPAIRABLE_ERRORS,
) -> DataFrame:
    """Category, eligibility and rule id of each execution outcome; what no rule knows is denied."""
    # Any white space is stripped; only a line feed ends a line, as where the patterns come from.
    text = F.regexp_replace(F.coalesce(message, F.lit("")), f"^{WHITESPACE_RUN}|{WHITESPACE_RUN}\\z", "")
    database = error_type == "database"
    structural = error_type.isin("sql_syntax", "field")
    rule = (
        F.when(succeeded, F.lit("execution_succeeded"))
        .when(error_type == "safety", F.lit("day8_safety_failure"))
        .when(error_type == "timeout", F.lit("sqlite_timeout"))
        .when(error_type == "binding", F.lit("parameter_binding_failure"))
        .when(structural & started, F.concat(F.lit("sqlite_"), error_type, F.lit("_after_safety")))
        .when(structural, F.concat(F.lit("pre_execution_"), error_type))
        .when(database & ~started, F.lit("database_unavailable_before_execution"))
    )
    for rule_id, pattern in repairable:
        rule = rule.when(database & text.rlike(f"(?d){pattern}"), F.lit(rule_id))
    rule = rule.when(database, F.lit("database_error_default_deny")).otherwise(
        F.lit("unknown_execution_error_default_deny")
    )
    ids = [rule_id for rule_id, _ in repairable]
    out = log.withColumn("rule_id", rule)
    category = (
        F.when(F.col("rule_id") == "execution_succeeded", "not_applicable")
        .when((F.col("rule_id") == "day8_safety_failure") | F.col("rule_id").startswith("pre_execution_"), "safety_failure")
        .when(F.col("rule_id") == "sqlite_timeout", "resource_failure")
        .when(F.col("rule_id") == "parameter_binding_failure", "contract_failure")
        .when(F.col("rule_id").isin(*ids) | F.col("rule_id").endswith("_after_safety"), "repairable_sql_error")
        .when(F.col("rule_id") == "database_unavailable_before_execution", "environment_error")
        .otherwise("unclassified_database_error")
    )
    return out.withColumn("category", category).withColumn(
        "eligible", (F.col("category") == "repairable_sql_error").cast("int")
    )
