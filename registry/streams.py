"""Streaming re-runs of the log operators, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.streaming.ledger import stream_first_breaches
from metricloom.streaming.logs import read_log_stream, run_available, run_updates, stream_first_seen, stream_usage
from registry.common import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _events(spark, folder):
    """Event time needs a session time zone type for watermarks; the clock reading is kept as UTC."""
    schema = tables(spark, folder)("events").schema
    stream = read_log_stream(spark, folder, schema, "events.parquet")
    if isinstance(schema["ts"].dataType, T.TimestampNTZType):
        stream = stream.withColumn("at", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))
    else:
        stream = stream.withColumn("at", F.col("ts"))
    return stream


def _usage(spark, folder):
    totals = stream_usage(
        _events(spark, folder), "at", "1 day", "2 hours", ("event_type",),
        {"total_value": F.col("value").cast("decimal(18,2)")},
    )
    out = run_updates(totals, ("window_start", "window_end", "event_type"))
    return out.select(
        F.from_utc_timestamp(F.to_utc_timestamp("window_start", F.current_timezone()), "UTC").cast("date").alias("window_day"),
        "event_type",
        "calls",
        F.col("total_value").cast("double").alias("total_value"),
    )


QUERIES["stream_usage_per_day"] = _usage
ORACLES["stream_usage_per_day"] = """SELECT CAST(date_trunc('day', ts) AS DATE) AS window_day, event_type, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM events GROUP BY 1, 2"""


def _first(spark, folder):
    log = _events(spark, folder).select("at", "user_id", F.sha2(F.concat_ws("|", F.lower("event_type"), "props"), 256).alias("text_sha256"))
    return run_available(stream_first_seen(log, "at", "60 days", ("user_id", "text_sha256"))).select("user_id", "text_sha256")


QUERIES["stream_first_seen"] = _first
ORACLES["stream_first_seen"] = "SELECT DISTINCT user_id, sha256(lower(event_type) || '|' || props) AS text_sha256 FROM events"


def _breaches(spark, folder):
    """A ledger for each type of event."""
    failed = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("bigint")
    limits = {"http_calls": 480, "input_tokens": 500_000, "output_tokens": 30_000, "cost": 0.15}
    found = stream_first_breaches(
        _events(spark, folder), ("event_type",), "event_id", F.lit(1), F.when(~failed, k * 20), F.when(~failed, F.floor("value")), limits=limits
    )
    return run_available(found).withColumn("total", F.round("total", 8))


QUERIES["stream_ledger_first_breaches"] = _breaches
ORACLES["stream_ledger_first_breaches"] = """WITH u AS (SELECT event_type, event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 20 ELSE 0 END AS i,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS o FROM events),
l AS (SELECT event_type, event_id, count(*) OVER w AS calls, sum(i) OVER w AS ti, sum(o) OVER w AS t_o, sum(i * 30 + o * 120) OVER w AS tc FROM u WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT event_type, 'http_calls' AS limit_name, 480.0::DOUBLE AS limit_value, event_id, calls::DOUBLE AS total FROM l WHERE calls > 480
  UNION ALL SELECT event_type, 'input_tokens', 500000, event_id, ti FROM l WHERE ti > 500000 UNION ALL SELECT event_type, 'output_tokens', 30000, event_id, t_o FROM l WHERE t_o > 30000
  UNION ALL SELECT event_type, 'cost', 0.15, event_id, tc / 100000000.0 FROM l WHERE tc > 15000000)
SELECT event_type, limit_name, limit_value, round(arg_min(total, event_id), 8) AS total, min(event_id) AS first_breach FROM b GROUP BY 1, 2, 3"""
