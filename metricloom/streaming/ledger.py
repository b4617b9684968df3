"""The usage ledger as a stream: running totals in keyed state, the first breach of each limit as it happens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from metricloom.operators.ledger import INPUT_PRICE, LIMITS, OUTPUT_PRICE

# Prices have four places for a million tokens, so a cost is a whole number of these parts.
COST_PARTS = 10**10
TOTALS = ("http_calls", "input_tokens", "output_tokens", "cost")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstBreaches(StatefulProcessor):
    """Totals of one ledger and the limits it is already above; a row for each limit when it is first passed.

    The rows of a batch are put in order of their sequence first: four numbers a row, so what is held is
    bounded by what one trigger reads of one ledger. Batches must follow each other in sequence, as the
    files of an append-only log do.
    """

    def __init__(self, limits: dict[str, Any], prices: tuple[str, str], keys: Sequence[str]) -> None:
        self.names = list(limits)
        self.values = [float(v) for v in limits.values()]
        self.bounds = [int(Decimal(str(v)) * (COST_PARTS if n == "cost" else 1)) for n, v in limits.items()]
        self.columns = [TOTALS.index(n) for n in limits]
        self.price = [int(Decimal(p) * 10_000) for p in prices]
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField(n, T.LongType()) for n in TOTALS]
        self.state = handle.getValueState("totals", T.StructType([*fields, T.StructField("passed", T.IntegerType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        read = pd.concat([r[["sequence", "calls", "prompt", "completion"]] for r in rows]).sort_values("sequence", kind="stable")
        tokens = [read[c].fillna(0).to_numpy(np.int64) for c in ("prompt", "completion")]
        # A call of which one side is unknown has no cost.
        known = read[["prompt", "completion"]].notna().all(axis=1).to_numpy()
        steps = [read["calls"].fillna(0).to_numpy(np.int64), *tokens, known * (tokens[0] * self.price[0] + tokens[1] * self.price[1])]
        before = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0)
        running = [start + np.cumsum(step) for start, step in zip(before[:4], steps, strict=True)]
        passed, found = int(before[4]), []
        for k, (name, value, bound, column) in enumerate(zip(self.names, self.values, self.bounds, self.columns, strict=True)):
            above = np.flatnonzero(running[column] > bound)
            if passed & 1 << k or not len(above):
                continue
            passed |= 1 << k
            at = int(above[0])
            total = running[column][at] / (COST_PARTS if name == "cost" else 1)
            found.append((*key, name, value, float(total), int(read["sequence"].iloc[at])))
        self.state.update((*(int(r[-1]) for r in running), passed))
        yield pd.DataFrame(found, columns=[*self.keys, "limit_name", "limit_value", "total", "first_breach"])

    def close(self) -> None:
        pass


def stream_first_breaches(
    events: DataFrame,
    by: Sequence[str],
    sequence: str,
    calls: Column,
    prompt: Column,
    completion: Column,
    prices: tuple[str, str] = (INPUT_PRICE, OUTPUT_PRICE),
    limits: dict[str, Any] = LIMITS,
) -> DataFrame:
    """(*by, limit_name, limit_value, total, first_breach): the event that first takes a ledger above a limit.

    The meaning is that of ``usage_ledger`` and ``first_breaches``: a failed call has NULL usage and still
    counts as a call. ``total`` is the total at the breach. State is five numbers for each ledger, so a
    stream runs for as long as it likes, and a restart goes on from the totals of the last batch.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events.select(*by, F.col(sequence).cast("bigint").alias("sequence"), calls.cast("bigint").alias("calls"), prompt.cast("bigint").alias("prompt"), completion.cast("bigint").alias("completion"))
    out = T.StructType([*[rows.schema[k] for k in by], *T.StructType.fromDDL("limit_name string, limit_value double, total double, first_breach bigint").fields])
    return rows.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=FirstBreaches(limits, prices, by), outputStructType=out, outputMode="Append", timeMode="None"
    )
