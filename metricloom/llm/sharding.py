"""Contiguous shards of least possible size (operator 8), with DataFrame operations only."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.support import ordered_offsets, staged

# Cells of the first look at the group ends, and groups of one cell that are read one by one.
CELLS = 1 << 14
FANOUT = 256


class _Ends:
    """Ordered group ends, known exactly where the search looks and by cells elsewhere.

    ``ends`` is a table with one row for each group. The driver holds the least and greatest end of
    at most ``CELLS`` cells, and of up to ``FANOUT`` parts of each cell that a search has touched.
    """

    def __init__(self, ends: DataFrame, total: int) -> None:
        self.ends, self.total = ends, total
        self.width = -(-total // CELLS)
        self.cells: list[tuple[int, int, int]] = []
        self.touched: set[int] = set()
        coarse = ends.groupBy(F.floor((F.col("end") - 1) / self.width).alias("cell"))
        self.cells = sorted((r["lo"], r["hi"], r["n"]) for r in coarse.agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.countDistinct("end").alias("n")).collect())
        self._index()

    def _index(self) -> None:
        self.lows = [c[0] for c in self.cells]

    def floor(self, x: int) -> int:
        """The greatest end of at most x, 0 without one; a guess that marks its cell if not known."""
        at = bisect.bisect_right(self.lows, x) - 1
        if at < 0:
            return 0
        low, high, n = self.cells[at]
        if x >= high or n <= 2:
            return high if x >= high else low
        self.touched.add(at)
        return low

    def ceiling(self, x: int) -> int:
        """The least end of at least x."""
        at = bisect.bisect_right(self.lows, x) - 1
        if at >= 0:
            low, high, n = self.cells[at]
            if x == low:
                return low
            if x <= high:
                if n > 2:
                    self.touched.add(at)
                return high
        return self.lows[at + 1] if at + 1 < len(self.lows) else self.total

    def refine(self) -> bool:
        """Look closer at the touched cells; false if there were none."""
        if not self.touched:
            return False
        spark = self.ends.sparkSession
        wanted = [(i, *self.cells[i]) for i in sorted(self.touched)]
        part = F.when(F.col("n") <= FANOUT, F.col("end")).otherwise(F.floor((F.col("end") - F.col("lo")) * FANOUT / (F.col("hi") - F.col("lo") + 1)))
        rows = [(i, (lo - 1) // self.width, lo, hi, n) for i, lo, hi, n in wanted]
        asked = F.broadcast(spark.createDataFrame(rows, "i int, cell long, lo long, hi long, n long"))
        found = (
            self.ends.withColumn("cell", F.floor((F.col("end") - 1) / self.width))
            .join(asked, "cell")
            .where(F.col("end").between(F.col("lo"), F.col("hi")))
            .groupBy("i", part.alias("part"))
            .agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.countDistinct("end").alias("n"))
            .collect()
        )
        self.cells = sorted([c for i, c in enumerate(self.cells) if i not in self.touched] + [(r["lo"], r["hi"], r["n"]) for r in found])
        self.touched = set()
        self._index()
        return True


def _feasible(ends: _Ends, shards: int, capacity: int) -> bool:
    at = 0
    for _ in range(shards):
        at = ends.floor(at + capacity)
        if at >= ends.total:
            return True
    return False


def _search(ends: _Ends, shards: int) -> tuple[int, list[int]]:
    low, high = -(-ends.total // shards), ends.total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _feasible(ends, shards, middle) else (middle + 1, high)
    # The earliest cuts that leave the rest feasible, from the back; then the cut of least drift.
    earliest = [ends.total]
    for _ in range(shards - 1):
        earliest.append(min(ends.ceiling(max(0, earliest[-1] - low)), earliest[-1]) if earliest[-1] > low else 0)
    cuts, at = [], 0
    for k in range(1, shards):
        least, most, even = earliest[shards - k], ends.floor(at + low), ends.total * k // shards
        below = ends.floor(even)
        above = ends.ceiling(even)
        near = below if even - below <= above - even else above
        at = max(at, least, min(near, most))
        cuts.append(at)
    return low, cuts


def least_capacity(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity at which ordered groups fit ``shards`` contiguous shards, and the cuts.

    ``ends`` has the running total at the end of each group as ``end``. The binary search and its
    greedy check run on the driver over a bounded summary; every cell of it that the search touches
    is read closer until each comparison was made on a real group end.
    """
    total = ends.agg(F.max("end")).first()[0] or 0
    if total == 0:
        return 0, [0] * (shards - 1)
    known = _Ends(ends, total)
    while True:
        found = _search(known, shards)
        if not known.refine():
            return found


def contiguous_shards(docs: DataFrame, shards: int = 40, row_bytes: int = 16) -> DataFrame:
    """Shards 0 to ``shards - 1`` of near equal bytes; equal texts are never parted.

    Groups of equal texts are ordered by their smallest doc_id. Null and empty texts have
    ``row_bytes`` bytes and form a group each; a null doc_id counts as the smallest; repeated rows
    are rows of their own; an empty table gives no rows. Only doc_id and text are read.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + row_bytes).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("")).alias("same"),
    )
    leaders = rows.groupBy("same").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))).alias("leader"))
    placed = staged(
        ordered_offsets(
            rows.join(leaders, "same"),
            ["leader", "same", "doc_id"],
            {"bytes_before": F.col("size"), "rows_before": F.lit(1).cast("long")},
        )
    )
    ends = staged(placed.groupBy("leader", "same").agg(F.max(F.col("bytes_before") + F.col("size")).alias("end")).select("end"))
    _, cuts = least_capacity(ends, shards)
    shard = sum((F.when(F.col("bytes_before") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = placed.withColumn("shard", shard.cast("int"))
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rows_before") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
