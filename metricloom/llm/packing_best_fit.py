"""Best-fit-decreasing packing into id matrices (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.support import ordered_offsets, partitions, staged
from metricloom.llm.tokens import encoded


class _OpenBins:
    """Segment tree over free capacities; finds the least one that fits in log(capacity) steps."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.leaves)

    def add(self, free: int, bins: int) -> None:
        at = free + self.leaves
        while at:
            self.any[at] += bins
            at //= 2

    def least_at_least(self, need: int) -> int | None:
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Pack ``lengths`` (length: how many) and return slots and the number of bins.

    A slot (length, first rank, pieces, pieces of a bin, first bin, start in the bin) places the
    pieces of a length that have these ranks. Pieces of one length behave alike, so bins with equal
    contents are handled together; the result is that of placing one piece after another. There are
    at most capacity^2 / 2 slots, whatever the number of pieces.
    """
    tree, groups = _OpenBins(capacity), {}
    slots, bins = [], 0
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            free = tree.least_at_least(length)
            if free is None:
                each = capacity // length
                first, count, free = bins, -(-left // each), capacity
                bins += count
            else:
                first, count = groups[free].pop()
                tree.add(free, -count)
                each = free // length
            full = min(count, left // each)
            taken = [(first, full, each)] if full else []
            left_over = left - full * each
            if full < count and left_over:
                taken.append((first + full, 1, left_over))
            used = 0
            for start, n, per in taken:
                slots.append((length, rank, n * per, per, start, capacity - free))
                rank, left, used = rank + n * per, left - n * per, used + n
                rest = free - per * length
                if rest:
                    groups.setdefault(rest, []).append((start, n))
                    tree.add(rest, n)
            if used < count:
                groups.setdefault(free, []).append((first + used, count - used))
                tree.add(free, count - used)
    return slots, bins


_SCHEMA = "sequence_id long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], [f.split()[0] for f in _SCHEMA.split(", ")])


def _sequence(sequence: int, pieces: list[tuple[int, int, bytes]], capacity: int, width: int) -> tuple:
    """One matrix row: ids padded with 0, segment ends, positions that restart in each segment."""
    ids = b"".join(p[2] for p in pieces)
    lengths = [len(p[2]) // width for p in pieces]
    total = sum(lengths)
    positions = np.zeros(capacity, "<i4")
    positions[:total] = np.concatenate([np.arange(n, dtype="<i4") for n in lengths])
    return sequence, total, ids.ljust(capacity * width, b"\0"), [0, *np.cumsum(lengths).tolist()], positions.tobytes(), [p[0] for p in pieces], [p[1] for p in pieces]


def packed_matrices(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """Every token of ``docs`` in matrix rows of ``capacity`` ids, by best-fit-decreasing packing.

    A document longer than a row is cut at multiples of ``capacity``: its full pieces are rows of
    their own and are never shuffled; the last pieces are packed. Columns: sequence_id, n_tokens,
    input_ids (little-endian, padded with 0), cu_seqlens (0 and the end of each segment),
    position_ids (int32, restarting in each segment), and for each segment its document and its start
    there. The driver sees the number of pieces of each length, at most ``capacity`` numbers.

    A null or empty text has its end id alone; a null doc_id is carried; repeated rows are packed
    each; an empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    tokens = staged(encoded(docs, tokenizer_path, ["doc_id"]))
    tails = tokens.select("row", (F.col("n_tokens") % capacity).cast("int").alias("length")).where("length > 0")
    counts = {r["length"]: r["count"] for r in tails.groupBy("length").count().collect()}
    slots, bins = best_fit_decreasing(counts, capacity)

    base = dict(zip(sorted(counts), np.cumsum([0, *[counts[k] for k in sorted(counts)]]).tolist(), strict=False))
    placed = [(length, base[length] + rank, base[length] + rank + n, per, first, start) for length, rank, n, per, first, start in slots]
    table = F.broadcast(spark.createDataFrame(placed, "slot_length int, rank_from long, rank_to long, per_bin int, first_bin long, start int"))
    ranked = ordered_offsets(tails, ["length", "row"], {"rank": F.lit(1).cast("long")})
    at = F.col("rank") - F.col("rank_from")
    where = ranked.join(table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).select(
        "row",
        (F.col("first_bin") + F.floor(at / F.col("per_bin"))).alias("bin"),
        (F.col("start") + at % F.col("per_bin") * F.col("length")).alias("offset"),
    )
    cut = (F.col("n_tokens") - F.col("n_tokens") % capacity).alias("start")
    last = tokens.where(F.col("n_tokens") % capacity > 0).select("row", "doc_id", "id_bytes", cut, F.expr(f"substring(ids, CAST((n_tokens - n_tokens % {capacity}) * id_bytes + 1 AS INT))").alias("ids"))
    segments = last.join(where, "row").select("bin", "offset", "doc_id", "start", "ids", "id_bytes").repartition(partitions(spark), "bin").sortWithinPartitions("bin", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces, width, out = None, [], 2, []
        for batch in batches:
            for bin_, _, doc, start, ids, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bin_ != current and pieces:
                    out.append(_sequence(current, pieces, capacity, width))
                    pieces = []
                    if len(out) >= 256:
                        yield _rows(out)
                        out = []
                current = bin_
                pieces.append((doc, start, ids))
        if pieces:
            out.append(_sequence(current, pieces, capacity, width))
        if out:
            yield _rows(out)

    # Rows of full pieces are numbered after the bins, by document in the order of the written table.
    full = tokens.where(F.col("n_tokens") >= capacity)
    numbered = ordered_offsets(full.select("row", F.expr(f"n_tokens div {capacity}").alias("full")), ["row"], {"full_before": F.col("full")}).select("row", "full_before")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, before, ids, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                step = capacity * width
                for k in range(len(ids) // step):
                    out.append(_sequence(bins + before + k, [(doc, k * capacity, ids[k * step : (k + 1) * step])], capacity, width))
                    if len(out) >= 256:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)

    whole = full.join(numbered, "row").select("doc_id", "full_before", "ids", "id_bytes")
    return segments.mapInArrow(pack, _SCHEMA).unionByName(whole.mapInArrow(split, _SCHEMA))


def write_matrices(packed: DataFrame, folder: str) -> None:
    """The packed rows as Parquet files, ordered by sequence inside each file."""
    packed.sortWithinPartitions("sequence_id").write.mode("overwrite").option("compression", "zstd").parquet(folder)
