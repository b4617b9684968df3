"""What the operators of this folder share: written intermediates, ordered offsets, byte batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.session import shared_folder

# Texts are handled in slices of about this many bytes, so memory does not follow the batch size.
SLICE_BYTES = 1 << 20
SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The rows survive lost executors, later readers take only the columns they need, and the files
    go away with the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    # Spark drops shuffle files when the driver's collector finds their frames gone.
    jvm.System.gc()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(schema).parquet(path)


# What else a worker may forget between tasks.
FORGETS: list[Callable[[], None]] = []


def give_back() -> None:
    """Return what this Python worker no longer uses to the machine.

    Workers live on between tasks and jobs, and the memory that they and their allocators keep counts
    against the executor as if it were in use.
    """
    _POWERS.clear()
    for forget in FORGETS:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives its memory back at the end of a partition."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a row and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ordered_offsets(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add, under each name of ``sums``, the total of its value over all rows earlier in ``order``.

    Rows are range-partitioned by the whole order, so no key is too large for a task; the offsets
    of the partitions are running totals over one row for each partition.
    """
    spark = df.sparkSession
    values = {f"_v{i}": value for i, value in enumerate(sums.values())}
    placed = staged(
        df.withColumns(values)
        .repartitionByRange(partitions(spark), *order)
        .withColumn("_block", F.spark_partition_id())
    )
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_block")
        .agg(*[F.sum(v).alias(f"_s{v}") for v in values])
        .select("_block", *[F.coalesce(F.sum(f"_s{v}").over(before), F.lit(0)).alias(f"_s{v}") for v in values])
    )
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumns({f"_r{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
        .join(starts, "_block")
        .withColumns({name: F.col(f"_s{v}") + F.col(f"_r{v}") for name, v in zip(sums, values, strict=True)})
        .select(*df.columns, *sums)
    )


def byte_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch with the bytes of their texts and the offsets between the texts."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null(b"")
    _, edges, data = values.buffers()
    edges = np.frombuffer(edges, np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[edges[first] : edges[last]], edges[first : last + 1] - edges[first]
        first = last


def as_bytes(name: str) -> Column:
    return F.col(name).cast("binary").alias(name)


_RANDOM = np.random.default_rng(20260101)
_BYTE = _RANDOM.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed odd base modulo 2^64, and their inverses."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE[which], np.uint64), np.full(size, pow(_BASE[which], -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _POWERS[which] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of any ranges of a byte array, in constant time for each."""

    def __init__(self, data: np.ndarray, which: int = 0, fold: np.ndarray | None = None) -> None:
        table = _BYTE[which] if fold is None else _BYTE[which][fold]
        up, self.down = powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(SPACE)] = True


def word_spans(data: np.ndarray, edges: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and for each text its first word's number."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = edges[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, edges)
