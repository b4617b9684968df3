"""Hard negatives from Hilbert-ordered blocks with zone maps (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.support import ordered_offsets, partitions, staged

# Rows of a block, blocks of a chunk of zone maps, anchors that ask together, rows of a task when blocks are made.
BLOCK, ZONES, ANCHORS, ROWS = 256, 64, 256, 8192
# Bits of a component on the curve.
BITS = 4
# Whole components are kept within this size, so that scores of up to 4096 of them fit 63 bits.
LARGEST = 1 << 25
_NONE = -(1 << 62)
# Found scores that are held before only the best stay.
HELD = 200_000


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (n, dimensions) of ``bits`` bits on a Hilbert curve, as rows of bytes in order.

    Skilling's transformation: the bits of the coordinates from high to low, each level turned and
    mirrored by the levels above it, then a Gray code across the dimensions.
    """
    x = points.T.astype(np.uint32).copy()
    if not len(x):
        return np.zeros((len(points), 0), np.uint8)
    for level in range(bits - 1, 0, -1):
        high, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for axis in x:
            mirror = (axis & high) > 0
            swap = np.where(mirror, 0, (x[0] ^ axis) & low).astype(np.uint32)
            x[0] ^= np.where(mirror, low, swap)
            axis ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows, as int64."""
    largest = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that each anchor can have with a row of each box (interval arithmetic)."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(plus, low) + products(minus, high), products(plus, high) + products(minus, low)


def _matrix(blob: pa.Scalar, rows: int, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), kind).reshape(rows, -1)


_ROW = "dim int, label long, key binary, vec_id long, asked boolean, vector binary"


def whole_vectors(vectors: DataFrame, label: Column, asked: Column) -> DataFrame:
    """Rows that take part, in whole components, with their places on the curve."""
    wide = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & label.isNotNull() & ~bad).select("vec_id", label.cast("long").alias("label"), F.coalesce(asked, F.lit(False)).alias("asked"), wide.alias("whole"))
    ends = rows.agg(F.min(F.array_min("whole")).alias("low"), F.max(F.array_max("whole")).alias("high")).first()
    low = ends["low"] or 0
    shift = max(0, ((ends["high"] or 0) - low).bit_length() - BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int32)
            sizes = np.diff(ends)
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                matrix = flat[(ends[mine][:, None] + np.arange(size)).ravel()].reshape(len(mine), size)
                keys = hilbert_keys((matrix - low) >> shift, BITS)
                some = batch.take(pa.array(mine))
                columns = [pa.array(np.full(len(mine), size, np.int32)), some.column(1), pa.array([k.tobytes() for k in keys], pa.binary()), some.column(0), some.column(2), pa.array([m.tobytes() for m in matrix], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _ROW.split(", ")])

    return rows.select("vec_id", "label", "asked", "whole").mapInArrow(run, _ROW)


_BLOCK = "block long, dim int, label long, n int, low binary, high binary, ids binary, nulls binary, asked binary, vectors binary"


def hilbert_blocks(rows: DataFrame) -> DataFrame:
    """Candidate blocks: up to BLOCK rows of one label that follow each other on the curve.

    ``low`` and ``high`` are the zone map: the least and largest component of each dimension.
    """
    spark = rows.sparkSession
    parts = max(1, min(-(-rows.count() // ROWS), partitions(spark)))
    order = ["dim", "label", "key", "vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, []

        def emit() -> pa.RecordBatch:
            matrix = np.frombuffer(b"".join(h[4] for h in held), np.int32).reshape(len(held), -1)
            low, high = (f(axis=0) if len(held) else matrix[0] for f in (matrix.min, matrix.max))
            ids = np.array([h[2] or 0 for h in held], np.int64)
            flags = (np.array([f(h) for h in held], np.uint8) for f in (lambda h: h[2] is None, lambda h: h[3]))
            blobs = (low.astype(np.int32), high.astype(np.int32), ids, *flags, matrix)
            columns = [pa.array([block]), pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]]), pa.array([len(held)], pa.int32()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
                if held and (len(held) == BLOCK or held[0][:2] != row[:2]):
                    yield emit()
                    block, held = block + 1, []
                held.append(row)
        if held:
            yield emit()

    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _BLOCK)


# Anchors that ask together: ``places`` are block * BLOCK + row; ``lows`` and ``highs`` bound the scores of each window.
_ASK = "set long, dim int, n int, places binary, labels binary, vectors binary, lows binary, highs binary"


def _asking(blocks: DataFrame, positives: int) -> DataFrame:
    """Sets of anchors, asking for all scores that the best ``positives`` of their own block do not beat."""

    schema = _ASK + ", anchors array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, dim = TaskContext.get().partitionId() << 24, [], None

        def emit() -> pa.RecordBatch:
            places, labels, vectors, lows, ids, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            blobs = places, labels, vectors, lows, np.full(len(lows), -_NONE)
            anchors = pa.array([pa.array(ids, mask=nulls.astype(bool)).to_pylist()], pa.list_(pa.int64()))
            columns = [pa.array([name]), pa.array([dim], pa.int32()), pa.array([len(places)], pa.int32()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs], anchors]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for block, size, label, n, asked, vectors, ids, nulls in zip(*batch.columns, strict=True):
                mine = np.flatnonzero(np.frombuffer(asked.as_buffer(), np.uint8))
                if not len(mine):
                    continue
                n, matrix = n.as_py(), _matrix(vectors, n.as_py())
                scores = products(matrix[mine], matrix)
                scores[np.arange(len(mine)), mine] = _NONE
                least = np.partition(scores, n - positives, axis=1)[:, n - positives] if n > positives else np.full(len(mine), _NONE)
                if held and (dim != size.as_py() or sum(len(h[0]) for h in held) + len(mine) > ANCHORS):
                    yield emit()
                    name, held = name + 1, []
                dim = size.as_py()
                ids, nulls = np.frombuffer(ids.as_buffer(), np.int64)[mine], np.frombuffer(nulls.as_buffer(), np.uint8)[mine]
                held.append((block.as_py() * BLOCK + mine, np.full(len(mine), label.as_py(), np.int64), matrix[mine], least, ids, nulls))
        if held:
            yield emit()

    return blocks.select("block", "dim", "label", "n", "asked", "vectors", "ids", "nulls").mapInArrow(run, schema)


_CHUNK = "chunk long, zone_dim int, blocks binary, of_labels binary, low binary, high binary"


def zone_chunks(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Zone maps of up to ZONES blocks in a row, numbered from 0, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 24, []

        def emit() -> pa.RecordBatch:
            blobs = [np.array([h[k] for h in held], np.int64).tobytes() for k in (0, 2)] + [b"".join(h[k] for h in held) for k in (3, 4)]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([held[0][1]], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], [f.split()[0] for f in _CHUNK.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == ZONES or held[0][1] != row[1]):
                    yield emit()
                    chunk, held = chunk + 1, []
                held.append(row)
        if held:
            yield emit()

    chunks = ordered_offsets(blocks.select("block", "dim", "label", "low", "high").mapInArrow(run, _CHUNK), ["chunk"], {"number": F.lit(1).cast("long")})
    chunks = staged(chunks.drop("chunk"))
    return chunks, chunks.count()


_CELL = "of_block long, set long, members binary, places binary, vectors binary, lows binary, highs binary"


def _needed(asking: DataFrame, chunks: DataFrame, n_chunks: int, same: bool) -> DataFrame:
    """For each block and set of anchors: the anchors whose windows the block can hold a score of.

    ``same`` asks for blocks of an anchor's own label, else for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, places, labels, vectors, lows, highs, blocks, of_labels, low, high in zip(*batch.columns, strict=True):
                n = n.as_py()
                anchors, lows, highs = _matrix(vectors, n), _matrix(lows, n, np.int64), _matrix(highs, n, np.int64)
                places, labels = (np.frombuffer(x.as_buffer(), np.int64) for x in (places, labels))
                blocks, of_labels = (np.frombuffer(x.as_buffer(), np.int64) for x in (blocks, of_labels))
                wanted = (labels[:, None] == of_labels) == same
                if not wanted.any():
                    continue
                least, most = score_bounds(anchors, _matrix(low, len(blocks)), _matrix(high, len(blocks)))
                reached = np.zeros(wanted.shape, bool)
                for k in range(lows.shape[1]):
                    reached |= (most >= lows[:, k : k + 1]) & (least <= highs[:, k : k + 1]) & (lows[:, k : k + 1] <= highs[:, k : k + 1])
                reached &= wanted
                out = []
                for b in np.flatnonzero(reached.any(axis=0)).tolist():
                    m = np.flatnonzero(reached[:, b])
                    out.append((int(blocks[b]), name.as_py(), *(x.tobytes() for x in (m.astype(np.int32), places[m], anchors[m], lows[m], highs[m]))))
                if out:
                    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], [f.split()[0] for f in _CELL.split(", ")])

    asked = asking.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long")))) if n_chunks else asking.withColumn("number", F.lit(0).cast("long"))
    met = asked.join(chunks, "number").where("dim = zone_dim")
    return met.select("set", "n", "places", "labels", "vectors", "lows", "highs", "blocks", "of_labels", "low", "high").mapInArrow(run, _CELL)


_FOUND = "set long, member int, window int, score long, vec_id long"


def _best(cells: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """The ``most`` best scores of each window that its blocks hold, with a rank from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, found, held = None, [], 0

        def top() -> list[np.ndarray]:
            member, window, score, null, vec_id = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((vec_id, null, -score, window, member))
            m, w = member[order], window[order]
            first = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (w[1:] != w[:-1])))
            rank = np.arange(len(m)) - np.repeat(first, np.diff(np.append(first, len(m))))
            order = order[rank < most]
            return [x[order] for x in (member, window, score, null, vec_id)]

        def emit() -> Iterator[pa.RecordBatch]:
            member, window, score, null, vec_id = top()
            for at in range(0, len(member), 20_000):
                cut = slice(at, at + 20_000)
                columns = [pa.array(np.full(len(member[cut]), name)), pa.array(member[cut].astype(np.int32)), pa.array(window[cut].astype(np.int32)), pa.array(score[cut]), pa.array(vec_id[cut], mask=null[cut].astype(bool))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _FOUND.split(", ")])

        for batch in batches:
            for block, of_set, members, places, vectors, lows, highs, n, ids, nulls, matrix in zip(*batch.columns, strict=True):
                if of_set.as_py() != name:
                    if found:
                        yield from emit()
                    name, found, held = of_set.as_py(), [], 0
                members = np.frombuffer(members.as_buffer(), np.int32)
                k = len(members)
                scores = products(_matrix(vectors, k), _matrix(matrix, n.as_py()))
                own = np.frombuffer(places.as_buffer(), np.int64)
                here = np.flatnonzero(own // BLOCK == block.as_py())
                lows, highs = _matrix(lows, k, np.int64), _matrix(highs, k, np.int64)
                ids, nulls = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(nulls.as_buffer(), np.uint8)
                for w in range(lows.shape[1]):
                    inside = (scores >= lows[:, w : w + 1]) & (scores <= highs[:, w : w + 1])
                    inside[here, own[here] % BLOCK] = False  # the anchor itself
                    a, r = np.nonzero(inside)
                    if len(a):
                        found.append([members[a], np.full(len(a), w, np.int32), scores[a, r], nulls[r], ids[r]])
                        held += len(a)
                if held > HELD:
                    found = [top()]
                    held = len(found[0][0])
        if found:
            yield from emit()

    read = cells.join(blocks.select("block", F.col("n").alias("rows"), "ids", "nulls", F.col("vectors").alias("matrix")), F.col("of_block") == F.col("block"))
    # A task holds the findings of one set of anchors at a time.
    met = read.select("of_block", "set", "members", "places", "vectors", "lows", "highs", "rows", "ids", "nulls", "matrix").sortWithinPartitions("set")
    best = Window.partitionBy("set", "member", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return met.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def _with_windows(asking: DataFrame, positives: DataFrame, most: int, low_percent: int, high_percent: int) -> DataFrame:
    """The sets of anchors again, asking for the windows that their positives give."""
    gathered = positives.groupBy("set").agg(F.collect_list(F.struct("member", "rank", "score")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_lows, all_highs = [], []
            for n, found in zip(batch.column(2).to_pylist(), batch.column(6).to_pylist(), strict=True):
                lows, highs = np.full((n, most), 1, np.int64), np.full((n, most), 0, np.int64)  # no window
                for f in found:
                    lows[f["member"], f["rank"] - 1] = -(-low_percent * f["score"] // 100)
                    highs[f["member"], f["rank"] - 1] = high_percent * f["score"] // 100
                all_lows.append(lows.tobytes())
                all_highs.append(highs.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(all_lows, pa.binary()), pa.array(all_highs, pa.binary())], [f.split()[0] for f in _ASK.split(", ")])

    return asking.join(gathered, "set").select("set", "dim", "n", "places", "labels", "vectors", "found").mapInArrow(run, _ASK)


def hard_negatives(vectors: DataFrame, label: Column, asked: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """For each anchor and each of its positives: the best rows of other labels in the positive's window.

    Components are floor(256 x); a score is their inner product. Rows lie in blocks of one label in
    order of a Hilbert curve, each with the least and largest component of every dimension. What an
    anchor has in its own block bounds its positives from below; interval arithmetic on the zone maps
    then tells which blocks can hold one, and, once the positives are known, which can hold a score
    from ``low_percent`` to ``high_percent`` of a positive's. Only those blocks meet the anchor, so
    the result is exact. A block meets at most ANCHORS anchors in a row, so no task holds more than
    a block, a set of anchors and their best scores, whatever share of the rows a label has.

    Rows with a null label, a null vector or a null or non-finite component take no part. Higher
    scores come first, ties by smaller vec_id, null last. Rows are told apart by their place, so a
    repeated row is another row, and a repeated anchor asks again. Only vectors of as many components
    meet, the empty ones with score 0. Components beyond 2^25 count as 2^25. An anchor without
    positives or negatives, and an empty table, give no rows. Only vec_id, label and embedding are read.
    """
    blocks = staged(hilbert_blocks(staged(whole_vectors(vectors, label, asked))))
    chunks, n_chunks = zone_chunks(blocks)
    asking = staged(_asking(blocks, positives))
    near = staged(_best(_needed(asking, chunks, n_chunks, True), blocks, positives))
    far = _best(_needed(_with_windows(asking, near, positives, low_percent, high_percent), chunks, n_chunks, False), blocks, negatives)
    place = ["set", "member"]
    anchors = asking.select("set", F.posexplode("anchors").alias("member", "anchor_id"))
    of = near.select(*place, (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(of, [*place, "window"]).join(anchors, place)
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", (F.col("window") + 1).alias("positive_rank"))
