"""Log probabilities of texts under a context-tree-weighted byte model (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.context_tree import Subtrees, grams, weigh
from metricloom.llm.support import LOWER, RangeHash, as_bytes, byte_slices, frugal, give_back, partitions, staged, word_spans

DEPTH = 5
# Context bytes that the grams of one chunk share. Nodes of two, one and no context bytes are put
# together from all tasks.
SHARED = 3
# Bytes of text that ask for their words and grams together.
GROUP_BYTES = 32 << 20
# Grams whose trees are in memory at once, at least; more only if they share a context. A tree has
# about a kilobyte for each.
CHUNK = 50_000
# Bytes that are looked at at once, and slices whose counts are kept apart; both only bound memory.
SLICE, MERGED = 1 << 19, 8
WORD, GRAM, TEXT = 0, 1, 2
SMOOTHING = 0.1


def _asked(rows: DataFrame, depth: int) -> DataFrame:
    """Distinct words and grams of each group of texts, with their counts in its training texts."""

    def emit(group: int, kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        _together(parts, 1)
        keys, counts = parts[0][0].view(np.int64), parts[0][1].astype(np.int64)
        for at in range(0, len(keys), 50_000):
            k, c = keys[at : at + 50_000], counts[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), group)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c)], ["g", "kind", "key", "n"])
        parts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, words, found = None, [], []
        for batch in batches:
            for part, data, edges in byte_slices(batch, limit=SLICE):
                groups, trained = part.column(0).to_numpy(), ~part.column(1).to_numpy(zero_copy_only=False)
                for start, end in zip(*_stretches(groups), strict=True):
                    if groups[start] != group:
                        if group is not None:
                            yield from emit(group, WORD, words)
                            yield from emit(group, GRAM, found)
                            give_back()
                        group, words, found = groups[start], [], []
                    mine = data[edges[start] : edges[end]]
                    own = edges[start : end + 1] - edges[start]
                    begin, stop, first = word_spans(mine, own)
                    if len(begin):
                        words.append(_counted(RangeHash(mine, 0, LOWER)(begin, stop), np.repeat(trained[start:end], np.diff(first))))
                    keys, places = grams(LOWER[mine], own, depth)
                    found.append(_counted(keys, np.repeat(trained[start:end], np.diff(places))))
                    _together(words, MERGED)
                    _together(found, MERGED)
        if group is not None:
            yield from emit(group, WORD, words)
            yield from emit(group, GRAM, found)

    return rows.select("g", "held_out", "text").mapInArrow(frugal(run), "g long, kind int, key long, n long")


def _together(parts: list[tuple[np.ndarray, np.ndarray]], most: int) -> None:
    """Make one of the counted keys of several slices, once there are more than ``most`` of them."""
    if len(parts) > most:
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        parts[:] = [(keys[first], np.add.reduceat(counts, first))]


def _stretches(values: np.ndarray) -> tuple[list[int], list[int]]:
    turns = np.flatnonzero(values[1:] != values[:-1]) + 1
    return [0, *turns.tolist()], [*turns.tolist(), len(values)]


def _counted(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, trained, len(found)).astype(np.int32)


def _node_ids(keys: np.ndarray, bit: int) -> np.ndarray:
    """Number of a decision: a one and then the bits before it."""
    return ((1 << bit) | (keys & np.uint64((1 << bit) - 1)).astype(np.int64)).astype(np.int64)


def _whole_contexts(batches: Iterator[list[np.ndarray]], depth: int, least: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """Sorted rows in chunks that end where the shared context of the first column's grams ends."""
    held: list[list[np.ndarray]] = []
    rows = 0
    shift = np.uint64(8 * (depth + 1 - SHARED))
    for columns in batches:
        if not len(columns[0]):
            continue
        held.append(columns)
        rows += len(columns[0])
        if rows >= least:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            context = whole[0].view(np.uint64) >> shift
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield [c[:cut] for c in whole]
            held = [[c[cut:] for c in whole]]
            rows = len(held[0][0])
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _upper_sums(model: DataFrame, depth: int) -> DataFrame:
    """For each context one byte shorter than the shared ones: counts and its children's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _whole_contexts(([b.column(0).to_numpy(), b.column(1).to_numpy()] for b in batches), depth):
            trees = Subtrees(keys.view(np.uint64), counts, depth, SHARED)
            for bit in range(8):
                level = trees.levels[SHARED][bit]
                context = (level.keys >> np.uint64(bit + 8)).astype(np.int64)
                code = context << 8 | _node_ids(level.keys, bit)
                found, inverse = np.unique(code, return_inverse=True)
                sums = [np.bincount(inverse, x, len(found)) for x in (level.zeros, level.ones, level.weighted)]
                if bit == 7:
                    trees = level = None
                yield pa.RecordBatch.from_arrays([pa.array(found >> 8), pa.array(found & 255), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], ["context", "node", "zeros", "ones", "below"])

    prefix = F.shiftrightunsigned("key", 8 * (depth + 1 - SHARED))
    dealt = model.repartition(partitions(model.sparkSession), prefix).sortWithinPartitions("key")
    sums = dealt.mapInArrow(frugal(run), "context long, node long, zeros long, ones long, below double")
    return sums.groupBy("context", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])


def _weighed(sums: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zeros, ones, below = (batch.column(i).to_numpy() for i in (2, 3, 4))
            weighted, own = weigh(zeros, ones, below)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weighted), pa.array(own)], ["context", "node", "zeros", "ones", "weighted", "own"])

    return sums.mapInArrow(run, "context long, node long, zeros long, ones long, weighted double, own double")


def gram_probabilities(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Log probability of the byte of each gram of ``counts`` (key, n), mixed over all depths.

    Grams that share their last ``SHARED`` context bytes meet in one task, at most 256^3 of them at
    the depth used. The nodes above are sums over tasks; those of one context byte and of none, at
    most 256 * 255, pass through the driver and go to all tasks.
    """
    spark = counts.sparkSession
    above = staged(_weighed(_upper_sums(counts, depth)))
    tops = above.groupBy(F.shiftright("context", 8).alias("c"), "node").agg(*[F.sum(x).alias(x) for x in ("zeros", "ones", "weighted")]).collect()
    zeros, ones, below = (np.zeros((256, 256), t) for t in (np.int64, np.int64, float))
    for r in tops:
        zeros[r["c"], r["node"]], ones[r["c"], r["node"]], below[r["c"], r["node"]] = r["zeros"], r["ones"], r["weighted"]
    one, own_one = weigh(zeros, ones, below)
    zero_sums = zeros.sum(axis=0), ones.sum(axis=0)
    # A context byte without any gram has nothing below it.
    seen = np.zeros((256, 256), bool)
    seen[[r["c"] for r in tops], [r["node"] for r in tops]] = True
    _, own_none = weigh(*zero_sums, np.where(seen, one, 0.0).sum(axis=0))
    tables = spark.sparkContext.broadcast((own_one, (ones + 0.5) / (zeros + ones + 1), own_none, (zero_sums[1] + 0.5) / (zero_sums[0] + zero_sums[1] + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_one, right_one, own_none, right_none = tables.value
        near: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def keys() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                pre, kind, key, a, b = (c.to_numpy() for c in batch.columns)
                upper = kind == 0
                for c, node, x, y in zip(pre[upper].tolist(), key[upper].tolist(), a[upper].tolist(), b[upper].tolist(), strict=True):
                    if c not in near:
                        near[c] = np.zeros(256), np.zeros(256)
                    near[c][0][node], near[c][1][node] = x, y
                yield [key[~upper], a[~upper].astype(np.int64), pre[~upper]]

        for key, n, pre in _whole_contexts(keys(), depth):
            gram = key.view(np.uint64)
            trees = Subtrees(gram, n, depth, SHARED)
            contexts, at = np.unique(pre, return_inverse=True)
            own_two, right_two = (np.stack([near[c][i] for c in contexts.tolist()]) for i in (0, 1))
            last = (gram >> np.uint64(8 * depth)).astype(np.int64)
            total = np.zeros(len(gram))
            for bit in range(8):
                node = _node_ids((gram & np.uint64(255)) >> np.uint64(8 - bit), bit)
                value = ((gram >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
                mixed = trees.predictions(bit)
                for own, right in ((own_two[at, node], right_two[at, node]), (own_one[last, node], right_one[last, node]), (own_none[node], right_none[node])):
                    mixed = own * np.where(value, right, 1 - right) + (1 - own) * mixed
                total += np.log(mixed)
            trees = None
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], ["key", "log_p"])
            for c in contexts.tolist()[:-1]:
                near.pop(c, None)

    places = above.select(F.col("context").alias("pre"), F.lit(0).alias("kind"), F.col("node").alias("key"), F.col("own").alias("a"), ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("b"))
    asked = counts.select(F.shiftrightunsigned("key", 8 * (depth + 2 - SHARED)).alias("pre"), F.lit(1).alias("kind"), "key", F.col("n").cast("double").alias("a"), F.lit(0.0).alias("b"))
    stream = places.unionByName(asked).repartition(partitions(spark), "pre").sortWithinPartitions("pre", "kind", "key")
    return stream.mapInArrow(frugal(run), "key long, log_p double")


def scored_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Word-model base and context-tree score of every document, in log10.

    Documents whose crc32(doc_id as text) is divisible by 10 are held out; all others train both
    models. Texts are lower-cased in A-Z; each is followed by an end, which is a token and a byte
    that no text has. A null or empty text has its end alone; a null doc_id counts as the text '';
    repeated rows count and are scored each; with no training text every byte costs 8 bits.

    Groups of texts ask for the counts of their own words and grams and get back a number for each,
    so no task ever holds the model or the vocabulary. Each group is a partition of its own.
    """
    if not SHARED <= depth <= 6:
        raise ValueError(f"contexts of {SHARED} to 6 bytes")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    groups = max(partitions(spark) // 4, -(-total // GROUP_BYTES), 1)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = staged(docs.select((F.monotonically_increasing_id() % groups).alias("g"), held_out.alias("held_out"), as_bytes("text"), "doc_id").repartitionById(groups, F.col("g").cast("int")).sortWithinPartitions("g"))
    asked = staged(_asked(rows, depth))

    words = asked.where(F.col("kind") == WORD)
    totals = staged(words.groupBy("key").agg(F.sum("n").alias("total")))
    sums = totals.where("total > 0").agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = rows.where("not held_out").count()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)

    wanted = asked.where(F.col("kind") == GRAM).select("g", "key", "n")
    counts = staged(wanted.groupBy("key").agg(F.sum("n").alias("n")))
    known = staged(gram_probabilities(counts, depth))
    answers = words.join(totals, "key").select("g", F.lit(WORD).alias("kind"), "key", F.col("total").cast("double").alias("value")).unionByName(
        wanted.join(known, "key").select("g", F.lit(GRAM).alias("kind"), "key", F.col("log_p").alias("value"))
    )
    whole = n + SMOOTHING * (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, values = None, {}, {}
        for batch in batches:
            groups, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, end in zip(*_stretches(groups * 4 + kinds), strict=True):
                if groups[start] != group:
                    group, keys, values = groups[start], {WORD: [], GRAM: []}, {WORD: [], GRAM: []}
                    give_back()
                kind, mine = int(kinds[start]), batch.slice(start, end - start)
                if kind != TEXT:
                    keys[kind].append(mine.column(2).to_numpy().copy())
                    values[kind].append(mine.column(3).to_numpy().copy())
                    continue
                for k in (WORD, GRAM):
                    if isinstance(keys[k], list):
                        keys[k], values[k] = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((keys[k], np.int64), (values[k], np.float64)))
                for part, data, edges in byte_slices(mine, limit=SLICE):
                    begin, stop, first = word_spans(data, edges)
                    count = np.diff(first)
                    owner = np.repeat(np.arange(len(count)), count)
                    c = values[WORD][np.searchsorted(keys[WORD], RangeHash(data, 0, LOWER)(begin, stop).view(np.int64))] if len(begin) else np.zeros(0)
                    base = np.bincount(owner, np.log10((c + SMOOTHING) / whole), len(count)) + np.log10((ends + SMOOTHING) / whole)
                    heard = np.bincount(owner, c > 0, len(count)).astype(np.int64) + int(ends > 0)
                    found, places = grams(LOWER[data], edges, depth)
                    distinct, inverse = np.unique(found.view(np.int64), return_inverse=True)
                    score = np.add.reduceat(values[GRAM][np.searchsorted(keys[GRAM], distinct)][inverse], places[:-1]) / np.log(10)
                    held_out = pa.array(part.column(3).to_numpy() > 0)
                    yield pa.RecordBatch.from_arrays([part.column(2), held_out, pa.array(count + 1), pa.array(heard), pa.array(np.full(len(count), n)), pa.array(base), pa.array(score)], _NAMES)

    # In each group the answers come first, sorted by key, and then the texts one after another.
    texts = rows.select("g", F.lit(TEXT).alias("kind"), F.col("doc_id").cast("long").alias("key"), F.col("held_out").cast("int").cast("double").alias("value"), "text")
    stream = answers.withColumn("text", F.lit(None).cast("binary")).unionByName(texts).repartitionById(groups, F.col("g").cast("int")).sortWithinPartitions("g", "kind", "key")
    return stream.mapInArrow(frugal(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
