"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures (operator 2)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.components import connected, merged
from metricloom.llm.support import LOWER, RangeHash, as_bytes, byte_slices, frugal, mix, staged, word_spans

BITS = 12
# Bits of a set's parity map: whether an odd number of its shingles falls on each.
PARITY = 1024
# Counters of shingles by which they are ordered, rare ones first; more would change no result.
COUNTERS = 1 << 16


@dataclass(frozen=True)
class Signatures:
    """Signatures of ``chunks`` chunks of ``width`` symbols of 12 bits, each chunk with ``errors`` allowed.

    Two signatures that differ in less than chunks * (errors + 1) symbols have, by the pigeonhole
    principle, a chunk in which they differ in at most ``errors``, and so share one of the keys made
    by leaving out every choice of ``errors`` symbols of every chunk. ``chunks`` is the least number
    at which a pair just at ``percent`` similarity shares no key with a probability under 1e-6, and
    ``most`` the distance that such a pair exceeds with a probability under 1e-9.
    """

    percent: int
    shingle: int = 5
    width: int = 5
    errors: int = 1

    def _beyond(self, n: int, k: int) -> float:
        p = 1 - self.percent / 100
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))

    @property
    def chunks(self) -> int:
        return max(1, math.ceil(math.log(1e-6) / math.log(self._beyond(self.width, self.errors)))) if self.percent < 100 else 1

    @property
    def most(self) -> int:
        n = self.chunks * self.width
        return next(k for k in range(n + 1) if self._beyond(n, k) < 1e-9)

    def keys(self, chunks: Column) -> Column:
        """All keys of a signature; number of chunk and left-out symbols, then the symbols that stay."""
        found = []
        for chunk in range(self.chunks):
            word = F.get(chunks, F.lit(chunk))
            for out in itertools.combinations(range(self.width), self.errors):
                key, place = F.lit(len(found)).cast("long"), 0
                for symbol in range(self.width):
                    if symbol not in out:
                        field = F.shiftrightunsigned(word, BITS * symbol).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
                        key = F.shiftleft(key, BITS).bitwiseOR(field)
                found.append(key)
        return F.array(*found)

    def distance(self, left: Column, right: Column) -> Column:
        """Symbols in which two signatures differ."""

        def every(bits: int) -> Column:
            return F.lit(sum(bits << (BITS * i) for i in range(self.width))).cast("long")

        total = F.lit(0)
        for chunk in range(self.chunks):
            x = F.get(left, F.lit(chunk)).bitwiseXOR(F.get(right, F.lit(chunk)))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 6)).bitwiseAND(every(0b111111))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(every(0b111))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(every(1))
            total = total + F.bit_count(x)
        return total


    def may_link(self, a: str, b: str) -> Column:
        """Whether two classes that share a rare shingle can be linked at all and are not yet.

        The shingles from the shared one on must be as many as a link needs in common, the parity
        maps must not differ in more bits than the sets may differ in shingles, and the signatures
        must be within the distance.
        """
        n_a, n_b = F.col(f"{a}_n_shingles"), F.col(f"{b}_n_shingles")
        most = F.least(n_a - F.col(f"{a}_place"), n_b - F.col(f"{b}_place"))
        new = F.col(f"{a}_component") < F.col(f"{b}_component")
        enough = most * (100 + self.percent) >= self.percent * (n_a + n_b)
        odd = F.lit(0)
        for i in range(PARITY // 64):
            odd = odd + F.bit_count(F.get(f"{a}_parity", F.lit(i)).bitwiseXOR(F.get(f"{b}_parity", F.lit(i))))
        # 100 * common >= percent * (n_a + n_b - common), with n_a + n_b - 2 * common >= odd.
        alike = (n_a + n_b - odd) * (100 + self.percent) >= 2 * self.percent * (n_a + n_b)
        return new & enough & alike & (self.distance(F.col(f"{a}_chunks"), F.col(f"{b}_chunks")) <= self.most)


_FACTORS = np.random.default_rng(5).integers(1, 2**62, (2, 512), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(6).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, edges: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice; fewer words make one shingle."""
    starts, ends, first = word_spans(data, edges)
    words = RangeHash(data, 0, LOWER)(starts, ends)
    n = len(words)
    runs = np.zeros(max(0, n - shingle + 1), np.uint64)
    for place in range(shingle):
        runs += words[place : place + len(runs)] * _PLACES[place]
    runs = mix(runs)
    for start, end in itertools.pairwise(first):
        if end - start >= shingle:
            yield np.unique(runs[start : end - shingle + 1])
        elif end > start:
            few = words[start:end] * _PLACES[: end - start]
            yield mix(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(end - start))
        else:
            yield np.zeros(0, np.uint64)


def _signature(found: np.ndarray, symbols: int) -> np.ndarray:
    least = np.full(symbols, np.uint64(2**64 - 1))
    for at in range(0, len(found), 1024):
        values = found[at : at + 1024, None] * _FACTORS[0, :symbols] + _FACTORS[1, :symbols]
        np.minimum(least, values.min(axis=0), out=least)
    return mix(least) >> np.uint64(64 - BITS)


def signatures(rows: DataFrame, kind: Signatures) -> DataFrame:
    """row, n_shingles, a 128-bit fingerprint and a parity map of the shingle set, and the signature of every text."""
    symbols = kind.chunks * kind.width
    places = (np.uint64(BITS) * np.arange(kind.width, dtype=np.uint64))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, edges in byte_slices(batch):
                sizes, prints, words, maps = [], [], [], []
                for found in shingle_sets(data, edges, kind.shingle):
                    sizes.append(len(found))
                    odd = np.bincount((found >> np.uint64(38)).astype(np.int64) % PARITY, minlength=PARITY) & 1
                    maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    prints.append((mix(found + _PLACES[20]).sum(dtype=np.uint64), mix(found ^ _PLACES[21]).sum(dtype=np.uint64)))
                    words.append(np.bitwise_or.reduce(_signature(found, symbols).reshape(kind.chunks, kind.width) << places, axis=1).view(np.int64))
                prints = np.array(prints, np.uint64).view(np.int64)
                chunks, parity = (pa.ListArray.from_arrays(np.arange(0, len(x) * len(x[0]) + 1, len(x[0]), dtype=np.int32), pa.array(np.concatenate(x))) for x in (words, maps))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), chunks, parity], ["row", "n_shingles", "print_a", "print_b", "chunks", "parity"]
                )

    return rows.select("row", as_bytes("text")).mapInArrow(frugal(run), "row long, n_shingles long, print_a long, print_b long, chunks array<long>, parity array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, kind: Signatures) -> DataFrame:
    """The pairs (left, right) whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs come sorted by their right side, whose set is made once.
        last, last_set = None, None
        for batch in batches:
            rights = batch.column(3).to_pylist()
            good = []
            at = 0
            for part, data, edges in byte_slices(batch, "left_text"):
                for found in shingle_sets(data, edges, kind.shingle):
                    right = rights[at]
                    if right != last:
                        raw = np.frombuffer(right, np.uint8)
                        last, last_set = right, next(shingle_sets(raw, np.array([0, len(raw)]), kind.shingle))
                    both = len(np.intersect1d(found, last_set, assume_unique=True))
                    good.append(100 * both >= kind.percent * (len(found) + len(last_set) - both))
                    at += 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["left", "right"])

    left = texts.select(F.col("row").alias("left"), F.col("text").alias("left_text"))
    right = texts.select(F.col("row").alias("right"), F.col("text").alias("right_text"))
    joined = pairs.join(left, "left").join(right, "right").select("left", "right", "left_text", "right_text")
    return joined.mapInArrow(frugal(run), "left long, right long")


def _rare_shingles(texts: DataFrame, kind: Signatures) -> DataFrame:
    """class, shingle and place of the first shingles of each text, rare ones first.

    Of two linked sets one of the first n - ceil(percent * n) + 1 shingles of each is common, in any
    order that is the same for all. Here it is that of a fixed number of counters over all texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, data, edges in byte_slices(batch):
                for found in shingle_sets(data, edges, kind.shingle):
                    total += np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["counter", "n"])

    counted = texts.select("row", "text").mapInArrow(frugal(count), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(COUNTERS, np.int64)
    for r in counted:
        totals[r["counter"]] = r["n"]
    known = texts.sparkSession.sparkContext.broadcast(totals)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = known.value
        for batch in batches:
            for rows, data, edges in byte_slices(batch):
                classes, shingles, places = [], [], []
                for row, found in zip(rows.column(0).to_pylist(), shingle_sets(data, edges, kind.shingle), strict=True):
                    n = len(found) - -(-kind.percent * len(found) // 100) + 1
                    order = np.lexsort((found, totals[(found >> np.uint64(48)).astype(np.int64)]))[:n]
                    classes.append(np.full(n, row))
                    shingles.append(found[order].view(np.int64))
                    places.append(np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (classes, shingles, places)], ["class", "shingle", "place"])

    return texts.select("row", "text").mapInArrow(frugal(first), "class long, shingle long, place long")


def near_duplicate_groups(rows: DataFrame, percent: int, shingle: int = 5) -> DataFrame:
    """row, n_shingles and group of each row of ``rows`` (unique long row, text).

    ``rows`` is read more than once and should be a written table. Equal shingle sets are one class,
    and only classes are compared. Candidates are classes that share a key. First each class is held
    against the hub of its keys, so that a large group of near copies becomes one component by a
    number of pairs that is linear in its size. Classes of keys that still join
    different components are then paired where they share a rare shingle, as linked sets must, are
    within the signature distance and can still reach the similarity. All links are confirmed on
    whole shingle sets. The group is the least row of the component; texts without words are alone.
    """
    kind = Signatures(percent, shingle)
    known = staged(signatures(rows, kind))
    same = ["print_a", "print_b", "n_shingles"]
    classes = staged(known.where("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("class"), F.min_by("chunks", "row").alias("chunks"), F.min_by("parity", "row").alias("parity")))
    keyed = classes.select("class", F.explode(kind.keys(F.col("chunks"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    keyed = staged(keyed.join(shared, "key"))
    # The class that meets most others is the hub of its keys: in a group of copies, the original.
    weights = staged(keyed.groupBy("class").agg(F.sum("members").alias("weight")))
    involved = weights.select("class")
    texts = staged(rows.select("row", as_bytes("text")).join(weights.select(F.col("class").alias("row")), "row"))
    weighted = keyed.select("key", "class").join(weights, "class")
    hubs = weighted.groupBy("key").agg(F.max_by("class", F.struct("weight", "class")).alias("hub"), F.max("weight").alias("hub_weight"))
    asked = keyed.select("key", "class").join(hubs, "key").where("class != hub")
    stars = asked.groupBy("class").agg(F.max_by("hub", F.struct("hub_weight", "hub")).alias("hub"))
    links = _linked(stars.select(F.col("class").alias("left"), F.col("hub").alias("right")), texts, kind)
    components = merged(involved, None, links)

    # What is left: classes of keys that still join different components.
    at = keyed.join(components, "class")
    open_keys = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = at.join(open_keys, "key").select("class", "component").distinct()
    members = staged(left.join(classes.select("class", "n_shingles", "chunks", "parity"), "class"))
    marks = _rare_shingles(texts.join(members.select(F.col("class").alias("row")), "row", "left_semi"), kind).join(members, "class")
    a, b = (marks.select(*[F.col(c).alias(f"{side}_{c}") for c in marks.columns]) for side in ("a", "b"))
    pairs = a.join(b, (F.col("a_shingle") == F.col("b_shingle")) & kind.may_link("a", "b")).select(F.col("a_class").alias("left"), F.col("b_class").alias("right")).distinct()
    components = merged(involved, components, _linked(pairs, texts, kind))

    of_class = classes.join(components, "class", "left").select(*same, F.coalesce("component", "class").alias("group"))
    linked = known.where("n_shingles > 0").join(of_class, same).select("row", "n_shingles", "group")
    return linked.unionByName(known.where("n_shingles = 0").select("row", "n_shingles", F.col("row").alias("group")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Size of the shingle set, component and whether it is the one to keep, for every document.

    Words are split at ASCII white space after lower-casing A-Z. Null and empty texts and texts
    without words have no shingle and no link. component_id is the smallest doc_id of the component,
    null only if it has no other; repeated rows are in one component and share ``kept``; an empty
    table gives no rows. Only doc_id and text are read.
    """
    rows = staged(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    groups = staged(near_duplicate_groups(rows, percent))
    named = rows.select("row", "doc_id").join(groups, "row")
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "group").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates, with the columns of ``docs``."""
    rows = staged(docs.select(F.struct(*docs.columns).alias("whole")).withColumn("row", F.monotonically_increasing_id()))
    groups = near_duplicate_groups(rows.select("row", "whole.text"), percent)
    # Null ids come last; of repeated ids the first row stays.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.select("row", "whole.doc_id").join(groups, "row").groupBy("group").agg(F.min_by("row", order).alias("row")).select("row")
    return rows.join(first, "row").select("whole.*")
