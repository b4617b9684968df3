"""Filter interaction audit over a sparse document-term matrix (operator 13)."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.support import as_bytes, frugal, give_back, ordered_offsets, partitions, staged

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
# A shard of the matrix ends at so many bytes of text or words of vocabulary; a text is split at so many bytes.
SHARD_BYTES, SHARD_WORDS, PIECE = 32 << 20, 1 << 20, 1 << 20
# Words that meet at once, copies from different shards counted each.
BUCKET_WORDS = 250_000

_LOCAL = "shard long, place int, doc_id long, part string, others int, digest binary, terms binary, counts binary, words binary, sizes binary, hashes binary"
_NAMES = [f.split()[0] for f in _LOCAL.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 6]
_SPACE = b" \t\n\r\x0b\x0c"


def words_of(raw: bytes) -> Counter:
    """Counts of the words of a text, which is split piece by piece at white space."""
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            # The piece ends at its last white space; a longer word moves the end to the next one.
            cut = max(raw.rfind(bytes([s]), at, end) for s in _SPACE)
            if cut < 0:
                cut = min((c for s in _SPACE if (c := raw.find(bytes([s]), end)) >= 0), default=len(raw) - 1)
            end = cut + 1
        counts.update(raw[at:end].split())
        at = end
    return counts


def _local_terms(docs: DataFrame) -> DataFrame:
    """Rows of the matrix in the vocabulary of their shard, and a row with that vocabulary for each shard.

    A row has a digest of its text and the filters C and D as bits 2 and 3 of ``others``. The row of a
    vocabulary has its ``words`` one after another, their ``sizes`` and their ``hashes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, vocabulary, read, place, out, size = TaskContext.get().partitionId() << 32, _numbering(), 0, 0, [], 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _KINDS, strict=True)], _NAMES)

        def words() -> tuple:
            hashes = np.fromiter(map(zlib.crc32, vocabulary), np.uint32, len(vocabulary))
            sizes = np.fromiter(map(len, vocabulary), np.int32, len(vocabulary))
            return shard, len(vocabulary), *[None] * 6, b"".join(vocabulary), sizes.tobytes(), hashes.tobytes()

        for batch in batches:
            for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                bytes_found = np.zeros(256, np.int64)
                for at in range(0, len(raw), PIECE):
                    bytes_found += np.bincount(np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at), minlength=256)
                points = len(raw) - bytes_found[0x80:0xC0].sum()
                others = 4 * int(100 * bytes_found[65:91].sum() > MOST_CAPITALS_PERCENT * points) + 8 * int(bytes_found[list(SYMBOLS)].any())
                found = words_of(raw)
                terms = np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found))
                counts = np.fromiter(found.values(), np.int32, len(found))
                out.append((shard, place, doc, part, others, hashlib.sha256(raw).digest(), terms.tobytes(), counts.tobytes(), None, None, None))
                place, read, size = place + 1, read + len(raw), size + 8 * len(found)
                full = read >= SHARD_BYTES or len(vocabulary) >= SHARD_WORDS
                if full:
                    out.append(words())
                    shard, vocabulary, read, place = shard + 1, _numbering(), 0, 0
                if full or size > 1 << 20:
                    yield emit()
                    out, size = [], 0
        if place:
            out.append(words())
            yield emit()

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    return docs.select("doc_id", part, as_bytes("text")).mapInArrow(frugal(run), _LOCAL)


def _numbering() -> defaultdict:
    """Gives each new key the next number."""
    return defaultdict(itertools.count().__next__)


def _binaries(data: bytes, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _parts(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of an array of words and the size of each."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + 1, 4 * words.offset)
    return (data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""), np.diff(ends)


_PART = "bucket int, shard long, local binary, sizes binary, words binary"
_NUMBERED = "bucket int, shard long, n int, local binary, numbers binary, sizes binary, words binary"


def numbered_words(local: DataFrame) -> DataFrame:
    """The words of all shards, numbered within each bucket of a hash.

    A word meets its copies from other shards, one for each that has it. A row with a ``shard`` has the
    ``numbers`` of the words ``local`` of that shard; a row without has the ``n`` distinct words of the
    bucket in order of their numbers.
    """
    vocabularies = local.where("words is not null").select("shard", "words", "sizes", "hashes")
    total = local.where("words is not null").agg(F.sum("place")).first()[0] or 0
    buckets = max(partitions(local.sparkSession), -(-total // BUCKET_WORDS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words, sizes, hashes in zip(*batch.columns, strict=True):
                bucket = np.frombuffer(hashes.as_buffer(), np.uint32) % np.uint32(buckets)
                if not len(bucket):
                    continue
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                dealt = _binaries(words.as_buffer(), np.frombuffer(sizes.as_buffer(), np.int32)).take(pa.array(order))
                out = []
                for b, start, end in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                    data, lengths = _parts(dealt.slice(start, end - start))
                    out.append((b, shard.as_py(), order[start:end].astype(np.int32).tobytes(), lengths.astype(np.int32).tobytes(), data))
                if out:
                    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], [f.split()[0] for f in _PART.split(", ")])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def emit() -> pa.RecordBatch:
            lengths = [np.frombuffer(h[2], np.int32) for h in held]
            coded = _binaries(b"".join(h[3] for h in held), np.concatenate(lengths)).dictionary_encode()
            numbers, at, out = coded.indices.to_numpy().astype(np.int32), 0, []
            for (shard, local, _, _), mine in zip(held, lengths, strict=True):
                out.append((bucket, shard, None, local, numbers[at : at + len(mine)].tobytes(), None, None))
                at += len(mine)
            data, sizes = _parts(coded.dictionary)
            out.append((bucket, None, len(sizes), None, None, sizes.astype(np.int32).tobytes(), data))
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], [f.split()[0] for f in _NUMBERED.split(", ")])

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and b != bucket:
                    yield emit()
                    held = []
                bucket = b
                held.append(row)
        if held:
            yield emit()

    dealt = vocabularies.mapInArrow(frugal(split), _PART).repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard")
    return staged(dealt.mapInArrow(frugal(number), _NUMBERED))


def _starts(numbered: DataFrame) -> DataFrame:
    """The number of words in earlier buckets."""
    sizes = numbered.where("shard is null").select(F.col("bucket").alias("of_bucket"), "n")
    return ordered_offsets(sizes, ["of_bucket"], {"start": F.col("n").cast("long")}).drop("n")


def dictionary(numbered: DataFrame) -> DataFrame:
    """Every distinct word once, with ``term``: its dense number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, sizes, words in zip(*batch.columns, strict=True):
                listed = _binaries(words.as_buffer(), np.frombuffer(sizes.as_buffer(), np.int32))
                yield pa.RecordBatch.from_arrays([listed, pa.array(start.as_py() + np.arange(len(listed)))], ["word", "term"])

    listed = numbered.where("shard is null").join(_starts(numbered), F.col("bucket") == F.col("of_bucket"))
    return listed.select("start", "sizes", "words").mapInArrow(run, "word binary, term long")


_CSR = "shard long, first int, indptr binary, indices binary, data binary"


def csr_shards(local: DataFrame, numbered: DataFrame) -> DataFrame:
    """Shards of the document-term matrix in compressed sparse rows over the global dictionary.

    Rows ``first``, ``first`` + 1, ... of a shard: ``indptr`` (int64), ``indices`` (int64, increasing in
    each row) and ``data`` (int32). A shard asks for the numbers of its own words, so no task holds
    the dictionary, and a frequent word is looked up once for each shard.
    """
    numbers = numbered.where("shard is not null").join(_starts(numbered), F.col("bucket") == F.col("of_bucket"))
    numbers = numbers.select(F.col("shard").alias("of_shard"), "start", "local", "numbers")
    rows = local.where("words is null").select("shard", "place", "terms", "counts")

    def encode(rows: pa.Table, numbers: pa.Table) -> pa.Table:
        pairs = [(start, np.frombuffer(local, np.int32), np.frombuffer(found, np.int32)) for start, local, found in zip(*(numbers.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        terms = np.empty(sum(len(local) for _, local, _ in pairs), np.int64)
        for start, local, found in pairs:
            terms[local] = start + found.astype(np.int64)
        order = np.argsort(rows.column(1).to_numpy())
        local, counts = (x.take(pa.array(order)).to_pylist() for x in (rows.column(2), rows.column(3)))
        lengths = np.array([len(x) // 4 for x in local], np.int64)
        indptr = np.append(0, np.cumsum(lengths))
        indices, data = terms[np.frombuffer(b"".join(local), np.int32)], np.frombuffer(b"".join(counts), np.int32)
        within = np.lexsort((indices, np.repeat(np.arange(len(lengths)), lengths)))
        blobs = [b.tobytes() for b in (indptr, indices[within], data[within])]
        shard, first = ([rows.column(0)[0].as_py()], [int(rows.column(1)[int(order[0])].as_py())]) if len(rows) else ([], [])
        columns = [pa.array(shard, pa.int64()), pa.array(first, pa.int32()), *[pa.array([b] * len(shard), pa.binary()) for b in blobs]]
        del pairs, terms, local, counts, indices, data, within
        give_back()
        return pa.table(columns, [f.split()[0] for f in _CSR.split(", ")])

    return rows.groupBy("shard").cogroup(numbers.groupBy("of_shard")).applyInArrow(encode, _CSR)


def row_counts(shards: DataFrame) -> DataFrame:
    """shard, place, ``n_words`` (the row's sum) and ``n_distinct`` (its entries) of every row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, indptr, data in zip(*(batch.column(k) for k in (0, 1, 2, 3)), strict=True):
                ends = np.frombuffer(indptr.as_buffer(), np.int64)
                running = np.append(0, np.cumsum(np.frombuffer(data.as_buffer(), np.int32), dtype=np.int64))
                places = np.arange(first.as_py(), first.as_py() + len(ends) - 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), shard.as_py())), pa.array(places), pa.array(running[ends[1:]] - running[ends[:-1]]), pa.array(np.diff(ends))], ["shard", "place", "n_words", "n_distinct"])

    return shards.select("shard", "first", "indptr", "data").mapInArrow(run, "shard long, place int, n_words long, n_distinct long")


def document_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, n_words, n_distinct and ``failed``, whose bit k says that the document fails filter k.

    A: fewer than 200 words; B: less than half of the words distinct; C: capitals A-Z above 2% of the
    code points; D: holds a symbol; E: has the text of a smaller doc_id.
    """
    local = staged(_local_terms(docs))
    rows = local.where("words is null").select("shard", "place", "doc_id", "part", "others", "digest")
    copies = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # Written first, so that Spark can split a text with very many copies.
    firsts = staged(copies)
    counted = rows.join(row_counts(csr_shards(local, numbered_words(local))), ["shard", "place"]).join(firsts, F.col("digest") == F.col("_digest"), "left")
    tests = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT_PERCENT * F.col("n_words"),
        F.col("others").bitwiseAND(4) > 0,
        F.col("others").bitwiseAND(8) > 0,
        F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)),
    ]
    failed = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return counted.select("doc_id", "part", "n_words", "n_distinct", failed.cast("int").alias("failed"))


def _coefficients() -> dict[str, np.ndarray]:
    """For each order and step, which of the 32 sets of failed filters each figure counts."""
    failed = np.arange(32)
    orders = ["".join(p) for p in permutations(FILTERS)]
    shape = len(orders) * len(FILTERS), 32
    out = {name: np.zeros(shape, np.int64) for name in ("kept", "removed", "redundant", "unique_fails")}
    for n, order in enumerate(orders):
        earlier = 0
        for step, letter in enumerate(order):
            bit, row = 1 << FILTERS.index(letter), n * len(FILTERS) + step
            out["kept"][row] = failed & (earlier | bit) == 0
            out["removed"][row] = (failed & bit > 0) & (failed & earlier == 0)
            out["redundant"][row] = (failed & bit > 0) & (failed & earlier > 0)
            out["unique_fails"][row] = failed == bit
            earlier |= bit
    letters = np.array([letter for order in orders for letter in order])
    out["shapley"] = np.stack([out["removed"][letters == letter].sum(axis=0) for letter in letters])
    return out


_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, for every source.

    ``part`` is the source, null and '' together. A null text is empty: it has no words and fails A
    only, or E too. A null doc_id is neither smaller nor larger than another; repeated rows of one id
    are documents each and no copies of each other. Of several labels of an id one that says 1
    counts; a null id has no label. A source has all 600 rows; an empty table gives none. Only doc_id,
    source and text are read.
    """
    failures = document_failures(docs)
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = failures.join(good, F.col("doc_id") == F.col("_id"), "left").fillna({"good": 0, "toxic": 0})
    sets = labelled.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    of_set = [[F.sum(F.when(F.col("failed") == k, F.col(c)).otherwise(0)).cast("long") for k in range(32)] for c in ("n", "good", "toxic")]
    parts = sets.groupBy("part").agg(*[F.array(*sums).alias(c) for c, sums in zip(("n", "good", "toxic"), of_set, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = _coefficients()
        orders = np.repeat(["".join(p) for p in permutations(FILTERS)], len(FILTERS))
        steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders) // len(FILTERS))
        for batch in batches:
            for part, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, good, toxic = (np.array(c, np.int64) for c in counts)
                found = {name: figures[name] @ n for name in figures} | {"good_lost": figures["removed"] @ good, "toxic_lost": figures["removed"] @ toxic}
                columns = [pa.array([part] * len(orders)), pa.array(orders.tolist()), pa.array(steps), *[pa.array(found[f]) for f in _FIGURES]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *_FIGURES])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in _FIGURES))
