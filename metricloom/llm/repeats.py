"""Exact removal of repeated byte strings by a distributed sort of suffixes (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.suffix_runs import Run, cut_run, merge, sorted_run
from metricloom.llm.support import SLICE_BYTES, RangeHash, as_bytes, byte_slices, frugal, give_back, mix, partitions, staged

# Suffixes of one sorted run: with 100 bytes before and after each anchor, about 20 MB in a task.
RUN = 100_000
# Suffixes of one part of the merge, about; the number of parts follows from it.
PART = 100_000
# Strings for each part from which the borders between the parts are taken; they only balance it.
BORDER_SAMPLE = 300
# One text of so many is looked at for grams with many surroundings: so many in the sample are many.
HOT_SAMPLE = 64
HOT = 64


def _span(least: int) -> tuple[int, int]:
    """Grams in a window, a power of two, and the bytes of a gram."""
    if not 0 < least < 1 << 15:
        raise ValueError("windows of 1 to 32767 bytes")
    span = 1 << max(0, (least - 1).bit_length() - 1)
    return span, least - span + 1


def _anchors(data: np.ndarray, edges: np.ndarray, least: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of ``least`` bytes, in runs that share an anchor: text, first, count, anchor, two hashes.

    The anchor of a window is its leftmost smallest gram, so equal windows have it at the same
    place. ``gram`` is its hash; ``around`` that of all bytes of the run's windows. Windows whose gram
    is in ``hot`` are on their own: they are their own anchor and gram, and their count is 0.
    """
    span, gram = _span(least)
    n = len(data)
    nothing = tuple(np.zeros(0, t) for t in (*[np.int64] * 4, np.uint64, np.uint64))
    if n < least:
        return nothing
    hashes = RangeHash(data, 0)
    starts = np.arange(n - gram + 1)
    value = hashes(starts, starts + gram)
    place = starts.astype(np.int64)
    step = 1
    while step < span:
        left, right = value[: len(value) - step], value[step:]
        take = left <= right
        value = np.where(take, left, right)
        place = np.where(take, place[: len(place) - step], place[step:])
        step *= 2
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(place)]
    whole = np.arange(len(place)) + least <= edges[1:][text]
    windows = np.flatnonzero(whole)
    if not len(windows):
        return nothing
    anchor = place[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[windows[1:]] != text[windows[:-1]])
    first = windows[new]
    count = np.diff(np.append(np.flatnonzero(new), len(windows)))
    at = anchor[new]
    key = hashes(at, at + gram)
    end = first + count - 1 + least
    apart = np.isin(key, hot)
    if apart.any():
        many = count[apart]
        single = np.repeat(first[apart] - np.cumsum(many) + many, many) + np.arange(many.sum())
        first, at, end = (np.append(x[~apart], y) for x, y in ((first, single), (at, single), (end, single + least)))
        count = np.append(count[~apart], np.zeros(len(single), np.int64))
        key = np.append(key[~apart], hashes(single, single + least))
    around = RangeHash(data, 1)(first, end)
    owner = text[first]
    return owner, first - edges[owner], count, at - edges[owner], key, mix(around + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _pieces(data: np.ndarray, edges: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A slice as it is; a longer text in pieces that share ``least`` - 1 bytes, so each window is in one of them."""
    if len(edges) > 2 or len(data) <= SLICE_BYTES:
        yield data, edges, 0
        return
    for at in range(0, len(data) - least + 1, SLICE_BYTES):
        piece = data[at : at + SLICE_BYTES + least - 1]
        yield piece, np.array([0, len(piece)]), at


def _same_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether the windows at ``a`` and ``b`` have equal bytes."""
    if not len(a):
        return np.zeros(0, bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, least)
    return np.concatenate([(windows[a[i : i + 50_000]] == windows[b[i : i + 50_000]]).all(axis=1) for i in range(0, len(a), 50_000)])


# ``place`` has the first window and, below 32 bits, the bytes from there to the anchor, the number of
# windows (0 for a window on its own) and a 0; or, if the run is decided, the number of windows and a 1.
_RECORD = "gram long, around long, row long, place long"
_SPANS = "row long, first int, count int, anchor int, decided boolean"


def _records(rows: DataFrame, least: int, hot: np.ndarray) -> DataFrame:
    """Anchor runs of all texts. Copies of a run in one batch are decided at once: all but the first go.

    Copies of a window on its own are compared by their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, bytes_of, total = [], [], 0
            for rows, data, edges in byte_slices(batch):
                for piece, ends, at in _pieces(data, edges, least):
                    owner, first, count, anchor, gram, around = _anchors(piece, ends, least, hot)
                    parts.append((gram, around, rows.column(0).to_numpy()[owner], first + at, count, anchor + at, total + ends[owner] + first + at))
                bytes_of.append(data)
                total += len(data)
            gram, around, row, first, count, anchor, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = first << 32 | (anchor - first) << 16 | count << 1
            order = np.lexsort((place, row, around, gram))  # a batch need not be in order
            g, a = gram[order], around[order]
            again = np.zeros(len(gram), bool)
            again[order[1:]] = (g[1:] == g[:-1]) & (a[1:] == a[:-1])
            if len(hot):
                head = np.empty(len(gram), np.int64)
                head[order] = order[np.maximum.accumulate(np.where(again[order], 0, np.arange(len(order))))]
                alone = np.flatnonzero(again & (count == 0))
                again[alone] = _same_windows(np.concatenate(bytes_of), start[alone], start[head[alone]], least)
                count = np.where(again, np.maximum(count, 1), count)
            # Decided runs that follow each other are one; it meets no other and is dealt by its place.
            done = np.flatnonzero(again)
            follows = np.zeros(len(done), bool)
            follows[1:] = (row[done][1:] == row[done][:-1]) & (first[done][1:] == (first + count)[done][:-1])
            heads = np.flatnonzero(~follows)
            sums = np.add.reduceat(count[done], heads) if len(done) else count[done]
            row, first, some = np.append(row[~again], row[done][heads]), first[done][heads], len(gram) - len(done)
            place = np.append(place[~again], first << 32 | sums << 1 | 1)
            gram = np.append(gram[~again], mix(row[some:].astype(np.uint64) + first.astype(np.uint64)))
            around = np.append(around[~again], np.zeros(len(heads), np.uint64))
            for at in range(0, len(gram), 20_000):
                cut = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut].view(np.int64)) for x in (gram, around, row, place)], [f.split()[0] for f in _RECORD.split(", ")])

    return rows.select("row", "text").mapInArrow(frugal(run), _RECORD)


def _hot_grams(rows: DataFrame, least: int) -> np.ndarray:
    """Hashes of the grams that stand in many different surroundings, from a sample of the texts.

    All runs of a gram meet in one task, so these are taken apart into windows. The sample grows with
    the table: what it overlooks stands in about HOT * HOT_SAMPLE surroundings, or in few texts.
    """
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(HOT_SAMPLE)) == 0)
    runs = _records(some, least, np.zeros(0, np.uint64)).where("place & 1 = 0").select("gram", "around").distinct()
    found = runs.groupBy("gram").count().where(F.col("count") >= HOT).select("gram").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _resolved(records: DataFrame) -> DataFrame:
    """Runs that are copies of an earlier one (decided), and those that share an anchor with a different one.

    Windows on their own that are met again are never decided here: their bytes are compared later.
    """
    ordered = records.repartition(partitions(records.sparkSession), "gram").sortWithinPartitions("gram", "around", "row", "place")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the first run of the last gram, until another one is seen
        last_gram = last_around = None
        for batch in batches:
            gram, around, row, place = (c.to_numpy() for c in batch.columns)
            decided = place & 1 == 1
            first = place >> 32
            out = [[row[decided], first[decided], place[decided] >> 1 & 0x7FFFFFFF, first[decided]]]
            flags = [np.ones(int(decided.sum()), bool)]
            gram, around, row, place, first = (x[~decided] for x in (gram, around, row, place, first))
            rest = [row, first, place >> 1 & 0x7FFF, first + (place >> 16 & 0xFFFF)]
            if len(gram):
                same_gram = np.empty(len(gram), bool)
                same_gram[1:] = gram[1:] == gram[:-1]
                same_gram[0] = last_gram is not None and gram[0] == last_gram
                copy = same_gram.copy()
                copy[1:] &= around[1:] == around[:-1]
                copy[0] = same_gram[0] and around[0] == last_around
                copy &= rest[2] > 0
                out.append([c[copy] for c in rest])
                flags.append(np.ones(int(copy.sum()), bool))
                other = same_gram & ~copy  # not the first reading of its gram
                group = np.cumsum(~same_gram)
                mixed = np.bincount(group[other], minlength=group[-1] + 1) > 0
                opened = ~same_gram & mixed[group]
                chosen = other | opened
                out.append([c[chosen] for c in rest])
                flags.append(np.zeros(int(chosen.sum()), bool))
                if held is not None and mixed[0]:
                    out.append(held)
                    flags.append(np.zeros(1, bool))
                    held = None
                if group[-1] > 0:
                    held = None
                    start = int(np.flatnonzero(~same_gram)[-1])
                    if not mixed[group[-1]]:
                        held = [c[start : start + 1].copy() for c in rest]
                last_gram, last_around = gram[-1], around[-1]
            row, *found = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(x.astype(np.int32)) for x in found), pa.array(np.concatenate(flags))], ["row", "first", "count", "anchor", "decided"])

    return ordered.mapInArrow(frugal(resolve), _SPANS)


def _borders(rows: DataFrame, unsure: DataFrame, least: int, span: int, parts: int, total: int) -> np.ndarray:
    """Strings that cut the order of the suffixes into ``parts`` of about equal size, never between equal grams."""
    gram = least - span + 1
    some = unsure.sample(min(1.0, BORDER_SAMPLE * parts / max(1, total)), 7).select("row", "anchor")
    strings = rows.join(F.broadcast(some), "row").select(F.expr(f"substring(text, anchor + 1, {gram})").alias("s"))
    strings = sorted(strings.toArrow().column(0).to_pylist())
    chosen = [strings[len(strings) * k // parts] for k in range(1, parts)] if strings else []
    return np.array(sorted(set(chosen)), f"S{least}")


_BLOCK = "part int, common binary, tails binary, owners binary, anchors binary, lefts binary, firsts binary, counts binary"


def _runs(texts: DataFrame, least: int, borders: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Front-coded parts of sorted runs of the suffixes at anchors, with the bytes before each.

    ``texts`` has row, text and the window runs ``firsts``, ``counts`` and ``anchors``. The parts of
    windows on their own, which have the second borders, are numbered after the others.
    """
    befores = _span(least)[0] - 1, 0
    kinds = [pa.int32()] + [pa.binary()] * 7
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def sorted_parts(apart: int, rights: list, lefts: list, facts: list) -> pa.RecordBatch:
        before = befores[apart]
        matrix = np.frombuffer(b"".join(rights), np.uint8).reshape(-1, least)
        left = np.frombuffer(b"".join(lefts), np.uint8).reshape(-1, before) if before else np.zeros((len(matrix), 0), np.uint8)
        owner, anchor, first, count = np.array(facts, np.int64).reshape(-1, 4).T
        ordered = np.lexsort((anchor, owner))
        matrix, left, owner, anchor, first, count = (x[ordered] for x in (matrix, left, owner, anchor, first, count))
        order, common = sorted_run(matrix)
        out = []
        for part, mine, shared, tails in cut_run(matrix, order, common, borders[apart]):
            wide = (x[mine].astype(np.int32).tobytes() for x in (first, count))
            out.append([part + apart * (len(borders[0]) + 1), shared.astype(np.uint32).tobytes(), tails, owner[mine].tobytes(), anchor[mine].astype(np.int32).tobytes(), left[mine].tobytes(), *wide])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
        for batch in batches:
            for row, text, *runs in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                # Past its ends a text goes on with zeros, which no window of it reaches.
                raw = bytes(befores[0]) + text.as_buffer().to_pybytes() + bytes(least)
                for first, count, anchor in zip(*runs, strict=True):
                    apart = int(count == 0)
                    rights, lefts, facts = held[apart]
                    at = anchor + befores[0]
                    lefts.append(raw[at - befores[apart] : at])
                    rights.append(raw[at : at + least])
                    facts.append((row, anchor, first, max(1, count)))
                    if len(facts) >= RUN:
                        yield sorted_parts(apart, rights, lefts, facts)
                        held[apart] = [], [], []
        for apart, lists in enumerate(held):
            if lists[0]:
                yield sorted_parts(apart, *lists)

    return texts.mapInArrow(frugal(run), _BLOCK)


def _ones(mask: int) -> Iterator[tuple[int, int]]:
    """Stretches of set bits of a number: lowest and highest of each."""
    while mask:
        low = (mask & -mask).bit_length() - 1
        size = ((mask >> low) + 1 & ~(mask >> low)).bit_length() - 1
        yield low, low + size - 1
        mask &= ~(((1 << size) - 1) << low)


def _group_repeats(group: list[list], least: int, before: int) -> Iterator[tuple[int, int, int]]:
    """Owner, first and count of the windows of a group that an earlier member of it has too.

    ``group`` is a stretch of the suffix order with all suffixes that begin with one gram. The window
    that starts ``back`` bytes before its anchor is that of another member if both agree on so many
    bytes before the anchor and on the other ``least - back`` from it, which the common prefixes tell.
    """
    if len(group) == 2:
        # The common case, without a table: one stretch of windows.
        (_, _, owner_a, anchor_a, (left_a, first_a, count_a), _), (common, _, owner_b, anchor_b, (left_b, first_b, count_b), _) = group
        same = 0
        while same < before and left_a[before - 1 - same] == left_b[before - 1 - same]:
            same += 1
        least_back = max(least - common, anchor_a - first_a - count_a + 1, anchor_b - first_b - count_b + 1)
        most_back = min(same, anchor_a - first_a, anchor_b - first_b)
        if least_back <= most_back:
            owner, anchor = max((owner_a, anchor_a), (owner_b, anchor_b))
            yield owner, anchor - most_back, most_back - least_back + 1
        return
    repeats = [0] * len(group)
    for back in range(before + 1):
        seen: dict[tuple[int, bytes], int] = {}
        depth = 0
        for k, (common, _, owner, anchor, (left, first, count), _) in enumerate(group):
            if common < least - back:
                depth += 1
            if not first <= anchor - back < first + count:
                continue
            key = (depth, left[before - back :])
            other = seen.setdefault(key, k)
            if other != k:
                if (group[other][2], group[other][3]) > (owner, anchor):
                    seen[key], other = k, other
                    repeats[other] |= 1 << back
                else:
                    repeats[k] |= 1 << back
    for mask, (_, _, owner, anchor, _, _) in zip(repeats, group, strict=True):
        for low, high in _ones(mask):
            yield owner, anchor - high, high - low + 1


def _merged(blocks: DataFrame, least: int, parts: int, apart: int) -> DataFrame:
    """Spans of windows that an earlier anchor has too, from the merged runs of each part.

    Parts from number ``apart`` on have windows on their own.
    """

    def join(table: pa.Table) -> pa.Table:
        span = 1 if table.column(0)[0].as_py() >= apart else _span(least)[0]
        before, gram = span - 1, least - span + 1
        runs = []
        for common, tails, owners, anchors, lefts, firsts, counts in zip(*(table.column(i).to_pylist() for i in range(1, 8)), strict=True):
            first, count = np.frombuffer(firsts, np.int32).tolist(), np.frombuffer(counts, np.int32).tolist()
            extra = [(lefts[k * before : (k + 1) * before], f, c) for k, (f, c) in enumerate(zip(first, count, strict=True))]
            runs.append(Run(np.frombuffer(common, np.uint32), tails, np.frombuffer(owners, np.int64), np.frombuffer(anchors, np.int32), least, extra))
        found: list[tuple[int, int, int]] = []
        group: list[list] = []
        for member in merge(runs):
            if member[0] < gram and group:
                found += _group_repeats(group, least, before) if len(group) > 1 else ()
                group = []
            # A head changes when it has lost again, so the group keeps a copy.
            group.append(member.copy())
        if len(group) > 1:
            found += _group_repeats(group, least, before)
        row, first, count = np.array(found, np.int64).reshape(-1, 3).T
        del runs, group, found
        give_back()
        return pa.table([pa.array(row.copy()), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["row", "first", "count"])

    return blocks.repartition(parts, "part").groupBy("part").applyInArrow(join, "row long, first int, count int")


def repeated_spans(rows: DataFrame, least: int = 100) -> DataFrame:
    """row, firsts and counts of the windows of ``least`` bytes that occur earlier in ``rows``.

    ``rows`` is a written table of row (unique, in order of precedence) and text (binary). Windows
    are first met by the fingerprint of an anchor that equal windows must share: an anchor that is
    met once has no repeats, and runs of windows whose bytes are all equal are decided together. The
    others are sorted by the suffixes at their anchors: sorted runs are front-coded, dealt out by
    range and merged, and the common prefixes in the merged order, with the bytes before the
    anchors, tell which windows are repeats. Grams with very many surroundings would meet in one task:
    their windows are met one by one, by the fingerprint of the whole window, and those that are met
    again are sorted by their bytes.
    """
    found = staged(_resolved(_records(rows, least, _hot_grams(rows, least))))
    unsure = found.where("not decided")
    borders, parts = [], 0
    for span, kind in ((_span(least)[0], "count > 0"), (1, "count = 0")):
        some = unsure.where(kind)
        total = some.count()
        wanted = max(partitions(rows.sparkSession), -(-total // PART))
        borders.append(_borders(rows, some, least, span, wanted, total))
        parts += len(borders[-1]) + 1
    runs = unsure.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "count", "anchor"))).alias("runs"))
    texts = rows.join(runs, "row").select("row", "text", "runs.first", "runs.count", "runs.anchor")
    spans = found.where("decided").select("row", "first", "count").unionByName(_merged(_runs(texts, least, tuple(borders)), least, parts, len(borders[0]) + 1))
    return staged(spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "count"))).alias("runs")).select("row", F.col("runs.first").alias("firsts"), F.col("runs.count").alias("counts")))


def in_order(docs: DataFrame, *columns) -> DataFrame:
    """``docs`` written in order of doc_id, with ``row`` counting in that order and the text as bytes."""
    return staged(
        docs.select("doc_id", as_bytes("text"), *columns)
        .repartitionByRange(partitions(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id")
        .withColumn("row", F.monotonically_increasing_id())
    )


def removed_bytes(firsts: list[int], counts: list[int], least: int) -> list[list[int]]:
    """Maximal runs of covered bytes, half-open, from sorted window runs."""
    merged: list[list[int]] = []
    for first, count in zip(firsts, counts, strict=True):
        end = first + count - 1 + least
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([first, end])
    return merged


def without(text: bytes, runs: list[list[int]]) -> bytes:
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def repeat_report(docs: DataFrame, least: int = 100) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what stays, for every document.

    Order is that of doc_id, null first; repeated ids follow each other as different documents. A
    null or empty text has no bytes; texts shorter than ``least`` lose nothing; an empty table gives
    no rows. Only doc_id and text are read.
    """
    rows = in_order(docs)
    spans = repeated_spans(rows.select("row", "text"), least)
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "firsts", "counts")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, firsts, counts in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs = removed_bytes(firsts, counts, least) if firsts else []
                out.append((len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(raw, runs)).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            columns = [pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(frugal(report), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(text: bytes, runs: list[list[int]]) -> list[list[int]]:
    """Runs narrowed to whole UTF-8 characters, so that what stays is valid text."""
    narrowed = []
    for start, end in runs:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while start < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            narrowed.append([start, end])
    return narrowed


def without_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """``docs`` without the text that occurs earlier; the columns are those of ``docs``.

    Only whole characters are removed. n_chars, if there, follows the text.
    """
    rows = in_order(docs, F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("__none")).alias("__rest"))
    spans = repeated_spans(rows.select("row", "text"), least)
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "firsts", "counts", "__rest")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, firsts, counts in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                texts.append(raw if not firsts else without(raw, whole_characters(raw, removed_bytes(firsts, counts, least))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(4)], ["doc_id", "text", "__rest"])

    from pyspark.sql import types as T

    schema = T.StructType([joined.schema["doc_id"], T.StructField("text", T.BinaryType()), joined.schema["__rest"]])
    out = joined.mapInArrow(frugal(clean), schema).withColumn("text", F.col("text").cast("string"))
    rest = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("text" if c == "text" else "doc_id" if c == "doc_id" else f"__rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*rest)
