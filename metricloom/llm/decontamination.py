"""Benchmark passages in documents, found with a generalised suffix automaton (operator 7)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.licenses import NORMAL
from metricloom.llm.support import as_bytes, frugal, staged

# Words of benchmark items in one automaton; more items take more passes over the documents.
BLOCK_WORDS = 200_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class ItemAutomaton:
    """Suffix automaton of word sequences that tells which windows of which items end at a word.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole. Items are
    separated by numbers that no word has, so no match runs over an item's end.
    """

    def __init__(self, items: Sequence[tuple[str | None, bytes]], window: int) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        sequences = [(key, [self.numbers.setdefault(w, len(self.numbers)) for w in text.split()]) for key, text in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last, separator = 0, -2
        for _, sequence in sequences:
            for number in [*sequence, separator]:
                last = self._extend(last, number)
            separator -= 1
        # For each state, the items of which a window is the state's suffix of the right length.
        self.windows: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        for key, sequence in sequences:
            for state, length in self._states(sequence):
                if length >= window:
                    self.windows.setdefault(self._at_least(state, window), set()).add(key)
            if 0 < len(sequence) < window:
                state, _ = list(self._states(sequence))[-1]
                self.short.setdefault(self._at_least(state, len(sequence)), []).append((len(sequence), key))
        # The nearest state on the way to the root that ends a short item, itself included.
        self.marked = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.short else self.marked[self.link[state]]
        self.least = min([window, *(n for found in self.short.values() for n, _ in found)])

    def _extend(self, last: int, number: int) -> int:
        new = self._add({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and number not in self.next[at]:
            self.next[at][number] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][number]
            if self.length[at] + 1 == self.length[target]:
                self.link[new] = target
            else:
                copy = self._add(dict(self.next[target]), self.link[target], self.length[at] + 1)
                while at >= 0 and self.next[at].get(number) == target:
                    self.next[at][number] = copy
                    at = self.link[at]
                self.link[target] = self.link[new] = copy
        return new

    def _add(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _at_least(self, state: int, length: int) -> int:
        """The state on the way to the root that holds the suffix of just this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _states(self, numbers: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = length = 0
        for number in numbers:
            while state and number not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if number in self.next[state]:
                state, length = self.next[state][number], length + 1
            yield state, length

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans inside windows, and the items they come from.

        Only runs of item words at least as long as the shortest window are streamed.
        """
        known = np.fromiter((self.numbers.get(w, -1) for w in words), np.int32, len(words))
        inside = np.concatenate([[False], known >= 0, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        spans: list[tuple[int, int]] = []
        items: set = set()
        for start, end in turns.reshape(-1, 2):
            if end - start < self.least:
                continue
            numbers = known[start:end].tolist()
            for at, (state, length) in enumerate(self._states(numbers), int(start) + 1):
                reach = 0
                if length >= self.window:
                    reach = self.window
                    items |= self.windows[self._at_least(state, self.window)]
                marked = self.marked[state]
                while marked > 0:
                    for n, key in self.short[marked]:
                        if n <= length:
                            reach = max(reach, n)
                            items.add(key)
                    marked = self.marked[self.link[marked]]
                if reach:
                    first = at - reach
                    while spans and first <= spans[-1][1]:
                        first = min(first, spans.pop()[0])
                    spans.append((first, at))
        return spans, items


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """Normalised items in blocks of bounded size, read from one partition after another."""
    items, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("key"), as_bytes("text")).where("text IS NOT NULL").toLocalIterator():
        text = bytes(row["text"]).translate(NORMAL)
        items.append((row["key"], text))
        words += text.count(b" ") + 1
        if words >= BLOCK_WORDS:
            yield items
            items, words = [], 0
    if items:
        yield items


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` as struct ``row``, with n_words, word ``spans`` inside item windows, and ``items``.

    Spans are half-open and merged; items are distinct ids as strings. Each block of items is one
    automaton of bounded size that goes to all tasks; with several blocks the hits of one are written
    before the next. Null and empty texts have no words; an item of no words has no window; a null
    item id hits, but is not listed; repeated items count once; empty tables give no rows or no hits.
    """
    frame = docs.select(F.struct(*docs.columns).alias("row"), as_bytes("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType(list(frame.schema.fields))
    span_type = pa.list_(pa.list_(pa.int64()))
    blocks = _blocks(benchmark)
    block = next(blocks, [])
    while True:
        automaton = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(block, window))

        def scan(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            known = automaton.value
            for batch in batches:
                counts, spans, items = [], [], []
                for text, old_spans, old_items in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    words = text.as_buffer().to_pybytes().translate(NORMAL).split() if text.is_valid else []
                    found, keys = known.find(words)
                    merged: list[list[int]] = []
                    for start, end in sorted([*map(tuple, old_spans), *found]):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([start, end])
                    counts.append(len(words))
                    spans.append(merged)
                    items.append(sorted({*old_items, *(k for k in keys if k is not None)}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))], batch.schema.names)

        frame = frame.mapInArrow(frugal(scan), schema)
        block = next(blocks, None)
        if block is None:
            return frame.drop("text")
        frame = staged(frame)


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Words, hit words and leaked items of every document."""
    hits = benchmark_hits(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.element_at(s, 2) - F.element_at(s, 1))
    return hits.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    places = [m.span() for m in WORD.finditer(text.translate(LOWERED))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


# Lower-cases A-Z and leaves all else.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_percent: int = 50) -> DataFrame:
    """Documents without the text from the first to the last word of each span of item windows.

    A document of which more than ``most_percent`` of the words are hit goes as a whole. Documents
    without a hit are left as they are. Where a cut brings the words of another window together, the
    document is cut again, until no document has a hit. The columns are those of ``docs``; n_chars, if
    there, follows the text. A null or empty text has no hit and stays as it is; texts of any length
    are searched whole; repeated rows are treated alike; an empty table gives no rows, and an empty
    benchmark all rows. A column named ``__spans`` is refused.
    """
    if "__spans" in docs.columns:
        raise ValueError("the column __spans is the operator's own")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.element_at(s, 2) - F.element_at(s, 1))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if not spans else _without(t.encode(), spans).decode() for t, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    def cut(hits: DataFrame) -> DataFrame:
        mostly_own = (n_hit > 0) & (100 * n_hit <= most_percent * F.col("n_words"))
        out = hits.where(mostly_own).select("row.*", F.col("spans").alias("__spans")).mapInArrow(frugal(clean), docs.schema)
        return staged(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out)

    def free_of_hits(hits: DataFrame) -> DataFrame:
        return hits.where(n_hit == 0).select("row.*")

    hits = benchmark_hits(docs, benchmark, window)
    # Documents without a hit are only read; each round writes those that it has cut, fewer every time.
    found, changed = free_of_hits(hits), cut(hits)
    while not changed.isEmpty():
        hits = benchmark_hits(changed, benchmark, window)
        found, changed = found.unionByName(free_of_hits(hits)), cut(hits)
    return found
