"""Token ids of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.support import FORGETS, as_bytes

# The pattern by which this family of byte-level vocabularies splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space other than the space and the line feed.
RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Distinct words whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64


def _byte_of() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    """Ids of texts. Strings of special tokens are ordinary text.

    A single space between two other characters always begins a new piece, so texts are cut there
    and the ids of each word behind a space are looked up; only new words, and texts with unusual
    white space, are encoded.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte_of = _byte_of()
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self.encoding = tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        # For what is one piece of the split already, such as a space and letters.
        self.piece_encoding = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        self.remembered: dict[str, bytes] = {}
        self.stops = {stop: self._ids(stop) for stop in ".,"}

    def _ids(self, text: str) -> bytes:
        return array(self.kind.char, self.encoding.encode_ordinary(text)).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word; letters are one piece, and a full stop or comma another."""
        stop = self.stops.get(word[-1:], b"")
        stem = word[:-1] if stop else word
        if stem.isalpha():
            ids = self.remembered.get(stem) if stop else None
            return (ids or array(self.kind.char, self.piece_encoding.encode_ordinary(" " + stem)).tobytes()) + stop
        return self._ids(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian numbers of the encoder's width."""
        if "  " in text or " \n" in text or "\n " in text or RARE_SPACE.search(text):
            return self._ids(text)
        first, *words = text.split(" ")
        known = list(map(self.remembered.get, words))
        at = -1
        try:
            while True:
                at = known.index(None, at + 1)
                word = words[at]
                known[at] = ids = self._word(word)
                if len(word) <= LONGEST:
                    if len(self.remembered) >= REMEMBERED:
                        self.remembered.clear()
                    self.remembered[word] = ids
        except ValueError:  # no further word is unknown
            return b"".join([self._ids(first), *known])


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


# The next operator's tasks in the same worker drop the vocabulary; tasks that encode keep it.
FORGETS.append(text_encoder.cache_clear)


def encoded(docs: DataFrame, path: str, keep: list[str], end_id: int = 0) -> DataFrame:
    """``keep``, n_tokens, ids (binary, little-endian) and the bytes of an id, for every document.

    Each text is followed by ``end_id``; a null text is empty and has that id alone.
    """
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            *columns, texts = batch.columns
            ids, size = [], 0
            done = 0
            for at, text in enumerate(texts):
                ids.append(encoder.encode(text.as_buffer().to_pybytes().decode("utf-8", "replace") if text.is_valid else "") + end)
                size += len(ids[-1])
                if size > 4 << 20 or at == len(texts) - 1:
                    count = pa.array([len(x) // encoder.kind.itemsize for x in ids], pa.int64())
                    width = pa.array([encoder.kind.itemsize] * len(ids), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(c.slice(done, len(ids)) for c in columns), count, pa.array(ids, pa.binary()), width], [*keep, "n_tokens", "ids", "id_bytes"])
                    done, ids, size = at + 1, [], 0

    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("id_bytes", T.IntegerType())])
    return docs.select(*keep, as_bytes("text")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
