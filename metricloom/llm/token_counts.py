"""Token counts of a unigram tokenizer without making its pieces (operator 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from metricloom.llm.support import as_bytes

MARK = "▁"
# What an unknown character costs beyond the worst piece; fixed in unigram tokenizers.
UNKNOWN_PENALTY = 10.0
# Distinct words whose counts a worker remembers.
REMEMBERED = 250_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a public piece vocabulary in its order, with Zipf's log probabilities.

    Nothing is trained: the score of a piece follows from its rank alone.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(ids))))
    return [(model.id_to_piece(i), -math.log(rank + 1) - total) for rank, i in enumerate(ids)]


class PieceCounter:
    """Pieces in the best segmentation of a word, by one pass of an automaton and of Viterbi's rule.

    The automaton gives the vocabulary pieces that end at each character, longest first. A later
    candidate replaces a better or equal one only if its score is strictly greater, which is the
    order and the tie rule of the tokenizer. A character that is no piece itself is also reachable as
    unknown; neighbouring unknown characters are one piece.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.remembered: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Piece count of the best path; only scores and counts are carried along."""
        n = len(word)
        best = [0.0] + [-math.inf] * n
        pieces = [0] * (n + 1)
        if self.single.issuperset(word):
            for end, (length, score) in self.automaton.iter(word):
                end += 1
                total = score + best[end - length]
                if total > best[end]:
                    best[end] = total
                    pieces[end] = pieces[end - length] + 1
            return pieces[n]
        unknown = [False] * (n + 1)
        matches = self.automaton.iter(word)
        last, (length, score) = next(matches, (n, (0, 0.0)))
        for end in range(1, n + 1):
            while last + 1 == end:
                total = score + best[end - length]
                if total > best[end]:
                    best[end] = total
                    pieces[end] = pieces[end - length] + 1
                last, (length, score) = next(matches, (n, (0, 0.0)))
            if word[end - 1] not in self.single:
                total = self.unknown + best[end - 1]
                if total > best[end]:
                    best[end], unknown[end] = total, True
                    pieces[end] = pieces[end - 1] + (not unknown[end - 1])
        return pieces[n]

    def word(self, word: str) -> int:
        known = self.remembered.get(word)
        if known is None:
            known = self.viterbi(word)
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            if len(word) <= 64:
                self.remembered[word] = known
        return known

    def text(self, text: str) -> int:
        """Spaces are marks, the text begins with one, and each mark begins a word."""
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        words = [MARK + word for word in text.removeprefix(" ").split(" ")]
        known = list(map(self.remembered.get, words))
        if None in known:
            return sum(n or self.word(word) for n, word in zip(known, words, strict=True))
        return sum(known)


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(unigram_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Tokens, characters and bytes of every whole text under a unigram vocabulary.

    A null or empty text has none; repeated rows are counted each; an empty table gives no rows.
    Memory is bounded by the longest word. Only doc_id and text are read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                text = raw.decode("utf-8", "replace")
                rows.append((counter.text(text), len(text), len(raw)))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "n_chars", "n_bytes"])

    return docs.select("doc_id", as_bytes("text")).mapInArrow(counted, "doc_id long, n_tokens long, n_chars long, n_bytes long")
