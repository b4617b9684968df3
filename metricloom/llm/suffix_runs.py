"""Sorted runs of equally long strings: front coding, and merging without comparing known prefixes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np


class Run:
    """A sorted run. ``common`` is the prefix each string shares with the one before, ``tails`` the rest.

    ``owners`` and ``places`` say where a string is from; ``extra`` is what comes with each.
    """

    def __init__(self, common: np.ndarray, tails: bytes, owners: np.ndarray, places: np.ndarray, length: int, extra: Sequence[object]) -> None:
        self.common, self.tails, self.owners, self.places, self.length, self.extra = common, tails, owners, places, length, extra

    def __iter__(self) -> Iterator[list]:
        """Heads of a merge: prefix shared with the string before, string, owner, place, extra."""
        string, at = b"", 0
        for common, owner, place, extra in zip(self.common.tolist(), self.owners.tolist(), self.places.tolist(), self.extra, strict=True):
            end = at + self.length - common
            string = string[:common] + self.tails[at:end]
            at = end
            yield [common, string, owner, place, extra, 0]


def sorted_run(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings (rows of a byte matrix) and the prefix each shares with the one before.

    Equal strings keep their order, which should be that of owner and place.
    """
    length = strings.shape[1]
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{length}").ravel(), kind="stable")
    rows = strings[order]
    common = np.zeros(len(rows), np.int64)
    differs = rows[1:] != rows[:-1]
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    return order, common


def cut_run(strings: np.ndarray, order: np.ndarray, common: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """The parts of a run between ``borders`` (byte strings): number, order, common prefixes, tails."""
    length = strings.shape[1]
    rows = strings[order]
    keys = np.ascontiguousarray(rows).view(f"S{length}").ravel()
    edges = [0, *np.searchsorted(keys, borders, "left").tolist(), len(order)]
    for part, (start, end) in enumerate(itertools.pairwise(edges)):
        if start == end:
            continue
        shared = common[start:end].copy()
        shared[0] = 0
        tails = rows[start:end][np.arange(length) >= shared[:, None]]
        yield part, order[start:end], shared, tails.tobytes()


def merge(runs: list[Run]) -> Iterator[list]:
    """The heads of all runs in order, each with the prefix that it shares with the one before.

    A loser tree over the heads of the runs. Each head knows the prefix that it shares with the last
    winner: of two heads the one that shares more is smaller, and only heads that share equally much
    are compared, from there on; the loser then remembers what it shares with the winner. Equal
    strings come in order of owner and place.
    """
    width = 1
    while width < len(runs):
        width *= 2
    sources = [iter(run) for run in runs]
    length = runs[0].length if runs else 0
    ended = [-1, b"", 0, 0, None, 0]  # an ended run shares less than any other

    def head(source: int) -> list:
        found = next(sources[source], ended)
        if found is not ended:
            found[5] = source
        return found

    def smaller(a: list, b: list) -> tuple[list, list]:
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        shared = a[0]
        if shared < 0:
            return a, b
        x, y = a[1], b[1]
        while shared < length and x[shared] == y[shared]:
            shared += 1
        if shared == length:
            first = a[2:4] <= b[2:4]
        else:
            first = x[shared] < y[shared]
        winner, loser = (a, b) if first else (b, a)
        loser[0] = shared
        return winner, loser

    losers: list[list] = [ended] * width
    level = [head(i) if i < len(runs) else ended for i in range(width)]
    at = width
    while len(level) > 1:
        at //= 2
        above = []
        for i in range(0, len(level), 2):
            winner, losers[at + i // 2] = smaller(level[i], level[i + 1])
            above.append(winner)
        level = above
    winner = level[0] if level else ended
    while winner[0] >= 0:
        yield winner
        source = winner[5]
        winner = head(source)
        at = (width + source) // 2
        while at:
            winner, losers[at] = smaller(winner, losers[at])
            at //= 2
