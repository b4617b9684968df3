"""Context-tree weighting over binary-decomposed bytes, on sorted arrays of grams.

A gram is a 64-bit number: the byte before, the one before that, and so on to ``depth`` bytes, then
the byte itself; so all grams of a context are neighbours. Each byte is eight binary decisions; a
decision is known by the bits before it, and has a tree of contexts of its own. The estimate of a
node is Krichevsky and Trofimov's, and its weighted probability is half its own and half the product
of its children's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Ends every text and stands before its first byte; it is in no UTF-8 text.
END = 0xFF


def grams(data: np.ndarray, edges: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of each text of concatenated texts and of its end, and the offsets between the texts."""
    lengths = np.diff(edges)
    places = edges + np.arange(len(edges))
    ended = np.full(places[-1], END, np.uint64)
    inside = np.ones(len(ended), bool)
    inside[places[1:] - 1] = False
    ended[inside] = data
    start = np.repeat(places[:-1], lengths + 1)
    index = np.arange(len(ended))
    out = ended.copy()
    for back in range(1, depth + 1):
        before = np.full(len(ended), END, np.uint64)
        before[back:] = ended[:-back]
        before[index - back < start] = END
        out |= before << np.uint64(8 * (depth + 1 - back))
    return out, places


_EXACT = 1 << 12
_INT = np.concatenate([[0.0, 0.0], np.cumsum(np.log(np.arange(1, _EXACT)))])  # log gamma(n)
_HALF = 0.5 * np.log(np.pi) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(_EXACT) + 0.5))])  # log gamma(n + 1/2)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of at least about 4000."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of Krichevsky and Trofimov for a sequence with these counts."""

    def half(n: np.ndarray) -> np.ndarray:
        return np.where(n < _EXACT, _HALF[np.minimum(n, _EXACT - 1)], _log_gamma(np.maximum(n, 1) + 0.5))

    def whole(n: np.ndarray) -> np.ndarray:  # log gamma(n + 1)
        return np.where(n + 1 < _EXACT, _INT[np.minimum(n + 1, _EXACT - 1)], _log_gamma(np.maximum(n, 1) + 1.0))

    return half(zeros) + half(ones) - whole(zeros + ones) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one depth and one bit level: sorted keys, counts, and the share of the node's own estimate."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    own: np.ndarray


def _collapse(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams without their farthest context byte, with summed counts, sorted."""
    shorter = ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(0xFF))
    found, inverse = np.unique(shorter, return_inverse=True)
    return found, np.bincount(inverse, counts, len(found)).astype(np.int64)


def _nodes(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node = keys >> np.uint64(8 - bit)
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]
    at = np.flatnonzero(new)
    ones = np.add.reduceat(np.where((keys >> np.uint64(7 - bit)) & np.uint64(1), counts, 0), at)
    return node[at], np.add.reduceat(counts, at) - ones, ones


def weigh(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the share of their own estimate in predictions."""
    own = log_kt(zeros, ones)
    if children is None:
        return own, np.ones(len(own))
    with np.errstate(over="ignore"):
        return np.logaddexp(own, children) - np.log(2), 1 / (1 + np.exp(children - own))


class Subtrees:
    """All nodes of depths ``top`` to ``depth`` for grams that hold whole contexts of length ``top``."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        self.keys, self.depth, self.top = keys, depth, top
        tables = {depth: (keys, counts)}
        for d in range(depth - 1, top - 1, -1):
            tables[d] = _collapse(*tables[d + 1])
        self.levels: dict[int, list[Level]] = {}
        for d in range(depth, top - 1, -1):
            self.levels[d] = []
            for bit in range(8):
                nodes, zeros, ones = _nodes(*tables[d], bit)
                below = None
                if d < depth:
                    child = self.levels[d + 1][bit]
                    low = np.uint64((1 << bit) - 1)
                    parent = ((child.keys >> np.uint64(bit + 8)) << np.uint64(bit)) | (child.keys & low)
                    below = np.bincount(np.searchsorted(nodes, parent), child.weighted, len(nodes))
                self.levels[d].append(Level(nodes, zeros, ones, *weigh(zeros, ones, below)))

    def predictions(self, bit: int) -> np.ndarray:
        """Probability of the bit that each gram has here, mixed over the depths of the subtrees."""
        value = (self.keys >> np.uint64(7 - bit)) & np.uint64(1)
        mixed = None
        for d in range(self.depth, self.top - 1, -1):
            level = self.levels[d][bit]
            drop = np.uint64(8 * (self.depth - d))
            byte = self.keys & np.uint64(0xFF)
            node = ((((self.keys >> np.uint64(8)) >> drop) << np.uint64(8)) | byte) >> np.uint64(8 - bit)
            at = np.searchsorted(level.keys, node)
            right = np.where(value, level.ones[at], level.zeros[at])
            own = (right + 0.5) / (level.zeros[at] + level.ones[at] + 1)
            mixed = own if mixed is None else level.own[at] * own + (1 - level.own[at]) * mixed
        return mixed
