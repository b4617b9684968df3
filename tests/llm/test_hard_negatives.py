import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import hard_negatives as module
from metricloom.llm.hard_negatives import hard_negatives, hilbert_blocks, hilbert_keys, products, score_bounds, whole_vectors, zone_chunks
from metricloom.llm.support import staged

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block string"


def anchor():
    return F.col("vec_id") % 100 == 0


def make(n=700, clusters=12, size=6):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        c = centres[i % clusters] if i % 3 else centres[0]  # one cluster holds a third and more
        rows.append((i, [x + rng.gauss(0, 0.05) for x in c], rng.choice([0, 0, 1, 2]), "clash", "clash"))
    rows += [(r[0] + 2000, r[1], r[2], "", "") for r in rows[:60]]  # ties
    rows += [rows[100], rows[200], rows[5]]  # repeated rows, of anchors too
    rows += [
        (3000, None, 1, "", ""), (3100, [1.0] * size, None, "", ""), (3200, [math.nan] * size, 1, "", ""), (3300, [math.inf] + [0.0] * (size - 1), 1, "", ""),
        (3400, [None] + [0.0] * (size - 1), 1, "", ""), (3500, [], 1, "", ""), (3501, [], 1, "", ""), (3502, [], 2, "", ""), (None, rows[0][1], 0, "", ""), (None, rows[0][1], 1, "", ""),
        (3600, [0.5, 0.5], 1, "", ""), (3601, [0.5, 0.5], 1, "", ""), (3602, [0.5, 0.4], 2, "", ""), (3700, [3e38] * 3, 1, "", ""), (3701, [3e38] * 3, 1, "", ""), (3702, [3e38, 3e38, 2e30], 2, "", ""),
    ]
    return rows


def brute(rows, positives=5, negatives=5):
    whole = []
    for place, (i, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(min(max(256 * float(np.float32(x)), -module.LARGEST), module.LARGEST)) for x in v]
        whole.append((place, i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = Counter()
    for place, i, v, label in whole:
        if i is None or i % 100:
            continue
        scores = sorted(((sum(a * b for a, b in zip(v, w)), j, other == label) for p, j, w, other in whole if p != place and len(w) == len(v)), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for k, (ps, pid, _) in enumerate([s for s in scores if s[2]][:positives]):
            for rank, (ns, nid, _) in enumerate([s for s in scores if not s[2] and 80 * ps <= 100 * s[0] <= 100 * ps][:negatives], 1):
                out[i, pid, rank, nid, ps, ns, k + 1] += 1
    return out


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("block", [7, 256])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "ZONES", 3)
    monkeypatch.setattr(module, "ANCHORS", 2)
    monkeypatch.setattr(module, "HELD", 20)
    monkeypatch.setattr(module, "ROWS", 200)
    rows = make()
    want = brute(rows)
    assert len(want) > 40
    got = Counter(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), label(), anchor()).collect()))
    assert got == want


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1, "", ""), (100, [1.0, 0.1], 1, "", ""), (3, [0.9, 0.0], 2, "", "")]
    assert Counter(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), label(), anchor()).collect())) == brute(rows)
    assert hard_negatives(spark.createDataFrame([], SCHEMA), label(), anchor()).collect() == []
    assert hard_negatives(spark.createDataFrame(rows[:1], SCHEMA), label(), anchor()).collect() == []


def test_blocks_prune_clustered_rows(spark, monkeypatch):
    """On clustered vectors most blocks are out of reach of an anchor's windows."""
    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 4))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.01, 4)).tolist(), i % 2, "", "") for i in range(2000)]
    blocks = staged(hilbert_blocks(staged(whole_vectors(spark.createDataFrame(rows, SCHEMA), F.col("label"), anchor()))))
    chunks, n = zone_chunks(blocks)
    asking = staged(module._asking(blocks, 5))
    cells = module._needed(asking, chunks, n, True)
    read = cells.select(F.sum(F.octet_length("members") / 4)).first()[0]
    assert blocks.agg(F.sum("n")).first()[0] == 2000
    assert 0 < read < 0.5 * 20 * blocks.count() / 2


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        points = np.array(list(product(range(1 << bits), repeat=dims)))
        keys = [k.tobytes() for k in hilbert_keys(points, bits)]
        assert len(set(keys)) == len(points)
        along = points[np.argsort(np.array(keys, object))]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (20, 9)), rng.integers(-300, 300, (50, 9))
    least, most = score_bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    assert (least <= (a @ b.T)).all() and (most >= (a @ b.T)).all()
    big = np.full((1, 30), module.LARGEST)
    assert products(big, big)[0, 0] == 30 * module.LARGEST**2
