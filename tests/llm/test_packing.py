import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metricloom.llm.packing_best_fit import best_fit_decreasing, packed_matrices
from metricloom.llm.packing_mixture import mixture_order, mixture_packed
from metricloom.llm.tokens import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def ids(rows, tokenizer):
    """Ids of each row as a multiset key: (doc_id, ids)."""
    return Counter((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in rows)


def test_ids_are_those_of_the_tokenizer(rows, tokenizer):
    encoder = TextEncoder(PATH)
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab \n\t.'é日 1　 ") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for text in [*(r[1] or "" for r in rows), *odd]:
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def rebuilt(pieces):
    """Documents from (key, start, ids) pieces that follow each other, repeated documents included."""
    by_key = defaultdict(lambda: defaultdict(list))
    for key, start, part in pieces:
        by_key[key][start].append(tuple(part))
    found = Counter()
    for key, starts in by_key.items():
        while starts:
            at, whole = 0, ()
            while starts.get(at):
                part = starts[at].pop()
                if not starts[at]:
                    del starts[at]
                whole += part
                at += len(part)
            found[key, whole] += 1
            if not whole:
                raise AssertionError(f"pieces of {key} do not meet")
    return found


def test_matrices_hold_every_document_once(docs, ids):
    packed = packed_matrices(docs, PATH).collect()
    assert len({r["sequence_id"] for r in packed}) == len(packed)
    pieces = []
    for r in packed:
        row = np.frombuffer(r["input_ids"], "<u2")
        positions = np.frombuffer(r["position_ids"], "<i4")
        assert len(row) == len(positions) == 1024 and r["cu_seqlens"][-1] == r["n_tokens"] <= 1024
        for k, (start, end) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
            assert positions[start:end].tolist() == list(range(end - start))
            pieces.append((r["doc_ids"][k], r["starts"][k], row[start:end].tolist()))
        assert not row[r["n_tokens"] :].any() and not positions[r["n_tokens"] :].any()
    # Equal documents can swap pieces of equal content only.
    assert rebuilt(pieces) == ids


def one_by_one(lengths, capacity):
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits)[1]] -= length
        else:
            free.append(capacity - length)
    return sorted(free)


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_is_that_of_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
    slots, bins = best_fit_decreasing(Counter(lengths), capacity)
    used, ranks = [0] * bins, defaultdict(list)
    taken = defaultdict(list)
    for length, rank, n, per, first, start in slots:
        ranks[length] += range(rank, rank + n)
        for j in range(n):
            taken[first + j // per].append((start + j % per * length, length))
    for b, parts in taken.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        used[b] = end
    assert sorted(capacity - u for u in used) == one_by_one(lengths, capacity)
    assert all(sorted(r) == list(range(lengths.count(k))) for k, r in ranks.items())


def test_windows_hold_every_document_once_and_follow_the_shares(docs, rows, ids):
    packed = mixture_packed(docs, PATH).collect()
    by_window = defaultdict(list)
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes())
        by_window[r["sequence_id"]].append((r["offset"], r["length"], r["source"]))
    assert sorted(by_window) == list(range(len(by_window)))
    for window, parts in by_window.items():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or window == len(by_window) - 1
    assert rebuilt([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u2").tolist()) for r in packed]) == ids


def test_every_source_keeps_to_its_share_while_it_lasts(spark):
    frame = spark.range(400).selectExpr("id AS row", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source", "CAST(1 + id * 37 % 3000 AS LONG) AS n_tokens")
    weights = spark.createDataFrame([("hot", 3.0), *[(f"s{i}", 1.0) for i in range(7)]], "source string, weight double")
    window, piece = 512, 128
    tokens = {r["source"]: r["n"] for r in frame.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    placed = sorted((r["sequence_id"], r["offset"], r["length"], r["source"]) for r in mixture_order(frame, window, piece, weights).collect())
    sent, place = defaultdict(int), 0
    share = {s: (3.0 if s == "hot" else 1.0) / 10 for s in tokens}
    for sequence, offset, length, source in placed:
        assert sequence * window + offset == place
        place += length
        sent[source] += length
        if all(sent[s] < tokens[s] for s in tokens):
            for s in tokens:
                assert abs(sent[s] - place * share[s]) <= piece * len(tokens) + window
    assert sent == tokens


def test_empty_tables_pack_to_nothing(no_docs):
    assert packed_matrices(no_docs, PATH).count() == 0
    assert mixture_packed(no_docs, PATH).count() == 0
