import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import repeats
from metricloom.llm.components import connected
from metricloom.llm.near_duplicates import Signatures, keep_one, near_duplicates
from metricloom.llm.repeats import repeat_report, without_repeats
from metricloom.llm.suffix_runs import Run, cut_run, merge, sorted_run

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_groups(texts, percent):
    """Least index of the component of each text."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


def near_texts(seed=1, groups=12):
    """Chains and stars of edited copies around and below the threshold, and unrelated texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(6, 250))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 5000)}"
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy  # a chain
    return texts


def test_components_are_those_of_all_pairs(spark, rows):
    texts = [r[1] for r in rows] + near_texts()
    group, sets = brute_groups(texts, 85)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame).collect()}
    assert got == {i: (len(sets[i]), group[i], group[i] == i) for i in range(len(texts))}
    assert len(set(group)) < len(texts) - 20


def test_null_and_repeated_ids(docs, rows):
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    base = [r for r in got if r["doc_id"] in (15, 18, 24)] + [r for r in got if r["doc_id"] is None and r["n_shingles"]]
    assert {r["component_id"] for r in base} == {15} and sum(r["kept"] for r in base) == 2  # the repeated row shares it
    assert [r["kept"] for r in got if r["doc_id"] is None and not r["n_shingles"]] == [True]


def test_keep_one_has_the_rows_and_columns_of_its_input(docs, rows):
    got = keep_one(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(15) == 1 and not {18, 24, 21} & set(ids) and ids.count(27) == 1
    texts = [r[1] for r in rows]
    group, _ = brute_groups(texts, 80)
    # Texts without words are alone.
    assert len(ids) == len(set(group))


def test_no_link_is_missed_where_the_signature_promises():
    kind = Signatures(85)
    assert kind._beyond(kind.width, kind.errors) ** kind.chunks < 1e-6
    assert kind.chunks * (kind.errors + 1) - 1 <= kind.most


def test_signature_distance_counts_symbols(spark):
    rng = random.Random(2)
    kind = Signatures(85)
    pairs = []
    for _ in range(50):
        a = [[rng.randrange(4096) for _ in range(kind.width)] for _ in range(kind.chunks)]
        b = [[s if rng.random() < 0.7 else rng.randrange(4096) for s in chunk] for chunk in a]
        pack = lambda x: [sum(s << (12 * i) for i, s in enumerate(chunk)) for chunk in x]
        pairs.append((pack(a), pack(b), sum(s != t for x, y in zip(a, b) for s, t in zip(x, y))))
    frame = spark.createDataFrame(pairs, "a array<long>, b array<long>, d int")
    assert frame.where(kind.distance(F.col("a"), F.col("b")) != F.col("d")).isEmpty()
    shared = frame.select("d", F.size(F.array_intersect(kind.keys(F.col("a")), kind.keys(F.col("b")))).alias("n"))
    assert shared.where((F.col("d") < kind.chunks * (kind.errors + 1)) & (F.col("n") == 0)).isEmpty()


def test_connected_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "left long, right long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160))


def brute_repeats(texts, least=100):
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            window = raw[p : p + least]
            if window in seen:
                covered[p : p + least] = b"\1" * least
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_are_those_of_every_window(docs, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    # The two rows without an id come first; their order is theirs to choose.
    ordered[:2] = sorted(ordered[:2], key=lambda r: r[1] is not None)
    want = sorted((r[0] or -1, *x) for r, x in zip(ordered, brute_repeats([r[1] for r in ordered])))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_report(docs).collect())
    assert got == want


@pytest.mark.parametrize("least", [8, 100])
def test_repeats_at_shared_passages(spark, least):
    rng = random.Random(least)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(least // 2, 3 * least))) for _ in range(6)]
    texts = ["".join(rng.choice([*passages, "".join(rng.choice("ab") for _ in range(30))]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_report(frame, least).collect()}
    assert got == dict(enumerate(brute_repeats(texts, least)))
    assert sum(n for _, n, _, _ in got.values()) > 1000


def test_a_passage_of_all_texts_is_spread_over_the_parts(spark, monkeypatch):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(260)
    texts = [letters(rng.randint(60, 120)) + passage + letters(rng.randint(60, 120)) for _ in range(4000)]
    texts += [texts[0], passage[:130] + letters(50), letters(80) + passage[130:]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    merged, sizes = repeats._merged, []

    def watched(blocks, *args):
        sizes.extend(r["n"] for r in blocks.groupBy("part").agg(F.expr("sum(octet_length(owners)) div 8").alias("n")).collect())
        return merged(blocks, *args)

    monkeypatch.setattr(repeats, "_merged", watched)
    monkeypatch.setattr(repeats, "HOT", 16, raising=False)  # a small table has few texts in the sample
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_report(frame).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))
    assert max(sizes) < len(texts) // 2  # an anchor of all texts is not in one part


def test_texts_longer_than_a_slice(spark):
    """One text of 3 MB and parts of it in others: pieces of a text meet as if it were whole."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(480_000))
    assert len(long) > 2.5 * (1 << 20)
    at = (1 << 20) - 130
    texts = [long[at : at + 300], "x" + long[2 * (1 << 20) - 60 : 2 * (1 << 20) + 60], long, long[50:400] + "!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_report(frame).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))
    assert got[2][1] >= 420 and got[3][1] == 350


def test_removal_keeps_whole_characters(docs, rows):
    got = without_repeats(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    texts = defaultdict(list)
    for r in got.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[18] == [""] and None in texts[None] and all("�" not in (t or "") for ts in texts.values() for t in ts)


def test_merging_runs_equals_sorting():
    rng = np.random.default_rng(4)
    length = 6
    pieces, want = [], []
    borders = np.array([b"bb", b"c"], f"S{length}")
    for owner in range(7):
        strings = rng.integers(97, 100, (int(rng.integers(1, 60)), length), dtype=np.uint8)
        owners, places = np.full(len(strings), owner), np.arange(len(strings))
        order, common = sorted_run(strings)
        want += [(strings[i].tobytes(), owner, i) for i in range(len(strings))]
        for part, mine, shared, tails in cut_run(strings, order, common, borders):
            pieces.append((part, Run(shared, tails, owners[mine], places[mine], length, mine.tolist())))
    got = []
    for part in range(3):
        last = b""
        for common, string, owner, place, extra, _ in merge([run for p, run in pieces if p == part]):
            known = next((i for i in range(length) if string[i : i + 1] != last[i : i + 1]), length)
            assert common == known and extra == place
            got.append((string, owner, place))
            last = string
    assert got == sorted(want)


def test_empty_tables(no_docs):
    assert near_duplicates(no_docs).count() == 0 and keep_one(no_docs).count() == 0
    assert repeat_report(no_docs).count() == 0 and without_repeats(no_docs).count() == 0
