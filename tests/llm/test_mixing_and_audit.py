import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from metricloom.llm.filter_audit import _local_terms, csr_shards, dictionary, filter_interactions, numbered_words, words_of
from metricloom.llm.mixing import label_weights, mixed, source_targets
from metricloom.llm.support import staged

SPACES = " \t\n\r\x0b\x0c"
LABELS = "doc_id long, quality int, toxic int, text string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def labels(spark, rows):
    found = [(r[0], i % 2, int(i % 7 == 0), "clash") for i, r in enumerate(rows) if r[0] is not None and i % 3 == 0]
    return spark.createDataFrame([*found, (found[0][0], 1, 1, ""), (None, 1, 1, None), (10**9, 1, 1, None), (found[1][0], None, None, None)], LABELS)


def poured(sizes, weights, most):
    """Targets by pouring the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(full.values())
        open_weight = sum(w[s] for s in order if s not in full)
        above = {s: most * sizes[s] for s in order if s not in full and w[s] * rest / open_weight >= most * sizes[s]}
        if not above:
            return {s: float(full[s]) if s in full else w[s] * rest / open_weight for s in order}
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 5000, "é": 0, None: 300, "": 7}, {"z": 5}, {f"s{k}": (k * 37) % 11 * 100 for k in range(30)}, {None: 3, "x": 1000}])
def test_targets_are_those_of_pouring(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = poured(sizes, (5, 2, 1), 3)
    found = {r["source"]: r["target"] for r in got.collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[s], want[s], abs_tol=1e-9) for s in want)
    assert math.isclose(sum(found.values()), sum(sizes.values()))


def test_mix_takes_what_the_sampling_order_gives(docs, rows, labels):
    label_rows = labels.collect()
    weight = defaultdict(lambda: 1.0)
    for r in label_rows:
        mine = {1: 2.0, 0: 0.5}.get(r["quality"], 1.0)
        weight[r["doc_id"]] = max(weight[r["doc_id"]], mine) if r["doc_id"] in weight else mine
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = poured(sizes, (5, 2, 1), 3)
    want = Counter()
    for source, target in targets.items():
        mine = [(r[0], len(words(r[1])), r[1]) for r in rows if r[3] == source]
        epochs = int(target // sizes[source]) if sizes[source] else 0
        rest, at = target - epochs * sizes[source], 0

        def key(m):
            u = (int(hashlib.md5(f"{'' if m[0] is None else m[0]}/1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / (weight[m[0]] if m[0] is not None else 1.0)

        got_here = 0
        for m in sorted(mine, key=lambda m: (key(m), m[0] is not None, m[0] or 0, m[1])):
            taken = m[1] * (epochs + (rest > 0 and at + m[1] / 2 <= rest))
            at += m[1]
            got_here += taken
            want[m[0], m[1], sizes[source], round(target, 6), taken] += 1
        assert abs(got_here - target) <= max((m[1] for m in mine), default=0) / 2 + 1e-9
    found = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixed(docs, label_weights(labels)).collect()]
    # Rows of one id in one source follow each other by a hash of their text: only their total is fixed.
    assert Counter(f[:4] for f in found) == Counter(w[:4] for w in want.elements())
    taken = Counter()
    for f in found:
        taken[f[0], f[2]] += f[4]
    for w in want.elements():
        taken[w[0], w[2]] -= w[4]
    assert all(v == 0 for (i, _), v in taken.items() if i is not None)


def test_mix_is_the_same_in_other_partitions_and_may_be_empty(docs, no_docs, labels):
    first = Counter(map(tuple, mixed(docs, label_weights(labels)).collect()))
    assert first == Counter(map(tuple, mixed(docs.repartition(7), label_weights(labels)).collect()))
    assert mixed(no_docs).collect() == [] and sum(r["size"] for r in mixed(docs).collect()) == sum(k[1] * n for k, n in first.items())


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    from metricloom.llm import filter_audit

    monkeypatch.setattr(filter_audit, "PIECE", 7)
    for text in ("a bb  ccc\tdddd\x0beeeee\r\nffffffffffffff g", " " * 30, "x" * 40, "", "ab " * 9, "longerthanseven again"):
        assert words_of(text.encode()) == Counter(w.encode() for w in words(text))


def test_shards_hold_the_matrix(docs, rows, monkeypatch):
    from metricloom.llm import filter_audit

    monkeypatch.setattr(filter_audit, "SHARD_WORDS", 90)
    monkeypatch.setattr(filter_audit, "BUCKET_WORDS", 40)
    local = staged(_local_terms(docs))
    numbered = numbered_words(local)
    listed = {r["term"]: r["word"].decode() for r in dictionary(numbered).collect()}
    assert sorted(listed) == list(range(len(listed))) and set(listed.values()) == {w for r in rows for w in words(r[1])} and len(set(listed.values())) == len(listed)
    import numpy as np

    found = Counter()
    for r in csr_shards(local, numbered).collect():
        ends, terms, counts = np.frombuffer(r["indptr"], np.int64), np.frombuffer(r["indices"], np.int64), np.frombuffer(r["data"], np.int32)
        for a, b in zip(ends, ends[1:]):
            assert (np.diff(terms[a:b]) > 0).all()
            found[frozenset((listed[t], int(c)) for t, c in zip(terms[a:b].tolist(), counts[a:b]))] += 1
    assert found == Counter(frozenset(Counter(words(r[1])).items()) for r in rows)


def failed_set(row, rows):
    text = row[1] or ""
    w = words(text)
    fails = {
        "A": len(w) < 200,
        "B": 100 * len(set(w)) < 50 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": any((o[1] or "") == text and o[0] is not None and row[0] is not None and o[0] < row[0] for o in rows),
    }
    return {f for f, bad in fails.items() if bad}


def test_audit_equals_running_every_order(docs, rows, labels):
    good, toxic = ({r["doc_id"] for r in labels.collect() if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    judged = [(r[3] or "", r[0], failed_set(r, rows)) for r in rows]
    want = {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                here = [j for j in left if letter in j[2]]
                left = [j for j in left if letter not in j[2]]
                failing = [j for j in mine if letter in j[2]]
                removed_by[letter] += len(here)
                want[part, order, step] = [len(left), len(here), len(failing) - len(here), sum(j[2] == {letter} for j in mine), sum(j[1] in good for j in here), sum(j[1] in toxic for j in here)]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                want[part, order, step].append(removed_by[letter])
    found = {tuple(r)[:3]: list(r)[3:] for r in filter_interactions(docs, labels).collect()}
    assert found == want


def test_audit_of_small_shards_and_nothing(spark, docs, no_docs, labels):
    assert filter_interactions(no_docs, labels).collect() == []
    blank = filter_interactions(docs.where("doc_id in (0, 3)"), labels.limit(0)).collect()  # null and empty: no word at all
    assert len(blank) == 1200 and all(r["removed"] == 1 for r in blank if r["filter_order"] == "ABCDE" and r["step"] == 1)
    whole = {tuple(r) for r in filter_interactions(docs, labels).collect()}
    none = filter_interactions(docs.repartition(9), labels.limit(0)).collect()
    assert {tuple(r)[:7] for r in none} == {r[:7] for r in whole} and all(r["good_lost"] == r["toxic_lost"] == 0 for r in none)
