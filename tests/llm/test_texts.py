import hashlib
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from metricloom.llm import licenses
from metricloom.llm.decontamination import decontaminated, leak_report
from metricloom.llm.language_model import scored_texts
from metricloom.llm.licenses import LicenseScanner, license_scan, rules
from metricloom.llm.quality_rules import keep_good, quality_verdicts
from metricloom.llm.sharding import contiguous_shards, least_capacity
from metricloom.llm.token_counts import MARK, PieceCounter, token_counts, unigram_vocabulary

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def by_text(rows, columns):
    """Rows as a multiset of (doc_id, columns...)."""
    return Counter(tuple(r[c] for c in ("doc_id", *columns)) for r in rows)


# ---------------------------------------------------------------- quality rules


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n, repeated = len(words), len(inside)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n)


def test_base_counts(docs, rows):
    got = quality_verdicts(docs).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_text(got, columns) == Counter((r[0], *base_counts(r[1])) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    verdicts = quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet"))
    return verdicts.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()


def test_divergence_rejects_junk_and_keeps_clean_texts(labelled):
    clean, junk = labelled[labelled.quality == 1], labelled[labelled.quality == 0]
    assert clean.kept.mean() > 0.99
    assert junk.kept.mean() < 0.5


def test_keep_good_has_the_rows_and_columns_of_its_input(docs):
    got = keep_good(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in quality_verdicts(docs).where("kept").collect()}
    assert {r["doc_id"] for r in got.collect()} == kept and 15 in kept


# ---------------------------------------------------------------- licences


def test_license_base_counts(docs, rows):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = Counter()
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOW))
        at = sorted((i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        places = [i for i, _ in at]
        want[r[0], len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))] += 1
    got = license_scan(docs).collect()
    assert by_text(got, ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    found = next(r for r in got if r["n_base"])
    assert found["labels"] == "apache-2,cc-by-nc,gpl-3.0,mit" and found["n_base"] == 3


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("distributed under the terms of the GNU Lesser General Public License version 2.1", ["lgpl-2.1"]),
        ("the GNU General Public License", ["gpl"]),
        ("BSD 3-Clause License", ["bsd-3-clause"]),
        ("SPDX-License-Identifier: MPL-2.0", ["mpl-2.0"]),
        ("mit freundlichen gruss an alle", []),
        ("this python script reads a table", []),
        ("Creative Commons Attribution-ShareAlike 4.0 International License", ["cc-by-sa"]),
        ("released under the ISC license and under the MIT license", ["isc", "mit"]),
    ],
)
def test_license_rules(text, labels):
    scanner = LicenseScanner()
    words = " ".join(["", *re.findall(r"[0-9a-z]+", text.lower()), ""]).encode()
    found = scanner.detections(words, scanner.keywords(words))
    assert [rule.label for _, _, rule in found] == labels
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(found))


def test_hundreds_of_rules_with_keywords_that_their_matches_hold():
    assert len(rules()) >= 200 and [r.priority for r in rules()] == list(range(len(rules())))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the CreativeML Open RAIL-M license", ["openrail"]),
        ("licensed under the CreativeML OpenRAIL-M license", ["openrail"]),
        ("use it under the PSF license", ["python-2.0"]),
        ("GPL 3\nLicense-Identifier: MIT", ["gpl-3.0", "mit"]),  # 'gpl 3 license' loses to 'license identifier mit'
    ],
)
def test_license_rules_of_narrow_gates_and_lost_containers(text, labels):
    test_license_rules(text, labels)


def alternatives(tree):
    """A sample of each alternative of a parsed pattern, with and without what is optional."""
    found = [""]
    for kind, value in tree:
        match str(kind):
            case "LITERAL":
                some = [chr(value)]
            case "IN":
                some = ["w" if str(k) == "CATEGORY" else chr(v) for k, v in value]
            case "BRANCH":
                some = [x for branch in value[1] for x in alternatives(branch)]
            case "SUBPATTERN":
                some = alternatives(value[3])
            case "MAX_REPEAT":
                some = [*([] if value[0] else [""]), *alternatives(value[2])]
        found = [a + b for a in found for b in some]
    return found


def test_every_alternative_of_a_license_pattern_passes_its_gate():
    scanner = LicenseScanner()
    for _, keyword, pattern in (*licenses.SENTENCES, *licenses.FAMILIES, *licenses._creative_commons()):
        for sample in alternatives(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, sample) and keyword in scanner.keywords(f" {sample} ".encode())


# ---------------------------------------------------------------- token counts


def test_counts_are_those_of_the_tokenizer(docs, rows):
    vocabulary = unigram_vocabulary(PIECES)
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    want = Counter((r[0], len(model.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert by_text(token_counts(docs, PIECES).collect(), ("n_tokens",)) == want


def test_viterbi_ties_take_the_longest_last_piece_and_unknowns_fuse():
    counter = PieceCounter([("a", -1.0), ("aa", -2.0), ("b", -1.0)])
    assert counter.viterbi("aa") == 1 and counter.viterbi("aab") == 2
    assert counter.viterbi("xyz") == 1 and counter.viterbi("axyb") == 3


# ---------------------------------------------------------------- decontamination


def item_windows(items, size):
    found = defaultdict(set)
    for key, text in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            found[tuple(words[i : i + size])].add(key)
    return found


def test_leaks_are_those_of_every_window(docs, rows, benchmark, items):
    windows = item_windows(items, 10)
    want = Counter()
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOW))
        hit, keys = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    keys |= found
        ids = sorted(str(k) for k in keys if k is not None)
        want[r[0], len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    got = leak_report(docs, benchmark)
    assert by_text(got.collect(), ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    assert sum(n for (_, _, hit, *_), n in want.items() if hit) >= 4


def test_several_blocks_of_items_give_the_same(docs, benchmark, monkeypatch):
    whole = leak_report(docs, benchmark).collect()
    monkeypatch.setattr("metricloom.llm.decontamination.BLOCK_WORDS", 20)
    assert Counter(leak_report(docs, benchmark).collect()) == Counter(whole)


def test_decontaminated_texts(docs, rows, benchmark):
    got = decontaminated(docs, benchmark)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert 12 not in texts  # "three short words" is mostly a leak
    assert texts[15] == rows[5][1] and len(texts[27].split()) == len(rows[9][1].split()) - 30
    assert not any(r["n_hit"] for r in leak_report(got, benchmark).collect())


def test_a_cut_that_joins_a_window_is_cut_again(spark, docs, no_docs, benchmark):
    words = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words[:12])), (2, " ".join(words[12:24]))], "item_id long, text string")
    inner = " ".join([*words[12:18], *words[:12], *words[18:24]])  # taking item 1 out leaves item 2 whole
    rows = [(1, f"{'own ' * 80}{inner} {'own ' * 80}", 7), (2, "own words", 8), (3, None, 9), (4, inner, 1), (5, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminated(frame, items).collect()}
    assert set(got) == {1, 2, 3, 5} and got[2] == ("own words", 8) and got[3] == (None, 9)
    assert got[1][0].split() == ["own"] * 160 and got[1][1] == len(got[1][0])
    assert decontaminated(no_docs, benchmark).count() == 0
    kept = decontaminated(docs, benchmark.limit(0))
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, docs.collect()))


# ---------------------------------------------------------------- shards


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, parts, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                parts, room = parts + 1, middle
            room -= s
        low, high = (low, middle) if parts <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 5, 300, 5000])
def test_least_capacity(spark, n):
    sizes = [(i * i * 7919) % 1000 + 16 for i in range(n)]
    ends = spark.createDataFrame([(e,) for e in itertools.accumulate(sizes)], "end long").repartition(4)
    capacity, cuts = least_capacity(ends, 40)
    assert capacity == brute_capacity(sizes, 40)
    edges = [0, *cuts, sum(sizes)]
    assert max(b - a for a, b in itertools.pairwise(edges)) == capacity and set(cuts) <= {0, *itertools.accumulate(sizes)}


def test_shards(docs, rows):
    got = contiguous_shards(docs, 8).collect()
    assert by_text(got, ("size", "text_crc32")) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(8))
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(rows[5][1].encode())}) == 1
    groups = {}
    for r in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        groups.setdefault(r[1], []).append(len((r[1] or "").encode()) + 16)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) >= max(map(sum, groups.values()))


# ---------------------------------------------------------------- language model


class Node:
    """One decision's context tree, a node for each context, updated one bit at a time."""

    def __init__(self):
        self.counts, self.children, self.own, self.weighted = [0, 0], {}, 0.0, 0.0


def sequential_score(train, texts, depth):
    """Context-tree weighting bit by bit, as in its definition, for tiny inputs."""
    trees = defaultdict(Node)

    def path(decision, context):
        node, found = trees[decision], []
        for d in range(depth + 1):
            found.append(node)
            if d < depth:
                node = node.children.setdefault(context[d], Node())
        return found

    def kt(counts, bit):
        return (counts[bit] + 0.5) / (sum(counts) + 1)

    def add(decision, context, bit):
        nodes = path(decision, context)
        for d in range(depth, -1, -1):
            node = nodes[d]
            node.own += math.log(kt(node.counts, bit))
            node.counts[bit] += 1
            if d == depth:
                node.weighted = node.own
            else:
                below = sum(c.weighted for c in node.children.values())
                node.weighted = math.log(0.5) + max(node.own, below) + math.log1p(math.exp(-abs(node.own - below)))

    def probability(decision, context, bit):
        nodes = path(decision, context)
        p = kt(nodes[depth].counts, bit)
        for node in reversed(nodes[:-1]):
            share = 1 / (1 + math.exp(sum(c.weighted for c in node.children.values()) - node.own))
            p = share * kt(node.counts, bit) + (1 - share) * p
        return p

    def decisions(raw):
        whole = [0xFF] * depth + list(raw) + [0xFF]
        for i in range(depth, len(whole)):
            context = whole[i - depth : i][::-1]
            for b in range(8):
                yield (b, whole[i] >> (8 - b)), context, whole[i] >> (7 - b) & 1

    for raw in train:
        for step in decisions(raw):
            add(*step)
    return [sum(math.log10(probability(*step)) for step in decisions(raw)) for raw in texts]


def test_scores_are_those_of_the_sequential_model(spark):
    texts = ["The cat sat.", "the cat", "", None, "a CAT sat on the mat é", "zzzz", "the cat sat on the mat", "dog and cat", "the dog", "mat", "cat the", "sat sat sat sat"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw = {i: (t or "").translate(LOW).encode() for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in raw}
    assert any(held.values())
    want = dict(zip(raw, sequential_score([t for i, t in raw.items() if not held[i]], raw.values(), 5), strict=True))
    got = {r["doc_id"]: r for r in scored_texts(frame).collect()}
    words = Counter(w for i, t in raw.items() if not held[i] for w in t.split())
    ends = sum(not h for h in held.values())
    n, v = sum(words.values()) + ends, len(words) + 1
    for i, t in raw.items():
        r = got[i]
        counts = [words[w] for w in t.split()] + [ends]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(counts), sum(c > 0 for c in counts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in counts))
        assert r["score"] == pytest.approx(want[i], rel=1e-9)


def test_scores_of_awkward_rows(docs, rows):
    got = scored_texts(docs).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert len({(r["score"], r["base_score"]) for r in got if r["doc_id"] in (15, 18)}) == 1


def test_no_two_groups_of_texts_share_a_task(spark, monkeypatch):
    monkeypatch.setattr("metricloom.llm.language_model.GROUP_BYTES", 30)
    frame = spark.createDataFrame([(i, "a few words " * 5) for i in range(13)], "doc_id bigint, text string").coalesce(1)
    rows = scored_texts(frame).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(rows) == 13 and {r["count"] for r in rows} == {1}


def test_empty_tables(spark, no_docs, benchmark):
    for found in (
        quality_verdicts(no_docs),
        keep_good(no_docs),
        license_scan(no_docs),
        token_counts(no_docs, PIECES),
        leak_report(no_docs, benchmark),
        contiguous_shards(no_docs),
        scored_texts(no_docs),
    ):
        assert found.isEmpty()
    assert not leak_report(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), benchmark.limit(0)).first()["contaminated"]
