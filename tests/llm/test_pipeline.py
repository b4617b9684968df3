import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from metricloom.llm.decontamination import leak_report
from metricloom.llm.quality_rules import quality_verdicts
from metricloom.llm.queries import ORACLES, QUERIES
from metricloom.session import shared_folder
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [next(n for n in QUERIES if n.startswith(f"op{k}_")) for k in range(1, 14)] and len(QUERIES) == 13
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ok, why, _, _ = compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert ok, why


def test_stages_hand_on_documents_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(path := str(tmp_path / name))
        found = spark.read.parquet(path)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert found.agg({"length": "sum"}).first()[0] > found.select("doc_id").distinct().count()
            assert {r["doc_id"] for r in found.select("doc_id").collect()} == set(kept)
            break
        assert found.columns == columns
        rows = found.collect()
        kept = {r["doc_id"]: r["text"] for r in rows}
        assert set(kept) <= set(texts) and len(kept) == len(rows)
        if name in ("quality_rules", "near_duplicates"):
            assert all(texts[i] == t for i, t in kept.items())
        if name == "near_duplicates":
            assert max(Counter(kept.values()).values()) == 1
        if name == "suffix_repeats":
            # Text that is left twice is shorter than 100 bytes, but where two ends have met.
            assert all(len(t) <= len(texts[i]) for i, t in kept.items())
        if name == "benchmark_decontamination":
            leaks = leak_report(found, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
            assert leaks.agg({"n_hit": "sum"}).first()[0] == 0
            assert all(len(re.findall(r"\w+", t)) <= len(re.findall(r"\w+", texts[i])) for i, t in kept.items())
        docs, texts = found, kept


def test_the_first_stage_leaves_no_copy_of_the_texts(spark, docs):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.rglob("*.parquet"))
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.count()
    left = [p for p in set(folder.rglob("*.parquet")) - before if p.is_file()]
    assert left and all("text" not in pq.read_schema(p).names and "row" not in pq.read_schema(p).names for p in left)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_on_awkward_rows_are_those_of_brute_force(spark, docs, benchmark, tmp_path):
    """Every stage on its own input: nulls, empties, copies, a very long text, ties and clashing names."""
    folder = str(tmp_path)
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, folder)
    judged = Counter((r["doc_id"], r["n_words"]) for r in quality_verdicts(docs).collect() if r["kept"])
    assert kept.columns == docs.columns and Counter((r["doc_id"], len((r["text"] or "").split())) for r in kept.collect()) == judged

    alone = stages["near_duplicates"](spark, docs, folder)
    assert alone.columns == docs.columns
    before, after = docs.collect(), alone.collect()
    sets = [shingles(r["text"]) for r in before]
    group = list(range(len(before)))
    for _ in before:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    members = {}
    for g, r in zip(group, before):
        members.setdefault(g, []).append(r)
    left = Counter(map(tuple, after))
    assert sum(left.values()) == len(members) and all(any(left[tuple(m)] for m in found) for found in members.values())

    cut = stages["suffix_repeats"](spark, docs, folder)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    seen = set()
    texts = sorted((r["text"] for r in cut.collect() if r["text"]), key=len)
    for text in texts:  # what is left once has no window of an other text, but where two ends have met
        raw = text.encode()
        mine = {raw[i : i + 300] for i in range(len(raw) - 299)}
        assert not mine & seen
        seen |= mine

    clean = stages["benchmark_decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and not any(r["n_hit"] for r in leak_report(clean, benchmark).collect())
    untouched = {r["doc_id"] for r in leak_report(docs, benchmark).collect() if not r["n_hit"]}
    assert Counter(tuple(r) for r in clean.collect() if r["doc_id"] in untouched) == Counter(tuple(r) for r in before if r["doc_id"] in untouched)

    packed = stages["mixture_packing"](spark, docs, folder).collect()
    total = Counter()
    for r in packed:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) == 1024 and sum(n < 1024 for n in total.values()) <= 1
    assert sum(r["length"] for r in packed if r["start"] == 0 and r["doc_tokens"] == 1) == sum(not r["text"] for r in before)


def test_stages_on_an_empty_table(spark, no_docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
