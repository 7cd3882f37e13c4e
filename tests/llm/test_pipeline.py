"""The pipeline against brute force, stage by stage, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
from tests.llm import edge
from tests.llm.test_neardup import brute, fingerprint, shingle_set
from tests.llm.test_packing import check
from tests.llm.test_quality import brute as measures
from tidemark.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [tuple(r) for r in docs.collect()]
        docs = common.materialize(stage(spark, docs, SF), "test")
        assert name == "packing" or docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language id", "simhash near-dedup", "source mix", "packing"]

    passed = []
    for r in inputs["quality rules"]:
        n, chars, symbols, dup, repeated, lines = measures(r[1])
        if not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 14 * n):
            passed.append(r)
    assert sorted(passed) == sorted(inputs["language id"])

    kept = inputs["simhash near-dedup"]
    assert set(kept) <= set(passed) and len(kept) >= 0.98 * len(passed)

    least = brute([r[0] for r in kept], [fingerprint(r[1]) for r in kept], sets=[shingle_set(r[1]) for r in kept])
    assert sorted(r for r, c in zip(kept, least, strict=True) if r[0] == c) == sorted(inputs["source mix"])

    size = Counter()
    taken = Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    whole = {r[0]: r for r in inputs["source mix"]}
    for r in inputs["source mix"]:
        size[r[3]] += words(r[1])
    cut = 0
    for r in inputs["packing"]:
        taken[r[3]] += words(r[1])
        cut += r != whole[r[0]]
        assert r == whole[r[0]] or (" ".join(whole[r[0]][1].split()).startswith(r[1].split(" ")[0]) or r[1] in " ".join(whole[r[0]][1].split()))
    assert cut <= len(size) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 0.03 * sum(size.values())
    assert all(n <= 2 for n in Counter(r[0] for r in inputs["packing"]).values())

    got = [r.asDict() for r in docs.collect()]
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    once = [r for r in inputs["packing"] if sum(x[0] == r[0] for x in inputs["packing"]) == 1]
    single = {r[0] for r in once}
    check(once, [r for r in got if r["doc_id"] in single])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and all(r["length"] & (r["length"] - 1) == 0 for r in rows)


def test_edge_cases(spark, tmp_path):
    good = [(100 + i, " ".join(f"word{i}x{j}" for j in range(80)), "en", "a", 1) for i in range(6)]
    rows = [*edge.ROWS, *good, good[0]]
    out = corpus_pipeline.run(spark, edge.save(spark, rows, tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {r[0] for r in good}
    assert corpus_pipeline.run(spark, edge.save(spark, [], tmp_path / "e")).count() == 0
    docs = edge.clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == edge.clashing(spark).columns, name
