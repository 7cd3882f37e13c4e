from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests import parity
from tests.llm import edge
from tidemark.llm import common, mixing


def water(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing out again until none is above its limit."""
    target, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_query_and_sql(spark):
    assert parity.same(mixing.op1(spark, parity.SF), mixing.OP1_SQL) == 200


def test_targets_and_words(spark):
    rows = mixing.op1(spark, "/root/testdata/sf0.01").collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    want = water(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))})
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 2
    assert rows == mixing.op1(spark, "/root/testdata/sf0.01").collect() or sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op1(spark, "/root/testdata/sf0.01").collect()))


def test_schedule(spark):
    """Every slot takes one block; a source's slots are spread evenly; blocks are taken in turn."""
    m = mixing.mix(spark.read.parquet(f"{parity.SF}/documents.parquet"))
    slots = sorted((r["slot"], r["source_no"], r["rank"], r["block"], r["epoch"]) for r in m.schedule.collect())
    plan = {r["source_no"]: r for r in m.sources.collect()}
    by = defaultdict(list)
    for at, (_, s, rank, block, epoch) in enumerate(slots):
        assert (rank, block, epoch) == (len(by[s]), rank % plan[s]["blocks"], rank // plan[s]["blocks"])
        by[s].append(at)
    for s, at in by.items():
        assert len(at) == plan[s]["slots"] <= 2 * plan[s]["blocks"]
        share = len(at) / len(slots)
        assert max(abs((k + 0.5) / share - a) * share for k, a in enumerate(at)) < 8
    pieces = defaultdict(int)
    for r in m.pieces.collect():
        pieces[r["source_no"], r["block"]] += r["n_words"]
    assert {s: max(n for (x, _), n in pieces.items() if x == s) - min(n for (x, _), n in pieces.items() if x == s) for s in plan} == {s: min(1, plan[s]["longer"]) for s in plan}


def test_hot_source_and_small_groups(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "_CHUNK", 16)
    rows = [(i, "w " * (i % 17), "en", "hot" if i % 3 else f"s{i % 9}", 1) for i in range(300)]
    folder = edge.save(spark, rows, tmp_path)
    parity.same(mixing.op1(spark, folder), mixing.OP1_SQL, views={"documents": f"{folder}/documents.parquet/*.parquet"})


def test_edge_cases(spark, tmp_path):
    folder = edge.save(spark, edge.ROWS, tmp_path)
    parity.same(mixing.op1(spark, folder), mixing.OP1_SQL, views={"documents": f"{folder}/documents.parquet/*.parquet"})
    assert mixing.op1(spark, edge.save(spark, [], tmp_path / "e")).count() == 0
    assert {r["taken"] for r in mixing.op1(spark, edge.save(spark, [(1, None, "en", "s", 1), (2, "", "en", None, 1)], tmp_path / "z")).collect()} == {0}


def test_stage_returns_what_the_mix_takes(spark):
    docs = edge.clashing(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    count = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0))
    got = {(r["doc_id"]): r["n"] for r in out.groupBy("doc_id").agg(F.sum(count).alias("n")).collect()}
    want = {(r["doc_id"]): r["n"] for r in mixing.taken(mixing.mix(docs)).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r["n"]}
    assert got == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(" ".join((texts[r["doc_id"]]).split()).startswith(" ".join(r["text"].split())) for r in out.collect() if r["doc_id"] != 8)
    assert mixing.mixed(edge.docs(spark, [])).count() == 0
