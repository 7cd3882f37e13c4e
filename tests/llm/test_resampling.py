import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm import edge
from tidemark.llm import resampling


def test_weights_by_definition(spark, tmp_path):
    texts = {1: "good words here", 2: "bad words there bad", 3: "", 4: "Good WORDS"}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], edge.COLUMNS)
    ids = spark.createDataFrame([(1,)], "target_id long")
    got = {r["doc_id"]: r for r in resampling.resample(df, ids, 0.5).collect()}
    b = {i: resampling.buckets(t.encode(), resampling._Hashes()).tolist() for i, t in texts.items()}
    assert [len(x) for x in b.values()] == [5, 7, 0, 3] and set(b[4]) < set(b[1])
    raw = [x for v in b.values() for x in v]
    for i, v in b.items():
        w = sum(math.log((b[1].count(x) + 1) / (len(b[1]) + 10_000)) - math.log((raw.count(x) + 1) / (len(raw) + 10_000)) for x in v)
        assert abs(got[i]["log_weight"] - w) < 1e-9
    assert sum(r["kept"] for r in got.values()) == 2


def test_long_words_are_not_remembered():
    hashes = resampling._Hashes()
    b = resampling.buckets(b"x" * 100_000 + b" word " + b"x" * 100_000, hashes)
    assert list(hashes) == [b"word"] and b[0] == b[2] == (xxhash.xxh64_intdigest(b"x" * 100_000, 42) & (1 << 63) - 1) % 10_000


def test_kth_largest(spark):
    r = random.Random(1)
    for values in ([5], [r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(300)], [r.randint(-3, 3) for _ in range(100)], [-(1 << 63), (1 << 63) - 1, 0, -1]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        for k in {1, 2, len(values) // 2 + 1, len(values)} & set(range(1, len(values) + 1)):
            assert resampling.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
        assert resampling.kth_largest(df, "v", len(values) + 1) is None and resampling.kth_largest(df, "v", 0) is None


def test_gumbel_draws_in_proportion(spark):
    """With equal texts, each half of the ids is drawn about equally often; noise has the mean of a Gumbel variable."""
    df = edge.docs(spark, [(i, "same", "en", "s", 1) for i in range(4000)])
    rows = resampling.resample(df, spark.createDataFrame([], "target_id long"), 0.25).collect()
    assert sum(r["kept"] for r in rows) == 1000 and 420 < sum(r["kept"] for r in rows if r["doc_id"] < 2000) < 580
    assert abs(np.mean([r["score"] for r in rows]) - 0.5772) < 0.08


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    out = resampling.op4(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {(r["quality"], r["toxic"]): r["k"] for r in out.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1, 0] > 0.95 and kept[0, 0] < 0.4
    rows = out.collect()
    scores = sorted((r["score"] for r in rows), reverse=True)
    n = sum(r["kept"] for r in rows)
    assert all(r["kept"] == (r["score"] >= scores[n - 1]) for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, resampling.op4(spark, sf).collect()))


def test_edge_cases(spark, tmp_path):
    folder = edge.save(spark, edge.ROWS, tmp_path)
    edge.save(spark, [(1, 1, 0), (1, 1, None), (5, 0, 1), (None, 1, 0)], tmp_path, "doc_id long, quality int, toxic int", "labels")
    got = resampling.op4(spark, folder).collect()
    assert len(got) == len(edge.ROWS) and len({r["kept"] for r in got if r["doc_id"] == 6}) == 1
    assert all(r["log_weight"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    for name in ("e", "f"):
        edge.save(spark, [] if name == "e" else edge.ROWS, tmp_path / name)
        edge.save(spark, [], tmp_path / name, "doc_id long, quality int, toxic int", "labels")
        out = resampling.op4(spark, str(tmp_path / name)).collect()
        assert len(out) == (0 if name == "e" else len(edge.ROWS)) and all(r["kept"] for r in out)


def test_query_by_brute_force(spark):
    """Hashes, counts, weights, noise and the draw of every row, from their definitions."""
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = {r["doc_id"] for r in labels if r["quality"]}
    target = good - {r["doc_id"] for r in labels if r["toxic"]}
    mask = 2**64 - 1

    def grams(text):
        h = [xxhash.xxh64_intdigest(w, 42) & 2**63 - 1 for w in text.lower().split()]
        pairs = [(a * 0x9E3779B97F4A7C15 & mask) ^ ((b >> 3) * 0xC2B2AE3D27D4EB4F & mask) for a, b in zip(h, h[1:], strict=False)]
        return [x % 10_000 for x in h] + [(x ^ x >> 29) % 10_000 for x in pairs]

    raw, own = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        own.update(grams(t) if i in target else ())
    n, m = sum(raw.values()), sum(own.values())
    score = {}
    for i, t in docs:
        w = sum(math.log((own[x] + 1) / (m + 10_000)) - math.log((raw[x] + 1) / (n + 10_000)) for x in grams(t))
        u = ((xxhash.xxh64_intdigest(f"{i}:{xxhash.xxh64_hexdigest(t, 42)}", 42) >> 11) + 0.5) / 2**53
        score[i] = w - math.log(-math.log(u))
    k = max(1, math.floor(len(good) / len({r["doc_id"] for r in labels}) * len(docs) + 0.5))
    kept = set(sorted(score, key=score.get, reverse=True)[:k])
    got = resampling.op4(spark, sf).collect()
    assert len(got) == len(docs) and {r["doc_id"] for r in got if r["kept"]} == kept
    assert all(abs(r["score"] - score[r["doc_id"]]) < 1e-6 for r in got)


def test_null_ids_have_noise_of_their_own(spark):
    rows = resampling.resample(edge.docs(spark, [(None, f"text {i}", "en", "s", 1) for i in range(400)]), spark.createDataFrame([], "target_id long"), 0.25).collect()
    assert sum(r["kept"] for r in rows) == 100
