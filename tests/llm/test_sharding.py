import os

import pytest
from pyspark.sql import functions as F

from tests import parity
from tests.llm import edge
from tidemark.llm import common, sharding


def sized(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", common.octets(F.col("text")).alias("n_bytes"))


def test_query_and_sql(spark):
    for sf, n in ((parity.SF, 200), ("/root/testdata/sf0.01", 1000)):
        out = common.materialize(sharding.op7(spark, sf), "test")
        assert parity.same(out, sharding.OP7_SQL, sf) == n
        assert out.select("shard").distinct().count() >= 16 and out.select("local_depth").distinct().count() > 1


@pytest.mark.parametrize("limit", [40_000, 300_000])
def test_splits(spark, limit):
    out = sharding.shard(sized(spark), "doc_id", F.col("n_bytes"), limit)
    assert parity.same(out, sharding.sql(limit), "/root/testdata/sf0.01") == 1000
    entries = sorted((r["first_entry"], r["last_entry"]) for r in sharding.directory(out).collect())
    assert all(a[1] < b[0] for a, b in zip(entries, entries[1:], strict=False))


def test_hot_key_overflows_into_pages(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_BITS", 3)
    df = sized(spark).select(F.when(F.col("doc_id") % 3 == 0, F.lit(7)).otherwise(F.col("doc_id")).alias("key"), "n_bytes")
    big = spark.createDataFrame([(7, 50_000), (9_999, 70_000)], "key long, n_bytes long")
    rows = sharding.shard(df.unionByName(big), "key", F.col("n_bytes"), 34_000).collect()
    pages = {}
    for r in rows:
        pages.setdefault((r["shard"], r["page"]), []).append(r)
    assert len(rows) == 1002
    for p in pages.values():
        total = sum(r["n_bytes"] for r in p)
        assert total == p[0]["shard_bytes"] and len(p) == p[0]["shard_rows"] and (total <= 34_000 or len(p) == 1)
    hot = [p for p in pages.values() if any(r["key"] == 7 for r in p) and p[0]["local_depth"] == 60]
    assert sum(len(p) for p in hot) == 336 and sum(sum(r["n_bytes"] for r in p) for p in hot) / len(hot) > 10_000


def test_edge_cases(spark, tmp_path):
    folder = edge.save(spark, edge.ROWS, tmp_path)
    parity.same(sharding.op7(spark, folder), sharding.OP7_SQL, views={"documents": f"{folder}/documents.parquet/*.parquet"})
    assert sharding.op7(spark, edge.save(spark, [], tmp_path / "e")).count() == 0
    df = edge.clashing(spark)
    out = sharding.shard(df, "doc_id", common.octets(F.col("text")), 100_000)
    assert out.columns == [*df.columns, "shard_", "local_depth", "page_", "shard_bytes", "shard_rows"] and out.count() == df.count()
    zero = sharding.shard(spark.createDataFrame([(1,), (1,), (2,)], "key long"), "key", F.lit(None).cast("long"), 1)
    assert [r["shard"] for r in zero.collect()] == ["", "", ""]
    with pytest.raises(ValueError, match="positive"):
        sharding.shard(df, "doc_id", F.lit(1), 0)


def test_written_shards(spark, tmp_path):
    out = sharding.shard(sized(spark, parity.SF), "doc_id", F.col("n_bytes"), 100_000)
    sharding.write(out, str(tmp_path / "w"))
    files = [f for _, _, names in os.walk(tmp_path / "w") for f in names if f.endswith(".parquet")]
    assert len(files) == out.select("shard", "page").distinct().count() > 3


def test_no_python_on_the_main_path(spark):
    plan = sharding.shard(sized(spark), "doc_id", F.col("n_bytes"), 40_000)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
