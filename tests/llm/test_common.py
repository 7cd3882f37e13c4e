import os

import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from tidemark.llm import common


def test_shared_tables(spark):
    df = spark.range(10)
    a, b = common.materialize(df, "a"), common.materialize(df.where("id > 5"), "b")
    assert (a.count(), b.count()) == (10, 4) and a.schema.names == ["id"]
    common.discard(a)
    assert not os.path.exists(common._written[-2].removeprefix("file:"))
    assert common.cleanup(spark) >= 2 and common.cleanup(spark) == 0
    assert common.materialize(df.limit(0), "none").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_broadcast_is_by_count(spark):
    df = spark.range(20)
    plan = lambda n: df.join(common.small(df, n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(20) and "strategy=broadcast" not in plan(19)


def test_one_of_each(spark):
    rows = [(1, "b"), (1, "a"), (None, "z"), (None, "y"), (2, None)]
    got = common.one_of_each(spark.createDataFrame(rows, "k int, row string"), ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a"), (None, "y"), (2, None)], key=str)
    assert common.fresh(edge.clashing(spark), "size", "new", "new") == ["size_", "new", "new_"]
    assert spark.createDataFrame([("é",), (None,)], "t string").select(common.octets(F.col("t"))).collect()[0][0] == 2


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    folder = edge.save(spark, edge.ROWS, tmp_path)
    rows = common.table(spark, folder, "documents").collect()
    out = common.texts(spark, folder, "documents")
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(map(str, out.collect())) == sorted(map(str, rows))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    steady = common.texts(spark, folder, "documents", ("doc_id", "text"))
    assert "Sort" in plan(steady) and sorted(map(str, steady.collect())) == sorted(str(r) for r in common.table(spark, folder, "documents").select("doc_id", "text").collect())
    for narrow in (steady, out.select("doc_id", "text")):  # columns that aren't asked for are neither read nor dealt out
        read = narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
        assert read.startswith("struct<doc_id") and "text:string>" in read and "source" not in read.split("\n")[0]
    monkeypatch.setattr(common, "SPREAD", 1)
    assert common.texts(spark, folder, "documents").rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism


def test_broadcast_is_by_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "id long, t string")
    plan = lambda n: df.select("id").join(common.small(df, 100, n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(2_000) and "strategy=broadcast" not in plan(1_999)
