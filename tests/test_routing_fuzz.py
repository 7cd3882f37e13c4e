"""Routing in two levels, and live, against a sequential router."""

import random

import pytest
from pyspark.sql import functions as F

from tests import parity
from tidemark.operators import routing
from tidemark.plans.queries import oracle_sql, queries
from tidemark.sources.store import Store
from tidemark.streaming import router

COLUMNS = "event_id long, secondary_index int, primary_index long, version int, value double, arrival_seq long"


def sequential(rows, jitter, floor):
    top, out = {}, {}
    for event, key, pi, *_, _ in sorted(rows, key=lambda r: r[5]):
        top[key] = max(top.get(key, pi), pi)
        if pi >= top[key]:
            out[event] = "normal"
        elif jitter > 0 and pi >= top[key] - jitter:
            out[event] = "jitter"
        else:
            out[event] = "dropped" if pi < floor else "late"
    return out


def make(seed, n=400):
    r = random.Random(seed)
    arrivals = r.sample(range(-1000, 3000), n)
    return [(i, r.choice([1, 1, 1, 2, -3]), r.randint(0, 300) + a // 10, 1, 0.5, a) for i, a in enumerate(arrivals)]


@pytest.mark.parametrize("seed", range(4))
def test_batch(spark, seed):
    rows = make(seed)
    df = spark.createDataFrame(rows, COLUMNS)
    for span, jitter in ((7, 30), (100_000, 0)):
        got = {r["event_id"]: r["route"] for r in routing.route(df, span, jitter, 50).collect()}
        assert got == sequential(rows, jitter, 50)


def test_stream_in_several_batches(spark, tmp_path):
    rows = sorted(make(9), key=lambda r: r[5])
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k * 134 : (k + 1) * 134], COLUMNS).coalesce(1).write.mode("append").parquet(source)
        live = router.files_as_stream(spark, source, spark.read.parquet(source).schema)
        router.run_into(router.route_stream(live, 30, 50), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r["event_id"]: r["route"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == sequential(rows, 30, 50)


def test_into_a_store(spark, tmp_path):
    """Micro-batches of one file each are appended once, and now and then compacted."""
    rows, source = sorted(make(5), key=lambda r: r[5]), str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], COLUMNS).coalesce(1).write.mode("append").parquet(source)
    store = Store(spark, str(tmp_path / "store"))
    live = router.files_as_stream(spark, source, spark.read.parquet(source).schema, 1)
    query = router.into_store(router.route_stream(live, 30, 50), store, str(tmp_path / "checkpoint"), 2, availableNow=True)
    query.awaitTermination()
    assert {r["event_id"]: r["route"] for r in store.read().collect()} == sequential(rows, 30, 50)
    assert len(store._manifest()["parts"]) < 4 and store._manifest()["streams"] == {str(tmp_path / "checkpoint"): 3}


@pytest.mark.parametrize("span", [7, 100_000])
def test_routing_into_a_store(spark, tmp_path, span):
    """Micro-batches against the sequential router, with a restart, and a batch that runs a second time."""
    rows, source = sorted(make(6), key=lambda r: r[5]), str(tmp_path / "in")
    store, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    want = {k: v for k, v in sequential(rows, 30, 50).items() if v != "dropped"}
    for half in (rows[:200], rows[200:]):
        for k in (0, 100):
            spark.createDataFrame(half[k : k + 100], COLUMNS).coalesce(1).write.mode("append").parquet(source)
        live = router.files_as_stream(spark, source, spark.read.parquet(source).schema, 1)
        router.route_into(live, store, checkpoint, span, 30, 50, availableNow=True).awaitTermination()
    assert {r["event_id"]: r["route"] for r in store.read().collect()} == want
    (tmp_path / "checkpoint/query/commits/3").unlink()
    (tmp_path / "checkpoint/query/commits/.3.crc").unlink(missing_ok=True)
    live = router.files_as_stream(spark, source, spark.read.parquet(source).schema, 1)
    router.route_into(live, store, checkpoint, span, 30, 50, availableNow=True).awaitTermination()
    assert {r["event_id"]: r["route"] for r in store.read().collect()} == want and store.read().count() == len(want)


@pytest.mark.parametrize("span", [7, 100_000])
def test_routing_into_files(spark, tmp_path, span):
    """All routes, dropped ones too, with a restart, and a batch that runs a second time; no state by key that Python keeps."""
    rows = sorted([*make(7), (1000, 1, None, 1, 0.5, 5000), (1001, 9, None, 1, 0.5, 5001)], key=lambda r: r[5])
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    want = sequential([r for r in rows if r[2] is not None], 30, 50) | {1000: "late", 1001: "late"}

    def run():
        live = router.files_as_stream(spark, source, spark.read.parquet(source).schema, 1)
        query = router.route_into_files(live, out, checkpoint, span, 30, 50, availableNow=True)
        query.awaitTermination()
        assert not any(p["stateOperators"] for p in query.recentProgress)
        return router.read_routed(spark, out, live.schema)

    for half in (rows[:200], rows[200:]):
        for k in (0, 100, 200):
            spark.createDataFrame(half[k : k + 100], COLUMNS).coalesce(1).write.mode("append").parquet(source)
        got = run()
    assert {r["event_id"]: r["route"] for r in got.collect()} == want and got.count() == len(want)
    assert set(want.values()) == {"normal", "jitter", "late", "dropped"}
    (tmp_path / "checkpoint/query/commits/5").unlink()
    (tmp_path / "checkpoint/query/commits/.5.crc").unlink(missing_ok=True)
    got = run()
    assert {r["event_id"]: r["route"] for r in got.collect()} == want and got.count() == len(want)


def test_a_stream_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    live = router.files_as_stream(spark, str(tmp_path / "in"), COLUMNS)
    router.route_into_files(live, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 7, 30, 50, availableNow=True).awaitTermination()
    assert router.read_routed(spark, str(tmp_path / "out"), live.schema).count() == 0


def test_the_stream_query_routes_events_without_a_time(spark, tmp_path):
    events = spark.read.parquet(f"{parity.SF}/events.parquet")
    odd = events.withColumn("ts", F.when(F.col("event_id") % 50 != 7, F.col("ts")))
    odd.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    df = queries()["stream_route_events"](spark, str(tmp_path))
    assert parity.same(df, oracle_sql()["stream_route_events"], views={"events": str(tmp_path / "events.parquet/*.parquet")}) == events.count()
