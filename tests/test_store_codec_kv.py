"""The store, the codecs and the key-value surface."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import kv
from tidemark.schema import ENVELOPE
from tidemark.sources.store import Store


def records(spark, values, key=1):
    return spark.createDataFrame([(v, key, 1, bytearray(b"x" * (v % 5)), v) for v in values], ENVELOPE)


def test_store_appends_and_reads(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        s.append(records(spark, range(100, 110)))
        s.append(records(spark, range(200, 210), -2), "b", 1)
        s.append(records(spark, range(200, 210), -2), "b", 1)
        s.append(records(spark, range(200, 210), -2), "b", 0)
        assert s.read().count() == 20 and s.read(None, 105, 204).count() == 10
        assert s.read(1).count() == 10 and s.read([-2, 1], 205).count() == 5 and s.read(spark.createDataFrame([(-2,), (7,)], "k int")).count() == 10
        assert len(s.read(None, 150).inputFiles()) < len(s.read().inputFiles())
        assert s.versions() == [1, 2]
    with pytest.raises(RuntimeError, match="closed"):
        s.read()
    with pytest.raises(RuntimeError, match="closed"):
        s.append(records(spark, [1]))
    s.close()
    assert Store(spark, str(tmp_path / "s")).read().count() == 20


def test_store_retention(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for part in (range(0, 10), range(5, 25), range(30, 40)):
        s.append(records(spark, part))
    assert s.retain(20) == 10 + 15
    assert sorted(r["primary_index"] for r in s.read().collect()) == [*range(20, 25), *range(30, 40)]
    assert s.retain(20) == 0
    s.vacuum()
    assert len(os.listdir(tmp_path / "s/data")) == 2 and len([f for f in os.listdir(tmp_path / "s/manifest") if f.endswith(".json")]) == 1
    assert s.read().count() == 15 and s.retain(1000) == 15 and s.read().count() == 0


def test_a_broken_write_leaves_no_trace(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append(records(spark, range(5)))
    with pytest.raises(Exception, match="broken"):
        s.append(records(spark, range(5)).withColumn("payload", F.when(F.col("primary_index") > 2, F.raise_error(F.lit("broken"))).otherwise(F.col("payload"))))
    assert s.read().count() == 5


def manifest(folder, n):
    return f"{folder}/s/manifest/{n:012d}.json"


def test_a_cut_manifest_leaves_the_version_before(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append(records(spark, range(5)))
    s.append(records(spark, range(5, 8)))
    for text in ('{"parts": [', ""):
        with open(manifest(tmp_path, 2), "w") as f:
            f.write(text)
        os.path.exists(f"{tmp_path}/s/manifest/.{2:012d}.json.crc") and os.remove(f"{tmp_path}/s/manifest/.{2:012d}.json.crc")
        assert s.read().count() == 5
    s.append(records(spark, range(8, 12)))
    assert s.versions() == [1, 2, 3] and s.read().count() == 9


def test_a_version_is_never_written_over(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    s.append(records(spark, range(5)))
    monkeypatch.setattr(Store, "versions", lambda self: [])
    with pytest.raises(Exception, match="exists"):
        s.append(records(spark, range(5)))
    monkeypatch.undo()
    assert s.versions() == [1] and s.read().count() == 5


def test_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for k in range(5):
        s.append(records(spark, range(10 * k, 10 * k + 10)), "live", k)
    assert s.compact() == 5 and s.compact() == 0 and len(s._manifest()["parts"]) == 1
    s.append(records(spark, range(10)), "live", 4)
    assert sorted(r["primary_index"] for r in s.read().collect()) == list(range(50)) and s._manifest()["streams"] == {"live": 4}


def test_files_are_sorted_by_key_and_range(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    df = records(spark, range(300)).withColumn("secondary_index", (F.col("primary_index") % 7).cast("int"))
    s.append(df.orderBy(F.rand(1)))
    rows = spark.read.parquet(f"{tmp_path}/s/data").select("secondary_index", "primary_index", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
    by = {}
    for r in rows:
        by.setdefault(r["f"], []).append((r["secondary_index"], r["primary_index"]))
    assert all(x == sorted(x) for x in by.values()) and sum(map(len, by.values())) == 300


def test_payload_bytes_survive(spark, tmp_path):
    s, noise = Store(spark, str(tmp_path / "s")), os.urandom(1024)
    s.append(spark.createDataFrame([(100, 1, 1, bytearray(noise), 0), (101, 1, 1, bytearray(), 1)], ENVELOPE))
    assert [bytes(r["payload"]) for r in s.read().orderBy("primary_index").collect()] == [noise, b""]


def test_codec(spark):
    registry = codec.VersionRegistry().register(1, [("value", "f4"), ("counter", "i4")])
    data = [(1, bytearray(struct.pack("<fi", 1.5, -7))), (1, bytearray(struct.pack("<fi", -2.25, 9) + b"tail"))]
    df = spark.createDataFrame(data, "version int, payload binary")
    assert [(r["value"], r["counter"]) for r in registry.decode(df, 1).select("decoded.*").collect()] == [(1.5, -7), (-2.25, 9)]
    mixed = spark.createDataFrame([(1, bytearray(8)), (1, bytearray(2)), (99, bytearray(8)), (1, None)], "version int, payload binary")
    assert [r[0] for r in mixed.select(registry.can_decode(F.col("version"), F.octet_length("payload"))).collect()] == [True, False, False, False]
    with pytest.raises(KeyError):
        registry.decode(df, 99)
    with pytest.raises(Exception, match="at least"):
        registry.decode(mixed, 1).collect()


@pytest.mark.parametrize("fields", [(-999, 0, 1, 0), ((1 << 63) - 1, (1 << 31) - 1, 65_535, 65_535), (-(1 << 63), -(1 << 31), 0, 8), (1 << 40, -1, 258, 513)])
def test_header(spark, fields):
    df = spark.createDataFrame([fields], "a long, b int, c int, d int")
    raw = df.select(codec.encode_header(*[F.col(c) for c in "abcd"]).alias("h"))
    assert bytes(raw.first()["h"]) == struct.pack("<qiHH", *fields)
    assert tuple(raw.select(*codec.decode_header(F.col("h")).values()).first()) == fields


def pairs(spark, keys):
    return spark.createDataFrame([(k, k * 100, False) for k in keys], "k long, v long, deleted boolean")


def test_kv(spark):
    t = pairs(spark, range(1, 21))
    assert [(r["k"], r["v"]) for r in kv.scan(t, 5, 10).orderBy("k").collect()] == [(k, 100 * k) for k in range(5, 11)]
    gone = kv.delete(t, spark.createDataFrame([(5,), (10,), (15,), (15,), (99,)], "k long"))
    assert kv.scan(gone, 1, 20).count() == 17 and kv.get(gone, 10).count() == 0 and kv.get(gone, 11).first()["v"] == 1100
    assert kv.there(kv.delete(gone, spark.createDataFrame([(5,)], "k long"))).count() == 17
    hundred = pairs(spark, range(1, 101))
    assert kv.truncate(hundred, 51).count() == 50 and kv.stats(hundred, 64).count() == 2


def test_kv_keys_must_ascend(spark):
    t = pairs(spark, [1, 2, 3])

    def puts(*keys):
        return spark.createDataFrame([(i, k, 7) for i, k in enumerate(keys)], "at long, k long, v long")

    for span in (2, 100):
        assert sorted(r["k"] for r in kv.put(t, puts(4, 5, 9), "at", span).collect()) == [1, 2, 3, 4, 5, 9]
        assert kv.put(t.limit(0), puts(-5, 0), "at", span).count() == 2 and kv.put(t, puts(), "at", span).count() == 3
        for bad in ([3], [4, 5, 5], [9, 4], [4, None]):
            with pytest.raises(Exception, match="ascend"):
                kv.put(t, puts(*bad), "at", span).collect()
        assert kv.out_of_order(puts(1, 5, 3, 5, 6), "at", span).first()[0] == 2


def test_kv_puts_that_tie_run_by_key(spark):
    """Whatever the order of rows and parts, the count is that of ascending keys."""
    rows = [(at, k, 7) for k in range(40, 0, -1) for at in (k % 3,)]
    for data in (rows, rows[::-1], rows[1::2] + rows[::2]):
        puts = spark.createDataFrame(data, "at long, k long, v long")
        for span in (1, 100):
            assert kv.out_of_order(puts.coalesce(1), "at", span).first()[0] == kv.out_of_order(puts.repartition(5), "at", span).first()[0] == 26
    same = spark.createDataFrame([(0, 6, 7), (0, 5, 7), (0, 4, 7)], "at long, k long, v long")
    assert [r["k"] for r in kv.put(pairs(spark, [1]), same, "at").orderBy("k").collect()] == [1, 4, 5, 6]


def test_kv_order(spark):
    t = kv.delete(pairs(spark, [30, 10, 20, 40]), spark.createDataFrame([(20,)], "k long"))
    assert [r["k"] for r in kv.scan(t, 10, 40).collect()] == [10, 30, 40]
    assert {r["k"]: r["position"] for r in kv.positioned(kv.scan(t, 0, 99), 15).collect()} == {10: 1, 30: 2, 40: 3}
    odd = spark.createDataFrame([(None, 1, False), (2, None, None)], "k long, v long, deleted boolean")
    assert kv.there(odd).count() == 2 and kv.scan(odd, 0, 9).count() == 1 and kv.stats(odd).count() == 2
