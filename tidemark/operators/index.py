"""The sparse index and as-of lookups in it. An address is a record's arrival_seq.

Edge cases: index rows with a null primary_index are never found, probes with one find nothing; repeated records are numbered each;
an empty log has an empty index, in which every probe finds null; columns beside the record's own aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import prefix
from tidemark.schema import SHARDS, shard_of


def sparse_index(log: DataFrame, span: int, spacing: int = 16) -> DataFrame:
    """The first and every spacing-th logged record of a key; of equal primary indexes the first stays."""
    log = log.select("secondary_index", "primary_index", "arrival_seq")
    nth = prefix.running(log, ["secondary_index"], ["arrival_seq"], span, {"n": (F.lit(1), F.sum, prefix.add)})
    return nth.where((F.col("n") == 1) | (F.col("n") % spacing == 0)).groupBy("secondary_index", "primary_index").agg(F.min("arrival_seq").alias("addr"))


def asof_backward(index: DataFrame, at: int) -> DataFrame:
    """The address of the largest primary_index up to ``at``, for each key that has one."""
    return index.where(F.col("primary_index") <= at).groupBy("secondary_index").agg(F.max_by("addr", "primary_index").alias("addr"))


def asof_forward(index: DataFrame, at: int) -> DataFrame:
    """The first primary_index from ``at`` on and its address, for each key that has one."""
    return index.where(F.col("primary_index") >= at).groupBy("secondary_index").agg(F.min("primary_index").alias("primary_index"), F.min_by("addr", "primary_index").alias("addr"))


def asof_join(probes: DataFrame, index: DataFrame, probe_id: str, span: int) -> DataFrame:
    """For each probe (probe_id, secondary_index, primary_index) the address that asof_backward would find, or null.

    Probes and index rows run through one order, in which an index row comes before probes of equal primary_index,
    and each probe takes the last index row before it. span: primary indexes of a bucket that is sorted at once.
    """
    p = probes.select(F.col(probe_id).alias("id"), "secondary_index", "primary_index", F.lit(1).alias("side"), F.lit(None).cast("long").alias("addr"))
    i = index.select(F.lit(None).cast(probes.schema[probe_id].dataType).alias("id"), "secondary_index", "primary_index", F.lit(0).alias("side"), "addr")
    place = F.struct("primary_index", "addr")
    both = p.unionByName(i).withColumn("x", F.when(F.col("side") == 0, place))
    found = prefix.running(both, ["secondary_index"], ["primary_index", "side"], span, {"last": (F.col("x"), F.max, prefix.largest)})
    return found.where("side = 1").select(F.col("id").alias(probe_id), F.col("last.addr").alias("addr"))


def shard_min_address(index: DataFrame, at: int, shards: int = SHARDS) -> DataFrame:
    return index.where(F.col("primary_index") <= at).groupBy(shard_of(F.col("secondary_index"), shards).alias("shard")).agg(F.min("addr").alias("addr"))
