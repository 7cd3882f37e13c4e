"""Retention and recovery.

Edge cases: rows with a null primary_index or address don't survive; repeated rows stay each; an empty index gives empty results;
other columns are carried along by ``retained`` and ``recovered``, whose join column is named so that it clashes with none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import prefix
from tidemark.schema import SHARDS, shard_of


def retained(df: DataFrame, cutoff: int) -> DataFrame:
    """Records or index rows from the cutoff on; the cutoff is in units of primary_index."""
    return df.where(F.col("primary_index") >= cutoff)


def truncation_points(index: DataFrame, cutoff: int, shards: int = SHARDS) -> DataFrame:
    """The first address that must stay in each shard; shards without survivors have no row and stay whole."""
    return retained(index, cutoff).groupBy(shard_of(F.col("secondary_index"), shards).alias("shard")).agg(F.min("addr").alias("truncate_until"))


def floor_reindex(index: DataFrame, cutoff: int, shards: int = SHARDS) -> DataFrame:
    """Index rows to add at the cutoff: one for each surviving key that begins after its shard does, unless it has one there."""
    begin = truncation_points(index, cutoff, shards)
    keys = retained(index, cutoff).groupBy("secondary_index").agg(F.min("addr").alias("ma")).withColumn("shard", shard_of(F.col("secondary_index"), shards))
    there = index.where(F.col("primary_index") == cutoff).select("secondary_index")
    # One row for each shard, of which there is a fixed number.
    new = keys.join(F.broadcast(begin), "shard").where("ma > truncate_until").join(there, "secondary_index", "left_anti")
    return new.select("secondary_index", F.lit(cutoff).cast("long").alias("primary_index"), F.col("truncate_until").alias("addr"))


def recovered(index: DataFrame, bounds: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Index rows whose address lies within [begin, tail) of their shard; bounds: (shard, begin, tail)."""
    names = prefix.fresh(index, "shard", "begin", "tail")
    side = bounds.select(*[F.col(c).alias(n) for c, n in zip(("shard", "begin", "tail"), names, strict=True)])
    on = (shard_of(F.col("secondary_index"), shards) == F.col(names[0])) & (F.col("addr") >= F.col(names[1])) & (F.col("addr") < F.col(names[2]))
    return index.join(side, on).select(*index.columns)
