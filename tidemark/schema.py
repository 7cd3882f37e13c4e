"""The record envelope and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A record: ordered key, grouping key, schema tag 0..65535, opaque bytes, and its place in the order of arrival.
ENVELOPE = T.StructType(
    [
        T.StructField("primary_index", T.LongType(), False),
        T.StructField("secondary_index", T.IntegerType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("payload", T.BinaryType(), False),
        T.StructField("arrival_seq", T.LongType(), False),
    ]
)
MAX_PAYLOAD = 65_535
MAX_VERSION = 65_535
SHARDS = 4


def shard_of(secondary_index: Column, shards: int = SHARDS) -> Column:
    """The shard of a key: its low bits, so that negative keys have one too. shards: a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    return secondary_index.bitwiseAND(F.lit(shards - 1))


def acceptable(payload: Column, version: Column | None = None, limit: int = MAX_PAYLOAD) -> Column:
    """True for records that can be stored: the payload within the limit, the version within two bytes."""
    ok = F.coalesce(F.octet_length(payload) <= limit, F.lit(False))
    return ok if version is None else ok & F.coalesce(version.between(0, MAX_VERSION), F.lit(False))


def quarantined(df: DataFrame, payload: str = "payload", limit: int = MAX_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows; checked before routing, so a rejected record never raises a key's maximum."""
    ok = acceptable(F.col(payload), F.col("version") if "version" in df.columns else None, limit)
    return df.where(ok), df.where(~ok)
