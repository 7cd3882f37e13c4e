"""Reads of late records alone (routing.late): by primary_index, then arrival. Edge cases are those of ``reads``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import reads

ORDER = ("primary_index", "arrival_seq")


def late_range(late: DataFrame, start: int, end: int, keys: int | Iterable[int] | None = None, limit: int = 0) -> DataFrame:
    keys = [keys] if isinstance(keys, int) else keys
    return reads.first_of_each(reads.of_keys(late.where(F.col("primary_index").between(start, end)), keys), limit, ORDER)


def late_first(late: DataFrame, keys: Iterable[int], limit: int) -> DataFrame:
    return reads.first_of_each(reads.of_keys(late, keys), limit, ORDER)


def late_earliest(late: DataFrame, keys: Iterable[int], start: int) -> DataFrame:
    return reads.earliest(late, keys, start)


def late_latest(late: DataFrame) -> DataFrame:
    """All records at the largest primary_index of their key: ties give several."""
    top = late.groupBy("secondary_index").agg(F.max("primary_index").alias("primary_index"))
    return late.join(top, ["secondary_index", "primary_index"], "left_semi")


def late_purge(late: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Records that stay, and one row with their number."""
    stay = late.where(F.col("primary_index") >= cutoff)
    return stay, stay.agg(F.count(F.lit(1)).alias("remaining"))
