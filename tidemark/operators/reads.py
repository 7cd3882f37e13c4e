"""Reads. Ranges are inclusive at both ends; a limit of 0 or less is none, else it holds for each key.

Records of a key are in the order of primary_index, logged before late, then by arrival. All reads take live records
(routing.live), from a frame or from a Store that prunes by keys and range, so late records are merged by construction.

Frames have no order of their own. ``ordered`` sorts a result; ``positioned`` numbers each key's records instead, in two
levels, so that the order outlives whatever is done next.

Edge cases: records with a null primary_index are in no range, and come first where a read has no bounds; a null key
belongs to reads of all keys only; repeated records are returned each; an empty frame gives an empty result (one row with null from earliest);
other columns are carried along, but one named ``position`` is replaced where positions are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.operators import prefix

ORDER = ("primary_index", "route_rank", "arrival_seq")
#: Keys listed in a filter; more of them are a semi-join.
LISTED = 1_000
#: Primary indexes that are sorted at once where positions are given.
SPAN = 256
_LARGEST = (1 << 63) - 1


def of_keys(df: DataFrame, keys: Iterable[int] | DataFrame | None) -> DataFrame:
    """Rows of the keys given; all if None."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias("secondary_index")).distinct(), "secondary_index", "left_semi")
    keys = sorted(set(keys))
    if len(keys) <= LISTED:
        return df.where(F.col("secondary_index").isin(keys))
    return of_keys(df, df.sparkSession.createDataFrame([(k,) for k in keys], "secondary_index int"))


def _here(df: DataFrame, order: tuple[str, ...]) -> list[str]:
    return [c for c in order if c in df.columns]


def ordered(df: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """df sorted by key, and a key's records in order: a range shuffle, no task holds all."""
    return df.orderBy("secondary_index", *_here(df, order))


def positioned(df: DataFrame, order: tuple[str, ...] = ORDER, span: int = SPAN) -> DataFrame:
    """df with ``position``, the number of each record among those of its key, from 1."""
    return prefix.running(df, ["secondary_index"], _here(df, order), span, {"position": (F.lit(1).cast("long"), F.sum, prefix.add)})


def first_of_each(df: DataFrame, limit: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first ``limit`` rows of each key, with their position; Spark keeps as many in each task before it shuffles. Without a limit df as it is."""
    if limit <= 0:
        return df
    n = F.row_number().over(Window.partitionBy("secondary_index").orderBy(*_here(df, order)))
    return df.withColumn("position", n.cast("long")).where(F.col("position") <= limit)


def read_range(df: DataFrame, start: int, end: int, keys: int | Iterable[int] | DataFrame | None = None, limit: int = 0) -> DataFrame:
    """One key, several, or all, as a flat frame."""
    keys = [keys] if isinstance(keys, int) else keys
    return first_of_each(of_keys(df.where(F.col("primary_index").between(start, end)), keys), limit)


def with_empty_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each key asked for, also if it has no record: its other columns are null then."""
    return keys.select(F.col(keys.columns[0]).alias("secondary_index")).distinct().join(df, "secondary_index", "left")


def nested(df: DataFrame) -> DataFrame:
    """One row for each key with its records as a sorted array; for results that are known to be short, such as limited ones."""
    rest = [c for c in df.columns if c != "secondary_index" and c not in ORDER]
    return df.groupBy("secondary_index").agg(F.array_sort(F.collect_list(F.struct(*_here(df, ORDER), *rest))).alias("records"))


def read_range_pooled(df: DataFrame, key: int, start: int, end: int, handler: Callable[[Row], bool], window: int = 64) -> int:
    """Calls handler with each record in order until it returns False; says how many calls it made.

    The range is fetched in windows, each twice as long as the one before, so that a handler that stops early leaves the rest unread.
    The first begins at the key's first record in the range.
    """
    calls, at = 0, earliest(df.where(F.col("primary_index") <= end), [key], start).first()[0]
    while at is not None and at <= end:
        stop = min(end, at + window - 1)
        for row in read_range(df, at, stop, key).orderBy(*_here(df, ORDER)).toLocalIterator():
            calls += 1
            if handler(row) is False:
                return calls
        at, window = stop + 1, 2 * window
    return calls


def earliest(df: DataFrame, keys: Iterable[int] | DataFrame | None, start: int) -> DataFrame:
    """One row: the least primary_index from start on, or null."""
    return of_keys(df.where(F.col("primary_index") >= start), keys).agg(F.min("primary_index").alias("earliest"))


def _end(first: Column, window: int) -> Column:
    return F.coalesce(F.try_add(first, F.lit(window)), F.lit(_LARGEST))


def read_from_available(df: DataFrame, keys: Iterable[int] | DataFrame | None, start: int, window: int, limit: int = 0) -> DataFrame:
    """The records of a window from the earliest available one on, with range_end; no row if there is none.

    The window's end stops at the largest long. The earliest is asked for first, so that the scan is given both bounds.
    """
    first = earliest(df, keys, start).first()[0]
    if first is None:
        return read_range(df, 1, 0, keys, limit).withColumn("range_end", F.lit(None).cast("long"))
    end = min(_LARGEST, first + window)
    return read_range(df, first, end, keys, limit).withColumn("range_end", F.lit(end).cast("long"))


def range_end(df: DataFrame, keys: Iterable[int] | DataFrame | None, start: int, window: int) -> DataFrame:
    """One row: where the window of read_from_available ends, -1 if there is no record."""
    e = F.col("earliest")
    return earliest(df, keys, start).select(F.when(e.isNull(), F.lit(-1)).otherwise(_end(e, window)).cast("long").alias("range_end"))


def read_latest(df: DataFrame) -> DataFrame:
    """The record with the largest primary_index of each key; logged before late, then the last to arrive."""
    best = F.max_by(F.struct(*[c for c in df.columns if c != "secondary_index"]), F.struct(F.col("primary_index"), -F.col("route_rank"), F.col("arrival_seq")))
    return df.groupBy("secondary_index").agg(best.alias("record")).select("secondary_index", "record.*")


def distinct_keys(df: DataFrame) -> DataFrame:
    return df.select("secondary_index").distinct()


def merged(log: DataFrame, late: DataFrame, limit: int = 0) -> DataFrame:
    """Logged and late records together, each with its rank and its position in the merged order of its key; with a limit, the first of each key."""
    columns = [c for c in log.columns if c != "route_rank"]
    both = log.select(*columns, F.lit(0).alias("route_rank")).unionByName(late.select(*columns, F.lit(1).alias("route_rank")))
    return first_of_each(both, limit) if limit > 0 else positioned(both)
