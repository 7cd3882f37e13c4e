"""Ingest: where a record goes, by how far it lies behind the newest of its key.

Records at or above their key's running maximum are ``normal``; up to ``jitter`` behind it ``jitter``; further behind,
``dropped`` if below the retention floor, else ``late``. Late records are kept and merged on read.

Edge cases: keys aren't null by the record's schema (one that is is routed among its neighbours in arrival only); a record with a null primary_index is late and raises no maximum; repeated records are routed each;
an empty stream gives an empty result; columns named max_pi, route or route_rank are replaced, others carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import prefix

ROUTES = ("normal", "jitter", "late", "dropped")


def running_max(stream: DataFrame, span: int, tops: DataFrame | None = None) -> DataFrame:
    """stream with max_pi: the largest primary_index of the key up to and with the record, by arrival. tops: (secondary_index, top), what keys had reached before."""
    out = prefix.running(stream, ["secondary_index"], ["arrival_seq"], span, {"max_pi": (F.col("primary_index"), F.max, prefix.largest)})
    if tops is None:
        return out
    (top,) = prefix.fresh(out, "top")
    known = tops.select("secondary_index", F.col("top").alias(top))
    return out.join(known, "secondary_index", "left").withColumn("max_pi", F.greatest("max_pi", top)).drop(top)


def tops(stream: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(secondary_index, top): the largest primary_index that each key has reached in stream, and before."""
    own = stream.select("secondary_index", F.col("primary_index").alias("top"))
    return (own if before is None else own.unionByName(before)).groupBy("secondary_index").agg(F.max("top").alias("top"))


def route_of(primary_index: Column, max_pi: Column, jitter: int = 0, floor: int | None = None) -> Column:
    behind = F.try_subtract(max_pi, F.lit(jitter))  # null if it overflows: then nothing is too far behind
    out = F.when(primary_index >= max_pi, "normal")
    if jitter > 0:
        out = out.when((behind.isNull() & primary_index.isNotNull()) | (primary_index >= behind), "jitter")
    if floor is not None:
        out = out.when(primary_index < floor, "dropped")
    return out.otherwise("late")


def route(stream: DataFrame, span: int, jitter: int = 0, floor: int | None = None, tops: DataFrame | None = None) -> DataFrame:
    """stream with max_pi and route; tops: as in running_max."""
    return running_max(stream, span, tops).withColumn("route", route_of(F.col("primary_index"), F.col("max_pi"), jitter, floor))


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("secondary_index", "route").agg(F.count(F.lit(1)).alias("c"))


def ingest_stats(routed: DataFrame, depths: list[int] = ()) -> DataFrame:
    """One row of counters. depths: of the queue at each batch, in order. Writes are synchronous, so nothing is pending after one and no index row is lost."""
    n = lambda r: F.coalesce(F.sum((F.col("route") == r).cast("long")), F.lit(0))
    level, ups, downs = level_changes(depths)
    own = {"scale_ups": ups, "scale_downs": downs, "dropped_index_rows": 0, "pending_index_rows": 0}
    return routed.agg(
        n("late").alias("late_arrivals"), n("jitter").alias("jitter_absorbed"), n("dropped").alias("dropped_late_arrivals"),
        F.lit(level).alias("adaptive_level"), *[F.lit(v).cast("long").alias(k) for k, v in own.items()],
    )


def live(routed: DataFrame) -> DataFrame:
    """Records that reads see, with route_rank: at equal primary indexes, late ones come last."""
    return routed.where("route <> 'dropped'").withColumn("route_rank", (F.col("route") == "late").cast("int"))


def logged(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("route").isin("normal", "jitter"))


def late(routed: DataFrame) -> DataFrame:
    return routed.where("route = 'late'")


#: (spacing of index rows, size of a flush batch) by level.
LEVELS = tuple((16 << i, 8 << i) for i in range(9))


def _steps(depths: list[int], start: int, high: int, low: int, rest: int) -> list[tuple[int, int]]:
    """The level after each batch, and the step that was asked for at it."""
    level, since, out = max(0, min(start, len(LEVELS) - 1)), 0, []
    for d in depths:
        since += 1
        step = (int(d > high) - int(d < low)) if since >= rest else 0
        if step:
            level, since = max(0, min(len(LEVELS) - 1, level + step)), 0
        out.append((level, step))
    return out


def adaptive_levels(depths: list[int], start: int = 6, high: int = 1024, low: int = 512, rest: int = 5) -> list[int]:
    """The level after each batch, given the queue's depth at it: a level up above ``high``, one down below ``low``, within
    the levels there are; after each such step ``rest`` batches pass before the next."""
    return [level for level, _ in _steps(depths, start, high, low, rest)]


def level_changes(depths: list[int], start: int = 6, high: int = 1024, low: int = 512, rest: int = 5) -> tuple[int, int, int]:
    """The last level, and how often a step up and one down was asked for, those at the last level included."""
    steps = _steps(depths, start, high, low, rest)
    return (steps[-1][0] if steps else start), sum(s > 0 for _, s in steps), sum(s < 0 for _, s in steps)
