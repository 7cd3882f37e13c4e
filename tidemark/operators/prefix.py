"""Running values over long groups, in two levels.

A window over a key sorts all of the key's rows in one task. Here the order is cut into buckets of a fixed span: a
value for each bucket comes from a partial aggregation, values of the buckets before it from a window over
buckets, and only the rows of one bucket are sorted together. A hot key is then many small groups. Without keys there are
three levels, so that not even the buckets of a long order meet in one window.

Edge cases: keys and the first order column are not null by the record's schema; the value of a row where one is null covers its
own bucket only. Rows that tie in all order columns run in no stated order; an empty frame gives an empty one; columns of df
whose names a value has are replaced, other names never clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a keyless order that one window sorts.
MANY = 4_096


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running(df: DataFrame, keys: list[str], order: list[str], span: int, values: dict[str, tuple[Column, Callable, Callable]], inclusive: bool = True) -> DataFrame:
    """df with a running value for each name in values: (input, aggregate of rows, how two values combine; null is none).

    order: columns in which rows run; the first is a long that is cut into buckets of span. inclusive: the row itself counts.
    """
    b, *so_far = fresh(df, "bucket", *[f"{name}_before" for name in values])
    parts = df.withColumn(b, F.expr(f"`{order[0]}` div {span} - if(`{order[0]}` % {span} < 0, 1, 0)"))
    sums = parts.groupBy(*keys, b).agg(*[agg(x).alias(name) for name, (x, agg, _) in values.items()])
    if keys:
        before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(*keys, b, *[agg(F.col(name)).over(before).alias(to) for to, (name, (_, agg, _)) in zip(so_far, values.items(), strict=True)])
    else:
        high, *more = fresh(sums, "high", *[f"{name}_high" for name in values])
        sums = sums.withColumn(high, F.floor(F.col(b) / MANY))
        before = Window.partitionBy(F.lit(0)).orderBy(high).rowsBetween(Window.unboundedPreceding, -1)
        tops = sums.groupBy(high).agg(*[agg(F.col(name)).alias(name) for name, (_, agg, _) in values.items()])
        tops = tops.select(high, *[agg(F.col(name)).over(before).alias(to) for to, (name, (_, agg, _)) in zip(more, values.items(), strict=True)])
        inner = Window.partitionBy(high).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        low = sums.select(high, b, *[agg(F.col(name)).over(inner).alias(name) for name, (_, agg, _) in values.items()])
        low = low.join(tops, high, "left")
        base = low.select(b, *[combine(F.col(top), F.col(name)).alias(to) for to, top, (name, (_, _, combine)) in zip(so_far, more, values.items(), strict=True)])
    within = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = parts.withColumns({name: agg(x).over(within) for name, (x, agg, _) in values.items()})
    out = out.join(base, [*keys, b], "left")
    both = {name: combine(F.col(to), F.col(name)) for to, (name, (_, _, combine)) in zip(so_far, values.items(), strict=True)}
    return out.withColumns(both).drop(b, *so_far)


def add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)  # nulls are passed over


def latest(a: Column, b: Column) -> Column:
    return F.coalesce(b, a)
