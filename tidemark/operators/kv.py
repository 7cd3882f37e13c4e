"""An ordered key-value surface over frames of (k, v, deleted).

Edge cases: a null key can't be put, and is found by no read; a null ``deleted`` counts as false; keys that were put before
the guard and repeat are returned each; puts that tie in their order arrive in the order of their keys, so that reruns agree; empty frames give empty results;
other columns of the table are carried along where puts have them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import prefix

#: Keys that are sorted at once where positions are given.
SPAN = 65_536


def _seen(puts: DataFrame, order: str, span: int, name: str) -> DataFrame:
    """puts with the largest key before each, in the order of ``order``, then of keys."""
    return prefix.running(puts, [], [order, "k"], span, {name: (F.col("k"), F.max, prefix.largest)}, inclusive=False)


def out_of_order(puts: DataFrame, order: str, span: int = SPAN) -> DataFrame:
    """One row: how many puts have a key not above all before them, in the order of ``order``."""
    (name,) = prefix.fresh(puts, "before")
    return _seen(puts, order, span, name).where(F.col("k") <= F.col(name)).agg(F.count(F.lit(1)).alias("out_of_order"))


def put(table: DataFrame, puts: DataFrame, order: str, span: int = SPAN) -> DataFrame:
    """table with more pairs, which arrive in the order of ``order``; each key must lie above the table's and all put before it, else the action fails."""
    before, top = prefix.fresh(puts, "before", "top")
    seen = _seen(puts, order, span, before).crossJoin(F.broadcast(table.agg(F.max("k").alias(top))))  # one row
    ok = F.col("k").isNotNull() & (F.col("k") > F.coalesce(F.greatest(before, top), F.col("k") - 1))
    checked = seen.withColumn("k", F.when(ok, F.col("k")).otherwise(F.raise_error(F.lit("keys must ascend"))))
    if "deleted" not in puts.columns:
        checked = checked.withColumn("deleted", F.lit(False))
    return table.unionByName(checked.select(*table.columns))


def _gone(deleted: Column) -> Column:
    return F.coalesce(deleted, F.lit(False))


def there(table: DataFrame) -> DataFrame:
    return table.where(~_gone(F.col("deleted")))


def get(table: DataFrame, key: int) -> DataFrame:
    return there(table).where(F.col("k") == key)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """table with the keys marked as deleted; keys that are missing or deleted change nothing."""
    key, gone = prefix.fresh(table, "gone_key", "gone")
    side = keys.select(F.col(keys.columns[0]).alias(key)).distinct().withColumn(gone, F.lit(True))
    marked = table.join(side, F.col("k") == F.col(key), "left").withColumn("deleted", _gone(F.col("deleted")) | _gone(F.col(gone)))
    return marked.select(*table.columns)


def scan(table: DataFrame, start: int, end: int) -> DataFrame:
    """Pairs from start to end, both included, in the order of their keys."""
    return there(table).where(F.col("k").between(start, end)).orderBy("k")


def positioned(pairs: DataFrame, span: int = SPAN) -> DataFrame:
    """pairs with ``position``, their number in the order of keys, from 1."""
    return prefix.running(pairs, [], ["k"], span, {"position": (F.lit(1).cast("long"), F.sum, prefix.add)})


def truncate(table: DataFrame, before: int) -> DataFrame:
    """Pairs whose key isn't below ``before``."""
    return there(table).where(F.col("k") >= before)


def stats(table: DataFrame, block: int = 1024) -> DataFrame:
    """Count and bounds of each block of keys."""
    return table.groupBy(F.expr(f"k div {block}").alias("block")).agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))
