"""Sharding by extendible hashing, with DataFrame operations only.

Rows are placed by 60 bits of a hash of their key. A directory indexed by the first bits of the hash leads to shards; a
shard of local depth d holds all rows whose hash begins with its d bits. Starting from one shard, only shards over
the byte limit are split on another bit, so each ends at the least depth at which it fits.

The splits aren't carried out one by one: bytes are summed in cells at a depth of about sixteen cells a shard, the sums are
added up along the bits to all lesser depths, and a cell's shard is the least depth that fits. Cells that are over
the limit themselves are cut by DEEPER more bits, and so on. A key whose own rows are over the limit can't be split by
any bit: its shard gets overflow pages, filled in the order of the rows by sums in two levels, so that no task ever
holds all rows of the key. A single row over the limit has a page to itself.

Edge cases: a null key is hashed like an empty text; a null size counts 0; repeated rows count each; an empty table gives
an empty result; other columns are carried along, and the new ones get underscores appended where the
names are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

BITS = 60
DEEPER = 12
#: Bytes of a shard, at most.
LIMIT = 64 << 20
#: The query's shards hold a SHARDS-th of the table at most, and may hold LEAST bytes, so that small tables have several as well.
SHARDS, LEAST = 64, 16 << 10
#: Rows of a hot key that one window sorts at once, at most.
GROUP_BITS = 12
COLUMNS = ("shard", "local_depth", "page", "shard_bytes", "shard_rows")


def place(key: Column) -> Column:
    """60 bits of the md5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _first_bits(x: Column, depth: int | Column) -> Column:
    return F.call_function("shiftright", x, F.lit(BITS) - depth) if isinstance(depth, Column) else F.shiftright(x, BITS - depth)


def _leaves(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """cells: (cell, bytes, rows) at a depth. (cell, leaf_depth, leaf, shard_bytes, shard_rows): the least depth over ``above``
    at which the cell's shard fits; null where the cell itself doesn't."""
    levels = F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("k")
    up = cells.select("cell", "bytes", "rows", levels).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - k)"))
    sums = up.groupBy("k", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")).where(F.col("shard_bytes") <= limit)
    # The merge hint: sizes of exploded rows are underestimated, so Spark might broadcast many of them.
    fits = up.select("cell", "k", "prefix").join(sums.hint("merge"), ["k", "prefix"])
    least = fits.groupBy("cell").agg(F.min_by(F.struct("k", "prefix", "shard_bytes", "shard_rows"), "k").alias("x"))
    return cells.select("cell").join(least, "cell", "left").select("cell", F.col("x.k").alias("leaf_depth"), F.col("x.prefix").alias("leaf"), "x.shard_bytes", "x.shard_rows")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """rows: (p, size, ...) of keys over the limit. Adds page, shard_bytes and shard_rows (those of the page).

    Rows over half the limit have a page each. The others go to the page of the half limit in which they begin, so a page
    holds less than half the limit and one row of at most half of it.
    """
    half = max(1, limit // 2)
    r = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "overflow")
    r = r.withColumn("big", F.col("size") > half).withColumn("sub", F.shiftright("row", GROUP_BITS))
    r = r.withColumn("one", F.when(F.col("big"), F.lit(1)).otherwise(F.lit(0)).cast("long")).withColumn("part", F.when(F.col("big"), F.lit(0)).otherwise(F.col("size")).cast("long"))
    sums = r.groupBy("p", "sub").agg(F.sum("one").alias("ones"), F.sum("part").alias("parts"))
    before = Window.partitionBy("p").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("p", "sub", F.coalesce(F.sum("ones").over(before), F.lit(0)).alias("ones"), F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("parts"))
    small_pages = sums.groupBy("p").agg(F.floor((F.greatest(F.sum("parts"), F.lit(1)) - 1) / half).alias("last_small"))
    within = Window.partitionBy("p", "sub").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("one_at", F.coalesce(F.sum("one").over(within), F.lit(0))).withColumn("part_at", F.coalesce(F.sum("part").over(within), F.lit(0)))
    r = r.join(base, ["p", "sub"]).join(small_pages, "p")
    page = F.when(F.col("big"), F.col("last_small") + 1 + F.col("ones") + F.col("one_at")).otherwise(F.least(F.col("last_small"), F.floor((F.col("parts") + F.col("part_at")) / half)))
    r = common.materialize(r.withColumn("page", page.cast("long")).drop("big", "sub", "one", "part", "ones", "parts", "last_small", "one_at", "part_at", "row"), "pages")
    return r.join(r.groupBy("p", "page").agg(F.sum("size").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows")), ["p", "page"])


def shard(df: DataFrame, key: str, size: Column, limit: int = LIMIT) -> DataFrame:
    """df with COLUMNS: the shard's bits, their number, the page (0 but for keys over the limit), and the page's bytes and rows."""
    if limit < 1:
        raise ValueError("limit must be positive")
    names = common.fresh(df, *COLUMNS)
    row = F.struct(*[F.col(c) for c in df.columns])
    rest = df.select(place(F.col(key)).alias("p"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), row.alias("r"))
    total = rest.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    above, depth, out = 0, min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + 4), []
    while True:
        at = rest.withColumn("cell", _first_bits(F.col("p"), depth))
        cells = common.materialize(at.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "cells")
        leaves = common.materialize(_leaves(cells, above, depth, limit), "leaves")
        known = leaves.where("leaf_depth is not null")
        found = at.join(common.small(known), "cell")
        bits = F.when(F.col("leaf_depth") > 0, F.expr("lpad(bin(leaf), leaf_depth, '0')")).otherwise(F.lit(""))
        out.append(found.select("r", bits.alias("shard"), F.col("leaf_depth").cast("int").alias("local_depth"), F.lit(0).cast("long").alias("page"), "shard_bytes", "shard_rows"))
        over = leaves.where("leaf_depth is null").select("cell")
        if over.isEmpty():
            break
        # Written, so that a hot key, which is followed to the last bit, doesn't read and filter all rows again for each level.
        rest = common.materialize(at.join(common.small(over), "cell", "left_semi").select("p", "size", "r"), "rest")
        if depth == BITS:
            out.append(_pages(rest, limit).select("r", F.lpad(F.bin("p"), BITS, "0").alias("shard"), F.lit(BITS).alias("local_depth"), "page", "shard_bytes", "shard_rows"))
            break
        above, depth = depth, min(BITS, depth + DEEPER)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select("r.*", *[F.col(c).alias(n) for c, n in zip(COLUMNS, names, strict=True)])


def directory(sharded: DataFrame) -> DataFrame:
    """One row for each shard: its bits and the entries [first_entry, last_entry] that lead to it in a directory of the
    global depth, which is the largest local one (62 bits at most are entries' numbers)."""
    shards = sharded.groupBy("shard", "local_depth").agg(F.max("page").alias("last_page"), F.count(F.lit(1)).alias("rows"))
    deep = shards.agg(F.max("local_depth").alias("global_depth"))
    x = shards.crossJoin(F.broadcast(deep))  # one row
    first = F.coalesce(F.conv(F.when(F.col("shard") != "", F.col("shard")), 2, 10).cast("long"), F.lit(0).cast("long"))
    wide = F.expr("shiftleft(1L, global_depth - local_depth)")
    return x.select("shard", "local_depth", "global_depth", (first * wide).alias("first_entry"), ((first + 1) * wide - 1).alias("last_entry"), "last_page", "rows")


def write(sharded: DataFrame, path: str) -> None:
    """Writes one folder for each shard and page; every shard is written by one task."""
    sharded.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a SHARDS-th of all bytes, within LEAST and LIMIT, or of the largest document where that is more."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.octets(F.col("text")).alias("n_bytes"))
    total, largest = docs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.max("n_bytes"), F.lit(0))).first()
    return shard(docs, "doc_id", F.col("n_bytes"), max(LEAST, largest, min(LIMIT, total // SHARDS)))


def sql(limit: int | str = LIMIT) -> str:
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as p from documents),
 u as (select *, unnest(range(0, {BITS + 1})) as k from d),
 s as (select k, p >> ({BITS} - k)::bigint as leaf, sum(n_bytes)::bigint as shard_bytes, count(*)::bigint as shard_rows from u group by all),
 f as (select u.r, u.doc_id, u.n_bytes, u.p, min(u.k) as k from u join s on u.k = s.k and u.p >> ({BITS} - u.k)::bigint = s.leaf and s.shard_bytes <= {limit} group by all)
select f.doc_id, f.n_bytes, case when f.k = 0 then '' else right(lpad(to_base(s.leaf, 2), {BITS}, '0'), f.k::int) end as shard, f.k::int as local_depth, 0::bigint as page, s.shard_bytes, s.shard_rows
from f join s on f.k = s.k and f.p >> ({BITS} - f.k)::bigint = s.leaf
"""


OP7_SQL = sql(f"(select greatest({LEAST}, max(n_bytes), least({LIMIT}, sum(n_bytes) // {SHARDS})) from d)")
