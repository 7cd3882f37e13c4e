"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in an order by a hash of doc_id and text, their words are laid end to end, and
the stream is cut into blocks of equal length (to a word). The schedule has one slot for each block
that the mix takes. Slots are the points of the van der Corput sequence: the grid point g is read at
position bit-reverse(g), and cumulative shares of the grid say which source a point belongs to, so each
source's slots are spread evenly over the whole schedule and their number is exact. The slots of a source,
ranked by position, take its blocks in turn; after the last block the next epoch begins.

Nothing is collected: positions in a source's stream and ranks of slots come from sums in two levels
(buckets of a source, then rows of a bucket), so a source with a third of all rows is many small groups.

Edge cases: a null text has size 0; documents of size 0 are taken 0 times; a null source is a source of
its own, last in order; repeated rows are documents of their own, next to each other and sorted in one task; an empty table gives an empty result;
extra columns are never read. The hash and so the mix are the same in every run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

WEIGHTS = (5, 2, 1)
#: Words of the mix over words of all sources.
SHARE = 1.5
#: Most times that a source is read.
MOST = 2
#: Words of a block, about; a source has LEAST_BLOCKS at least, so that rounding to whole blocks stays small.
BLOCK = 256
LEAST_BLOCKS = 64
#: Rows that one window sorts at once, about.
GROUP = 512
_CHUNK = 65_536


@dataclass
class Mix:
    """sources: one row each; documents: (doc_id, text_hash, source_no, source, size, pos); schedule: one row for
    each slot; pieces: the parts of documents that each block holds."""

    sources: DataFrame
    documents: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def _before(by: list[str], *order: str) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets, blocks and slots of each source; sized: (source, size). One row a source, however large the input. Windows over
    all sources run in one task: they are for up to some millions of them.

    Targets share the mix by weight but stop at ``most`` times the source's size; the excess goes to the
    others by weight. Sorted by that limit over the weight, the level of the rest is the largest of the levels
    that remain after each source, so one pass over the sources finds it.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = one.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long") - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights)).cast("int") + 1)
    cap = (F.col("source_size") * F.lit(float(most))).alias("cap")
    x = ranked.select("*", w.alias("weight"), cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = Window.orderBy("ratio", "source_no")
    all_ = Window.partitionBy()
    gone = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", (F.sum("source_size").over(all_) * F.lit(float(share)) - gone) / left)
    x = x.withColumn("target", F.least(F.col("cap"), F.max("level").over(all_) * F.col("weight")))
    blocks = F.least(F.col("source_size"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / BLOCK))).cast("long")
    x = x.withColumn("blocks", blocks)
    x = x.withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + 0.5)).otherwise(F.lit(0)).cast("long"))
    x = x.withColumn("grid_end", F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)))
    width = F.when(F.col("blocks") > 0, F.expr("source_size div blocks")).otherwise(F.lit(0))
    longer = F.when(F.col("blocks") > 0, F.expr("source_size % blocks")).otherwise(F.lit(0))
    return x.select("source_no", "source", "weight", "docs", "source_size", "target", "blocks", "slots", "grid_end", width.alias("width"), longer.alias("longer"))


def _start(block: Column) -> Column:
    """First word of a block: the first ``longer`` blocks have a word more than ``width``."""
    return block * F.col("width") + F.least(block, F.col("longer"))


def _block_of(word: Column) -> Column:
    edge = F.col("longer") * (F.col("width") + 1)
    return F.when(word < edge, F.floor(word / (F.col("width") + 1))).otherwise(F.col("longer") + F.floor((word - edge) / F.col("width"))).cast("long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> Mix:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_md5"), F.col(source).alias("source"), size.alias("size"))
    narrow = common.materialize(narrow, "sizes")
    plan = common.materialize(sources(narrow, weights, share, most), "sources")
    total = plan.agg(F.sum("docs").alias("docs"), F.sum("slots").alias("slots")).first()
    n, slots = total["docs"] or 0, total["slots"] or 0

    # Positions of documents in their source's stream.
    bits = min(30, max(0, math.ceil(math.log2(max(1, n / GROUP)))))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix:"), "text_md5").cast("binary"))
    known = common.small(plan).select("source_no", F.col("source").alias("plan_source"), "blocks", "width", "longer")
    placed = narrow.join(known, narrow["source"].eqNullSafe(F.col("plan_source"))).drop("plan_source").withColumn("place", place)
    placed = placed.withColumn("hi", F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long"))
    sums = placed.groupBy("source_no", "hi").agg(F.sum("size").alias("words"))
    base = sums.select("source_no", "hi", F.coalesce(F.sum("words").over(_before(["source_no"], "hi")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("size").over(_before(["source_no", "hi"], "place", "doc_id", "text_hash", "size")), F.lit(0))
    documents = placed.withColumn("within", within).join(base, ["source_no", "hi"]).withColumn("pos", F.col("base") + F.col("within"))
    documents = common.materialize(documents.select("doc_id", "text_hash", "source_no", "source", "size", "pos", "blocks", "width", "longer"), "placed")

    some = documents.where("size > 0")
    spread = some.withColumn("block", F.explode(F.sequence(_block_of(F.col("pos")), _block_of(F.col("pos") + F.col("size") - 1))))
    begin = F.greatest(_start(F.col("block")) - F.col("pos"), F.lit(0))
    end = F.least(_start(F.col("block") + 1) - F.col("pos"), F.col("size"))
    pieces = spread.select("source_no", "block", "doc_id", "text_hash", "source", "size", "pos", begin.alias("from_word"), (end - begin).alias("n_words"))

    # Slots: grid points by source, read at the reversed bits of the point.
    m = max(1, math.ceil(math.log2(max(2, slots))))
    part = F.explode(F.sequence(F.expr(f"(grid_end - slots) div {_CHUNK}"), F.expr(f"(grid_end - 1) div {_CHUNK}"))).alias("part")
    parts = plan.where("slots > 0").select("source_no", "blocks", "slots", "grid_end", part).repartition("source_no", "part")
    point = F.explode(F.sequence(F.greatest(F.col("grid_end") - F.col("slots"), F.col("part") * _CHUNK), F.least(F.col("grid_end"), (F.col("part") + 1) * _CHUNK) - 1)).alias("point")
    points = parts.select("source_no", "blocks", point)
    points = points.withColumn("slot", F.conv(F.reverse(F.lpad(F.bin("point"), m, "0")), 2, 10).cast("long"))
    points = points.withColumn("span", F.shiftright("slot", max(0, m - max(0, math.ceil(math.log2(max(1, slots / _CHUNK)))))))
    counts = points.groupBy("source_no", "span").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("source_no", "span", F.coalesce(F.sum("n").over(_before(["source_no"], "span")), F.lit(0)).alias("base"))
    order = Window.partitionBy("source_no", "span").orderBy("slot")
    # Spark takes what is made of the few sources for small, and would broadcast it: these joins are shuffled.
    ranked = points.withColumn("r", F.row_number().over(order)).join(base.hint("merge"), ["source_no", "span"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    schedule = ranked.select("slot", "source_no", "rank", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"))
    return Mix(plan, documents, schedule, pieces)


def taken(m: Mix) -> DataFrame:
    """Words that the schedule takes of each document, repeats counted."""
    joined = m.pieces.join(m.schedule.select("source_no", "block", "slot").hint("merge"), ["source_no", "block"], "left")
    some = joined.groupBy("source_no", "pos", "doc_id", "size").agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words")).otherwise(F.lit(0))).alias("taken"))
    none = m.documents.where("size = 0").select("source_no", "pos", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


def mixed(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents as often as the mix takes them, with their own columns.

    An epoch that takes a document whole returns its row as it is. One that ends within it returns the words
    taken, joined by spaces, with n_chars to match. A document that the mix takes no word of is left out.
    """
    m = mix(docs)
    key = ["doc_id", "text_hash", "source"]
    spans = m.pieces.join(m.schedule.hint("merge"), ["source_no", "block"]).groupBy(*key, "pos", "size", "epoch")
    spans = spans.agg(F.min("from_word").alias("a"), F.max(F.col("from_word") + F.col("n_words")).alias("b"))
    names = common.fresh(docs, "mix_id", "mix_hash", "mix_source", "mix_size", "mix_a", "mix_b")
    spans = spans.select(*[F.col(x).alias(y) for x, y in zip([*key, "size", "a", "b"], names, strict=True)])
    mark = common.fresh(docs, "mark")[0]
    marked = docs.withColumn(mark, F.xxhash64("text"))
    on = marked["doc_id"].eqNullSafe(F.col(names[0])) & (F.col(mark) == F.col(names[1])) & marked["source"].eqNullSafe(F.col(names[2]))
    again = m.documents.groupBy(*key).count().where("count > 1").select(*[F.col(x).alias(y) for x, y in zip(key, names, strict=False)])
    if not again.isEmpty():
        once = marked.join(again, on, "left_anti").select(*marked.columns)
        marked = once.union(common.one_of_each(marked.join(again, on, "left_semi").select(*marked.columns), ["doc_id", mark, "source"]))
        on = marked["doc_id"].eqNullSafe(F.col(names[0])) & (F.col(mark) == F.col(names[1])) & marked["source"].eqNullSafe(F.col(names[2]))
    a, b = F.col(names[4]), F.col(names[5])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({common.WORD})"), 1), (a + 1).cast("int"), (b - a).cast("int")), " ")
    text = F.when((a == 0) & (b == F.col(names[3])), F.col("text")).otherwise(cut)
    out = marked.join(spans, on)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when((a == 0) & (b == F.col(names[3])), F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", text).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    known = common.small(m.sources).select("source_no", "source_size", "target")
    return taken(m).join(known, "source_no").select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        md5(coalesce(doc_id::varchar, '') || ':mix:' || md5(coalesce(text, ''))) as place from documents),
 s as (select source, sum(size)::bigint as source_size from d group by source),
 w as (select *, row_number() over (order by source is null, source) - 1 as no from s),
 x as (select *, [5.0::double, 2.0::double, 1.0::double][(no % 3 + 1)::int] as weight, source_size * 2.0::double as cap from w),
 l as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by cap / weight, no rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by cap / weight, no rows between current row and unbounded following) as level from x),
 t as (select *, least(cap, max(level) over () * weight) as target, least(source_size, greatest({LEAST_BLOCKS}, ceil(source_size / {BLOCK}.0)))::bigint as blocks from l),
 k as (select *, case when source_size > 0 then floor(target / source_size * blocks + 0.5)::bigint else 0 end as slots from t),
 p as (select d.doc_id, d.size, k.source_size, k.target, k.blocks, k.slots, case when blocks > 0 then k.source_size // k.blocks end as width, case when blocks > 0 then k.source_size % k.blocks end as longer,
        coalesce(sum(d.size) over (partition by k.no order by d.place, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
       from d join k on d.source is not distinct from k.source),
 e as (select *, slots // blocks as epochs, (slots % blocks) * width + least(slots % blocks, longer) as last_word from p where size > 0)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, last_word - pos)))::bigint as taken from e
union all select doc_id, size, source_size, target, 0::bigint as taken from p where size = 0
"""
