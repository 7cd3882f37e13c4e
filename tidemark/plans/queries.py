"""Named queries of the stream engine over the events table, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import index, kv, late, maintenance, reads, routing
from tidemark.schema import MAX_PAYLOAD, quarantined, shard_of
from tidemark.sources import scratch
from tidemark.sources.events import ARRIVAL_SPAN, as_stream, read_events
from tidemark.sources.store import Store
from tidemark.streaming import router

JITTER, FLOOR, CUTOFF, SPACING = 48, 473_400, 473_700, 16
#: Hours of primary_index that one window sorts at once in as-of joins.
HOURS_SPAN = 168
SOME = (1, 5, 9, 42)
FEW = (1, 2, 3)


def _src(s: SparkSession, d: str) -> DataFrame:
    return as_stream(read_events(s, d))


def _routed(s: SparkSession, d: str) -> DataFrame:
    return routing.route(_src(s, d), ARRIVAL_SPAN, JITTER, FLOOR)


_stores: dict[tuple[str, str], Store] = {}


def _store(s: SparkSession, d: str) -> Store:
    """The routed records, stored once a session for all reads."""
    key = (s.sparkContext.applicationId, d)
    if key not in _stores:
        store = Store(s, scratch.folder(s, "routed"))
        store.append(routing.live(_routed(s, d)))
        _stores[key] = store
    return _stores[key]


def _live(s: SparkSession, d: str) -> DataFrame:
    return _store(s, d).read()


def _range(s: SparkSession, d: str, start: int, end: int, keys=None, limit: int = 0) -> DataFrame:
    """A range from the store, which prunes by keys and range."""
    return reads.read_range(_store(s, d).read(keys, start, end), start, end, keys, limit)


def _late(s: SparkSession, d: str) -> DataFrame:
    return routing.late(_live(s, d)).drop("route_rank")


def _logged(s: SparkSession, d: str) -> DataFrame:
    return routing.logged(_live(s, d))


def _index(s: SparkSession, d: str) -> DataFrame:
    return index.sparse_index(_logged(s, d), ARRIVAL_SPAN, SPACING)


def _kv(s: SparkSession, d: str) -> DataFrame:
    return read_events(s, d).select(F.col("event_id").alias("k"), F.col("value").alias("v"), (F.col("event_id") % 97 == 5).alias("deleted"))


def _append_roundtrip(s: SparkSession, d: str) -> DataFrame:
    store = Store(s, scratch.folder(s, "store"))
    store.append(_src(s, d))
    return store.read().select("event_id", "secondary_index", "primary_index", "version", "value")


def _retention(s: SparkSession, d: str) -> DataFrame:
    """What a store returns after it was told to drop what lies below the cutoff."""
    store = Store(s, scratch.folder(s, "retained"))
    store.append(_live(s, d))
    store.retain(CUTOFF)
    return store.read().select(*_RI)


def _batches(s: SparkSession, d: str) -> tuple[Store, list[tuple[int, int]]]:
    """Three numbered batches of a stream, the second of them sent twice, and how many records a read saw after each append."""
    store, seen = Store(s, scratch.folder(s, "batches")), []
    for step, n in enumerate((0, 1, 1, 2)):
        store.append(_src(s, d).where(F.col("event_id") % 3 == n), "events", n)
        seen.append((step, store.read().count()))
    return store, seen


def _zones(s: SparkSession, d: str) -> DataFrame:
    """The parts that a lookup opens, of three with ranges of their own."""
    store, live = Store(s, scratch.folder(s, "zones")), _live(s, d)
    for part in range(3):
        store.append(live.where(F.when(F.col("primary_index") < 473_600, 0).when(F.col("primary_index") < 473_800, 1).otherwise(2) == part))
    return store.zones(473_620, 473_650)


def _closed(s: SparkSession, d: str) -> DataFrame:
    """What a store says before it is closed, after, and when it is opened anew."""
    base = scratch.folder(s, "closed")
    with Store(s, base) as store:
        store.append(_src(s, d))
        before = store.read().count()
    store.close()

    def refused(call: Callable[[], object]) -> bool:
        try:
            call()
        except RuntimeError:
            return True
        return False

    row = (before, refused(store.read), refused(lambda: store.append(_src(s, d))), Store(s, base).read().count())
    return s.createDataFrame([row], "rows_before long, read_refused boolean, append_refused boolean, rows_anew long")


def _pooled(s: SparkSession, d: str) -> DataFrame:
    rows: list = []

    def take(row) -> bool:
        rows.append((row["primary_index"], row["event_id"]))
        return len(rows) < 5

    reads.read_range_pooled(_store(s, d).read(7, 473_500, 473_800), 7, 473_500, 473_800, take)
    return s.createDataFrame(rows, "primary_index long, event_id long")


def _empty_keys(s: SparkSession, d: str) -> DataFrame:
    asked = _src(s, d).where("secondary_index < 12").select("secondary_index")
    found = reads.read_range(_store(s, d).read(None, 473_500, 473_510), 473_500, 473_510, reads.distinct_keys(asked))
    return reads.with_empty_keys(found, asked).groupBy("secondary_index").agg(F.count("event_id").alias("c"))


def _index_recover(s: SparkSession, d: str) -> DataFrame:
    bounds = s.createDataFrame([(i, 1_000_000_000, 10_000_000_000) for i in range(4)], "shard int, begin long, tail long")
    return maintenance.recovered(_index(s, d), bounds)


def _decode_payload(s: SparkSession, d: str) -> DataFrame:
    """The event's id written as an 8-byte payload, and read back by the layout of its version."""
    registry = codec.VersionRegistry().register(1, [("event_low", "<u4"), ("version", "<u2"), ("spare", "<u2")])
    payload = F.concat(codec._bytes(F.col("event_id") % 4_294_967_296, 4), codec._bytes(F.col("version"), 2), codec._bytes(F.lit(0), 2))
    rows = _src(s, d).where("version = 1").withColumn("payload", payload)
    return registry.decode(rows, 1).select("event_id", "decoded.event_low", F.col("decoded.version").alias("version"))


def _decode_header(s: SparkSession, d: str) -> DataFrame:
    header = codec.encode_header(F.col("primary_index") - 473_600, -F.col("secondary_index"), F.col("version"), F.lit(8))
    fields = codec.decode_header(F.col("header"))
    return _src(s, d).withColumn("header", header).select("event_id", *[c.alias(k) for k, c in fields.items()])


def _can_decode(s: SparkSession, d: str) -> DataFrame:
    """Payloads of 0 to 32 bytes, by what their versions need."""
    registry = codec.VersionRegistry().register(1, [("value", "f4"), ("counter", "i4")]).register(2, [("lat", "f8"), ("lon", "f8"), ("speed", "f4"), ("heading", "f4")])
    payload = F.repeat(F.lit("x"), (F.col("event_id") % 33).cast("int")).cast("binary")
    return _live(s, d).withColumn("payload", payload).select("event_id", registry.can_decode(F.col("version"), F.octet_length("payload")).alias("ok"))


def _depths(s: SparkSession, d: str) -> list[int]:
    """A queue as deep as four times each day's events, in order."""
    days = read_events(s, d).groupBy(F.to_date("ts").alias("day")).count().orderBy("day").collect()  # one row a day
    return [4 * r["count"] for r in days]


def _adaptive(s: SparkSession, d: str) -> DataFrame:
    depths = _depths(s, d)
    return s.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(depths, routing.adaptive_levels(depths), strict=True))], "batch int, depth long, level int")


def _payload_guard(s: SparkSession, d: str) -> DataFrame:
    """The records that are turned away, of payloads and versions on both sides of their limits."""
    texts = s.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") * 7 % 70_000).cast("int").alias("version"))
    payload = F.repeat(F.lit("x"), (MAX_PAYLOAD - 5 + F.col("doc_id") % 11).cast("int")).cast("binary")
    _, rejected = quarantined(texts.withColumn("payload", payload))
    return rejected.select("doc_id", "version", F.octet_length("payload").cast("long").alias("n_bytes"))


def _stream_route(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream that is routed into files, with its dropped records."""
    folder = scratch.folder(s, "stream")
    live = as_stream(router.files_as_stream(s, f"{d}/events.parque[t]", read_events(s, d).schema))
    router.route_into_files(live, f"{folder}/out", f"{folder}/checkpoint", ARRIVAL_SPAN, JITTER, FLOOR, availableNow=True).awaitTermination()
    return router.read_routed(s, f"{folder}/out", live.schema).select("event_id", "secondary_index", "primary_index", "route")


def _stream_store(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream that is routed into a store; it keeps no dropped records."""
    folder = scratch.folder(s, "live")
    live = as_stream(router.files_as_stream(s, f"{d}/events.parque[t]", read_events(s, d).schema, 1))
    store = Store(s, f"{folder}/store")
    router.route_into(live, store, f"{folder}/checkpoint", ARRIVAL_SPAN, JITTER, FLOOR, availableNow=True).awaitTermination()
    return store.read().select("event_id", "secondary_index", "primary_index", "route", "route_rank")


def _asof_join(s: SparkSession, d: str) -> DataFrame:
    """The index is stored first, as the join reads it twice."""
    path = scratch.folder(s, "index")
    _index(s, d).write.parquet(path)
    return index.asof_join(_src(s, d), s.read.parquet(path), "event_id", HOURS_SPAN)


def _latest(s: SparkSession, d: str) -> DataFrame:
    return reads.read_latest(_live(s, d)).select("secondary_index", "primary_index", "event_id")


_REC = ("primary_index", "secondary_index", "version", "value")

_PI = "epoch_us(ts) // 3600000000"
_CTES = f"""with recursive src as (
  select event_id, {_PI} as primary_index, cast(user_id as int) as secondary_index, cast(1 + event_id % 3 as int) as version, value,
         (event_id + (event_id * 7919) % 2003) * 1048576 + event_id as arrival_seq from events),
run as (select *, max(primary_index) over (partition by secondary_index order by arrival_seq rows between unbounded preceding and current row) as max_pi from src),
routed as (select *, case when primary_index >= max_pi then 'normal' when primary_index >= max_pi - {JITTER} then 'jitter'
             when primary_index < {FLOOR} then 'dropped' else 'late' end as route from run),
live as (select *, case when route = 'late' then 1 else 0 end as route_rank from routed where route <> 'dropped'),
late as (select * from routed where route = 'late'),
lg as (select *, row_number() over (partition by secondary_index order by arrival_seq) as n from routed where route in ('normal', 'jitter')),
ix as (select secondary_index, primary_index, min(arrival_seq) as addr from lg where n = 1 or n % {SPACING} = 0 group by secondary_index, primary_index),
kv as (select event_id as k, value as v, event_id % 97 = 5 as deleted from events),
days as (select row_number() over (order by d) - 1 as batch, 4 * c as depth from (select cast(ts as date) as d, count(*) as c from events group by 1) t),
walk as (
  select cast(-1 as bigint) as batch, cast(0 as bigint) as depth, 6 as level, 0 as since, 0 as ups, 0 as downs
  union all
  select d.batch, d.depth, case when w.since < 4 then w.level when d.depth > 1024 then least(8, w.level + 1) when d.depth < 512 then greatest(0, w.level - 1) else w.level end,
    case when w.since >= 4 and (d.depth > 1024 or d.depth < 512) then 0 else w.since + 1 end,
    w.ups + case when w.since >= 4 and d.depth > 1024 then 1 else 0 end, w.downs + case when w.since >= 4 and d.depth < 512 then 1 else 0 end
  from walk w join days d on d.batch = w.batch + 1)
"""
_N = "row_number() over (partition by secondary_index order by primary_index, route_rank, arrival_seq) as position"
_LATE_N = "row_number() over (partition by secondary_index order by primary_index, arrival_seq) as position"
_RI = ("secondary_index", "primary_index", "event_id")
_RIP = (*_RI, "position")

Q = Callable[[SparkSession, str], DataFrame]
#: Name: the query, and its SQL after the common table expressions (None: SQL can't say it).
TABLE: dict[str, tuple[Q, str | None]] = {
    "append_roundtrip": (_append_roundtrip, "select event_id, secondary_index, primary_index, version, value from src"),
    "append_batches": (lambda s, d: _batches(s, d)[0].read().select("event_id", "secondary_index", "primary_index"), "select event_id, secondary_index, primary_index from src"),
    "write_barrier": (
        lambda s, d: s.createDataFrame(_batches(s, d)[1], "step int, visible long"),
        "select cast(t.step as int) as step, cast(count(*) as bigint) as visible from (select 0 as step, 0 as n union all select 1, 1 union all select 2, 1 union all select 3, 2) t join src on event_id % 3 <= t.n group by t.step",
    ),
    "zone_lookup": (
        _zones,
        "select min(primary_index) as least, max(primary_index) as largest, cast(count(*) as bigint) as rows from live group by case when primary_index < 473600 then 0 when primary_index < 473800 then 1 else 2 end having max(primary_index) >= 473620 and min(primary_index) <= 473650",
    ),
    "store_closed": (_closed, "select cast(count(*) as bigint) as rows_before, true as read_refused, true as append_refused, cast(count(*) as bigint) as rows_anew from src"),
    "running_max": (lambda s, d: routing.running_max(_src(s, d), ARRIVAL_SPAN).select("event_id", "max_pi"), "select event_id, max_pi from run"),
    "route_events": (lambda s, d: _routed(s, d).select("event_id", "secondary_index", "primary_index", "route"), "select event_id, secondary_index, primary_index, route from routed"),
    "stream_route_events": (_stream_route, "select event_id, secondary_index, primary_index, route from routed"),
    "stream_route_into_store": (_stream_store, "select event_id, secondary_index, primary_index, route, route_rank from live"),
    "route_counts": (lambda s, d: routing.route_counts(_routed(s, d)), "select secondary_index, route, cast(count(*) as bigint) as c from routed group by secondary_index, route"),
    "route_dropped": (lambda s, d: _routed(s, d).where("route = 'dropped'").select("event_id", "secondary_index", "primary_index"), "select event_id, secondary_index, primary_index from routed where route = 'dropped'"),
    "late_arrivals": (lambda s, d: _late(s, d).select(*_RI, "version", "value"), "select secondary_index, primary_index, event_id, version, value from late"),
    "ingest_stats": (
        lambda s, d: routing.ingest_stats(_routed(s, d), _depths(s, d)),
        "select cast(sum(case when route='late' then 1 else 0 end) as bigint) as late_arrivals, cast(sum(case when route='jitter' then 1 else 0 end) as bigint) as jitter_absorbed, cast(sum(case when route='dropped' then 1 else 0 end) as bigint) as dropped_late_arrivals,"
        " (select level from walk order by batch desc limit 1) as adaptive_level, (select cast(max(ups) as bigint) from walk) as scale_ups, (select cast(max(downs) as bigint) from walk) as scale_downs, cast(0 as bigint) as dropped_index_rows, cast(0 as bigint) as pending_index_rows from routed",
    ),
    "sparse_index": (_index, "select secondary_index, primary_index, addr from ix"),
    "adaptive_levels": (_adaptive, "select cast(batch as int) as batch, depth, level from walk where batch >= 0"),
    "payload_guard": (
        _payload_guard,
        "select doc_id, version, n_bytes from (select doc_id, cast(doc_id * 7 % 70000 as int) as version, cast(65530 + doc_id % 11 as bigint) as n_bytes from documents) t where n_bytes > 65535 or version > 65535",
    ),
    "shard_of": (lambda s, d: _live(s, d).groupBy(shard_of(F.col("secondary_index")).alias("shard")).agg(F.count(F.lit(1)).alias("c")), "select secondary_index & 3 as shard, cast(count(*) as bigint) as c from live group by secondary_index & 3"),
    "read_range_single": (
        lambda s, d: reads.ordered(_range(s, d, 473_500, 473_800, 7)).select(*_REC),
        "select primary_index, secondary_index, version, value from live where secondary_index = 7 and primary_index between 473500 and 473800",
    ),
    "read_range_single_positions": (
        lambda s, d: reads.positioned(_range(s, d, 473_500, 473_800, 7)).select(*_REC, "position"),
        f"select primary_index, secondary_index, version, value, {_N} from live where secondary_index = 7 and primary_index between 473500 and 473800",
    ),
    "read_range_multi": (
        lambda s, d: reads.positioned(_range(s, d, 473_500, 473_900, SOME)).select("secondary_index", "primary_index", "version", "event_id", "position"),
        f"select secondary_index, primary_index, version, event_id, {_N} from live where secondary_index in (1, 5, 9, 42) and primary_index between 473500 and 473900",
    ),
    "read_range_multi_limit": (
        lambda s, d: _range(s, d, 473_500, 473_900, SOME, 3).select(*_RIP),
        f"select secondary_index, primary_index, event_id, position from (select *, {_N} from live where secondary_index in (1, 5, 9, 42) and primary_index between 473500 and 473900) t where position <= 3",
    ),
    "read_range_multi_keys": (
        _empty_keys,
        "select q.secondary_index, cast(count(l.event_id) as bigint) as c from (select distinct secondary_index from src where secondary_index < 12) q left join live l on l.secondary_index = q.secondary_index and l.primary_index between 473500 and 473510 group by q.secondary_index",
    ),
    "read_range_all": (
        lambda s, d: reads.positioned(_range(s, d, 473_500, 473_900)).select(*_REC, "position"),
        f"select secondary_index, primary_index, version, value, {_N} from live where primary_index between 473500 and 473900",
    ),
    "read_range_all_limit": (
        lambda s, d: _range(s, d, 473_500, 473_900, limit=5).select(*_RIP),
        f"select secondary_index, primary_index, event_id, position from (select *, {_N} from live where primary_index between 473500 and 473900) t where position <= 5",
    ),
    "read_range_pooled": (_pooled, "select primary_index, event_id from live where secondary_index = 7 and primary_index between 473500 and 473800 order by primary_index, route_rank, arrival_seq limit 5"),
    "earliest_primary_index": (lambda s, d: reads.earliest(_store(s, d).read(FEW, 473_600), FEW, 473_600), "select min(primary_index) as earliest from live where secondary_index in (1, 2, 3) and primary_index >= 473600"),
    "read_from_available": (
        lambda s, d: reads.read_from_available(_store(s, d).read(FEW, 473_600), FEW, 473_600, 24).select("range_end", *_RI),
        "select w.e + 24 as range_end, l.secondary_index, l.primary_index, l.event_id from live l cross join (select min(primary_index) as e from live where secondary_index in (1, 2, 3) and primary_index >= 473600) w where l.secondary_index in (1, 2, 3) and l.primary_index between w.e and w.e + 24",
    ),
    "read_latest": (_latest, "select secondary_index, primary_index, event_id from (select *, row_number() over (partition by secondary_index order by primary_index desc, route_rank, arrival_seq desc) as k from live) t where k = 1"),
    "distinct_keys": (lambda s, d: reads.distinct_keys(_live(s, d)), "select distinct secondary_index from live"),
    "asof_backward": (lambda s, d: index.asof_backward(_index(s, d), CUTOFF), f"select secondary_index, max_by(addr, primary_index) as addr from ix where primary_index <= {CUTOFF} group by secondary_index"),
    "asof_forward": (lambda s, d: index.asof_forward(_index(s, d), CUTOFF), f"select secondary_index, min(primary_index) as primary_index, min_by(addr, primary_index) as addr from ix where primary_index >= {CUTOFF} group by secondary_index"),
    "asof_join": (_asof_join, "select p.event_id, i.addr from src p asof left join ix i on p.secondary_index = i.secondary_index and p.primary_index >= i.primary_index"),
    "shard_min_address": (lambda s, d: index.shard_min_address(_index(s, d), CUTOFF), f"select secondary_index & 3 as shard, min(addr) as addr from ix where primary_index <= {CUTOFF} group by secondary_index & 3"),
    "merge_late": (
        lambda s, d: reads.merged(_logged(s, d), _late(s, d)).select(*_RIP, "route"),
        f"select secondary_index, primary_index, event_id, route, {_N} from live",
    ),
    "merge_late_per_key": (
        lambda s, d: reads.merged(_logged(s, d), _late(s, d), 3).select(*_RIP),
        f"select secondary_index, primary_index, event_id, position from (select *, {_N} from live) t where position <= 3",
    ),
    "late_range": (
        lambda s, d: reads.positioned(late.late_range(_late(s, d), 473_400, 473_900, 5), late.ORDER).select("secondary_index", "primary_index", "version", "event_id", "position"),
        f"select secondary_index, primary_index, version, event_id, {_LATE_N} from late where secondary_index = 5 and primary_index between 473400 and 473900",
    ),
    "late_range_multi": (
        lambda s, d: late.late_range(_late(s, d), 473_400, 473_900, SOME, 3).select(*_RIP),
        f"select secondary_index, primary_index, event_id, position from (select *, {_LATE_N} from late where secondary_index in (1, 5, 9, 42) and primary_index between 473400 and 473900) t where position <= 3",
    ),
    "late_range_all": (
        lambda s, d: late.late_range(_late(s, d), 473_400, 473_900, limit=2).select(*_RIP),
        f"select secondary_index, primary_index, event_id, position from (select *, {_LATE_N} from late where primary_index between 473400 and 473900) t where position <= 2",
    ),
    "late_earliest": (lambda s, d: late.late_earliest(_late(s, d), FEW, 473_600), "select min(primary_index) as earliest from late where secondary_index in (1, 2, 3) and primary_index >= 473600"),
    "late_latest": (
        lambda s, d: late.late_latest(_late(s, d)).select("secondary_index", "primary_index", "version", "event_id"),
        "select l.secondary_index, l.primary_index, l.version, l.event_id from late l join (select secondary_index, max(primary_index) as mp from late group by secondary_index) x on l.secondary_index = x.secondary_index and l.primary_index = x.mp",
    ),
    "late_purge": (lambda s, d: late.late_purge(_late(s, d), CUTOFF)[1], f"select cast(count(*) as bigint) as remaining from late where primary_index >= {CUTOFF}"),
    "retention_survivors": (_retention, f"select secondary_index, primary_index, event_id from live where primary_index >= {CUTOFF}"),
    "index_purge": (lambda s, d: maintenance.retained(_index(s, d), CUTOFF), f"select secondary_index, primary_index, addr from ix where primary_index >= {CUTOFF}"),
    "shard_truncation_points": (lambda s, d: maintenance.truncation_points(_index(s, d), CUTOFF), f"select secondary_index & 3 as shard, min(addr) as truncate_until from ix where primary_index >= {CUTOFF} group by secondary_index & 3"),
    "floor_reindex": (
        lambda s, d: maintenance.floor_reindex(_index(s, d), CUTOFF),
        f"select a.secondary_index, cast({CUTOFF} as bigint) as primary_index, b.sb as addr from (select secondary_index, min(addr) as ma from ix where primary_index >= {CUTOFF} group by secondary_index) a join (select secondary_index & 3 as shard, min(addr) as sb from ix where primary_index >= {CUTOFF} group by secondary_index & 3) b on (a.secondary_index & 3) = b.shard where a.ma > b.sb and not exists (select 1 from ix where ix.secondary_index = a.secondary_index and ix.primary_index = {CUTOFF})",
    ),
    "index_recover": (_index_recover, "select secondary_index, primary_index, addr from ix where addr >= 1000000000 and addr < 10000000000"),
    "decode_payload": (_decode_payload, "select event_id, cast(event_id % 4294967296 as bigint) as event_low, version from src where version = 1"),
    "can_decode": (_can_decode, "select l.event_id, (s.version is not null and l.event_id % 33 >= s.size) as ok from live l left join (select 1 as version, 8 as size union all select 2 as version, 24 as size) s on l.version = s.version"),
    "decode_header": (_decode_header, "select event_id, primary_index - 473600 as primary_index, -secondary_index as secondary_index, version, 8 as payload_length from src"),
    "kv_put": (
        lambda s, d: kv.put(_kv(s, d).where("k < 500"), _kv(s, d).where("k >= 500").withColumn("at", F.col("k") * 3), "at"),
        "select k, v, deleted from kv",
    ),
    "kv_out_of_order": (
        lambda s, d: kv.out_of_order(_kv(s, d).withColumn("at", F.col("k") * 7919 % 1_000_003), "at"),
        "select cast(count(*) as bigint) as out_of_order from (select k, max(k) over (order by k * 7919 % 1000003 rows between unbounded preceding and 1 preceding) as pk from kv) t where k <= pk",
    ),
    "kv_get": (lambda s, d: kv.get(_kv(s, d), 123).select("k", "v"), "select k, v from kv where k = 123 and not deleted"),
    "kv_delete": (lambda s, d: kv.there(kv.delete(_kv(s, d).withColumn("deleted", F.lit(False)), _kv(s, d).where("deleted").select("k"))).select("k", "v"), "select k, v from kv where not deleted"),
    "kv_range": (lambda s, d: kv.positioned(kv.scan(_kv(s, d), 500, 900)).select("k", "v", "position"), "select k, v, row_number() over (order by k) as position from kv where k between 500 and 900 and not deleted"),
    "kv_truncate": (lambda s, d: kv.truncate(_kv(s, d), 700).select("k", "v"), "select k, v from kv where k >= 700 and not deleted"),
    "kv_stats": (lambda s, d: kv.stats(_kv(s, d)), "select k // 1024 as block, cast(count(*) as bigint) as c, min(k) as min_key, max(k) as max_key from kv group by k // 1024"),
}


def queries() -> dict[str, Q]:
    return {k: q for k, (q, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _CTES + sql for k, (_, sql) in TABLE.items() if sql}
