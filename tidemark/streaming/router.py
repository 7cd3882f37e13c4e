"""Routing of a live stream: each key's running maximum is state, kept between micro-batches.

``route_stream`` keeps it in the state store, and has one worker for each key of a micro-batch; ``route_into`` and ``route_into_files`` keep it in a table
of one row a key and route a micro-batch in two levels, so that a key with most of its records is many small groups, and many keys are no calls of Python.

Within a micro-batch a key's records run in the order of arrival_seq; across micro-batches, in that of the batches.
A watermark would not do: it is one for the whole query, and this is one for each key, that drops nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.operators import routing

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IN = ("event_id", "primary_index", "version", "value", "arrival_seq")
OUT = "event_id long, secondary_index int, primary_index long, version int, value double, arrival_seq long, max_pi long, route string"


class Router(StatefulProcessor):
    def __init__(self, jitter: int, floor: int | None):
        self.jitter, self.floor = jitter, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("max_pi", "max_pi long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")
        old = self.top.get()
        pi = batch["primary_index"].astype("int64")
        top = pi.cummax() if old is None else pi.cummax().clip(lower=old[0])
        route = pd.Series("late", index=batch.index)
        if self.floor is not None:
            route[pi < self.floor] = "dropped"
        if self.jitter > 0:
            route[pi >= top - self.jitter] = "jitter"
        route[pi >= top] = "normal"
        self.top.update((int(top.iloc[-1]),))
        out = batch[list(IN)].assign(secondary_index=key[0], max_pi=top, route=route)
        yield out[["event_id", "secondary_index", "primary_index", "version", "value", "arrival_seq", "max_pi", "route"]]

    def close(self) -> None:
        pass


def route_stream(stream: DataFrame, jitter: int = 0, floor: int | None = None) -> DataFrame:
    """A streaming frame of records with max_pi and route."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select("secondary_index", *IN)
    return rows.groupBy("secondary_index").transformWithStateInPandas(Router(jitter, floor), OUT, "Append", "None")


def run_into(routed: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs all that there is now into parquet files; the checkpoint folder makes it exactly once."""
    query = routed.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def into_store(routed: DataFrame, store, checkpoint: str, compact_every: int = 64, **trigger):
    """Starts a query that appends each micro-batch to a store once, by its number, and now and then compacts the store; returns the query."""

    def add(df: DataFrame, n: int) -> None:
        store.append(df, checkpoint, n)
        if n % compact_every == compact_every - 1:
            store.compact()

    return routed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def _in_two_levels(stream: DataFrame, checkpoint: str, span: int, jitter: int, floor: int | None, keep: Callable[[DataFrame, int], None], trigger: dict):
    """Starts a query that routes each micro-batch of a streaming frame and hands it to ``keep`` with its number; returns the query.

    What keys have reached after batch n is the table n in ``checkpoint``/tops: a batch that runs again reads the one before and
    writes its own anew, so it gives the same routes.
    """
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())

    def add(df: DataFrame, n: int) -> None:
        table = lambda k: f"{checkpoint}/tops/{k:012d}"
        before = df.sparkSession.read.schema("secondary_index int, top long").parquet(table(n - 1)) if n and fs.exists(path(table(n - 1))) else None
        df = df.persist()  # a lost block is read from the source again
        try:
            keep(routing.route(df, span, jitter, floor, before), n)
            routing.tops(df, before).write.mode("overwrite").parquet(table(n))
        finally:
            df.unpersist()
        fs.delete(path(table(n - 2)), True)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{checkpoint}/query").trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def route_into(stream: DataFrame, store, checkpoint: str, span: int, jitter: int = 0, floor: int | None = None, compact_every: int = 64, **trigger):
    """Starts a query that routes each micro-batch of a streaming frame and appends it to a store once, dropped records left out; returns the query."""

    def keep(routed: DataFrame, n: int) -> None:
        store.append(routing.live(routed), checkpoint, n)
        if n % compact_every == compact_every - 1:
            store.compact()

    return _in_two_levels(stream, checkpoint, span, jitter, floor, keep, trigger)


def route_into_files(stream: DataFrame, folder: str, checkpoint: str, span: int, jitter: int = 0, floor: int | None = None, **trigger):
    """Starts a query that routes each micro-batch of a streaming frame and writes it to parquet files once, dropped records too; returns the query.

    Each batch has a folder by its number, which a batch that runs again writes anew; ``read_routed`` reads all of them.
    """
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)  # a stream without a batch reads as empty

    def keep(routed: DataFrame, n: int) -> None:
        routed.write.mode("overwrite").parquet(f"{folder}/{n:012d}")

    return _in_two_levels(stream, checkpoint, span, jitter, floor, keep, trigger)


def read_routed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The records that ``route_into_files`` has written, with max_pi and route. schema: of the stream."""
    whole = StructType([*[f for f in schema if f.name not in ("max_pi", "route")], StructField("max_pi", LongType()), StructField("route", StringType())])
    return spark.read.schema(whole).option("recursiveFileLookup", "true").parquet(folder)


def files_as_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; path: a folder or a pattern. files_per_batch bounds a micro-batch."""
    stream = spark.readStream.schema(schema)
    return (stream if files_per_batch is None else stream.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
