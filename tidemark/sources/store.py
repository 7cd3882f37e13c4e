"""A stream kept as sorted parquet files and a manifest.

Records are dealt by shard, key and range of primary_index, and sorted within files by key and primary_index (then logged
before late ones, then by arrival, where they carry such columns). So a read of keys and a range opens the shards and parts that can
hold them, and within these the row groups whose statistics fit.

Data files are written first; then a new manifest names all parts of the stream. It is written beside and renamed
in, so readers see the parts of a whole manifest and nothing else: a write that breaks off at any point leaves no trace in
reads, and retention swaps whole versions. One writer at a time: a second one that wants the same version number fails.

Edge cases: records with a null key are in shard 0 of reads of all keys, those with a null primary_index in reads without bounds; repeated
records are kept; an empty frame adds its schema, and no part; columns beside the record's own are kept as they are, but
``shard`` and ``part`` can't be names of such.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.reads import ORDER, of_keys
from tidemark.schema import SHARDS, shard_of


@dataclass
class Part:
    path: str
    least: int | None
    largest: int | None
    rows: int


class Store:
    """base: a folder that the driver and all executors reach. Use as a context manager, or close() it."""

    def __init__(self, spark: SparkSession, base: str, shards: int = SHARDS):
        self.spark, self.base, self.shards, self.closed = spark, base.rstrip("/"), shards, False
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """After this, reads and writes fail; closing again does nothing."""
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")

    def versions(self) -> list[int]:
        folder = self._path(f"{self.base}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self) -> dict:
        """The newest manifest that is whole."""
        for n in reversed(self.versions()):
            text = self.spark.read.text(f"{self.base}/manifest/{n:012d}.json", wholetext=True).head()
            try:
                return json.loads(text[0])
            except (TypeError, ValueError):
                continue  # cut short by a file system that lost its end
        return {"parts": [], "streams": {}, "schema": None}

    def _publish(self, manifest: dict) -> None:
        n = (self.versions() or [0])[-1] + 1
        beside = self._path(f"{self.base}/manifest/_{uuid.uuid4().hex}.tmp")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        jvm, target = self.spark._jvm, self._path(f"{self.base}/manifest/{n:012d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files.rename(self._fs.makeQualified(beside), self._fs.makeQualified(target), never_over)  # fails if it exists

    def _write(self, df: DataFrame) -> Part | None:
        path = f"{self.base}/data/part={uuid.uuid4().hex}"
        order = ["secondary_index", *[c for c in ORDER if c in df.columns]]
        dealt = df.withColumn("shard", shard_of(F.col("secondary_index"), self.shards)).repartitionByRange("shard", *order[:2])
        dealt.sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(path)
        r = self._files(df.schema, [path]).agg(F.min("primary_index"), F.max("primary_index"), F.count(F.lit(1))).first()
        return Part(path, r[0], r[1], r[2]) if r[2] else None

    def _files(self, schema: StructType, paths: list[str]) -> DataFrame:
        """With the column ``shard``."""
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(0))
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/data").parquet(*paths).drop("part")

    def append(self, df: DataFrame, stream: str | None = None, number: int = 0) -> None:
        """Adds records. Batches of a named stream have ascending numbers: one up to the last that was added isn't added again."""
        self._open()
        manifest = self._manifest()
        if stream is not None and number <= manifest["streams"].get(stream, -1):
            return
        part = self._write(df)
        manifest["schema"] = manifest["schema"] or df.schema.jsonValue()
        manifest["parts"] += [vars(part)] if part else []
        manifest["streams"] |= {stream: number} if stream is not None else {}
        self._publish(manifest)

    def _schema(self, manifest: dict) -> StructType:
        if manifest["schema"] is None:
            raise ValueError("nothing was ever written")
        return StructType.fromJson(manifest["schema"])

    @staticmethod
    def _within(manifest: dict, start: int | None, end: int | None) -> list[Part]:
        """Parts that can hold records of the range, by their bounds."""
        parts = [Part(**p) for p in manifest["parts"]]
        if start is None and end is None:
            return parts
        return [p for p in parts if p.least is not None and (start is None or p.largest >= start) and (end is None or p.least <= end)]

    def zones(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """(least, largest, rows) of each part that a read of the range opens."""
        self._open()
        return self.spark.createDataFrame([(p.least, p.largest, p.rows) for p in self._within(self._manifest(), start, end)], "least long, largest long, rows long")

    def read(self, keys: int | Iterable[int] | DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """All records, or those of some keys, from start to end; parts and shards that lie outside aren't opened."""
        self._open()
        manifest = self._manifest()
        schema = self._schema(manifest)
        df = self._files(schema, [p.path for p in self._within(manifest, start, end)])
        if keys is not None:
            keys = [keys] if isinstance(keys, int) else keys if isinstance(keys, DataFrame) else sorted(set(keys))
            if not isinstance(keys, DataFrame):
                df = df.where(F.col("shard").isin(sorted({k & (self.shards - 1) for k in keys})))
            df = of_keys(df, keys)
        if start is not None:
            df = df.where(F.col("primary_index") >= start)
        if end is not None:
            df = df.where(F.col("primary_index") <= end)
        return df.select(*schema.names)

    def retain(self, cutoff: int) -> int:
        """Drops records below the cutoff, and says how many. Whole parts are dropped unread; only parts that hold both
        kinds are written anew."""
        self._open()
        manifest, kept, gone = self._manifest(), [], 0
        for p in manifest["parts"]:
            if p["least"] is None or p["least"] >= cutoff:
                kept.append(p)
            elif p["largest"] < cutoff:
                gone += p["rows"]
            else:
                old = self._files(self._schema(manifest), [p["path"]]).drop("shard")
                part = self._write(old.where(F.col("primary_index") >= cutoff))
                kept += [vars(part)] if part else []
                gone += p["rows"] - (part.rows if part else 0)
        if gone:
            self._publish(manifest | {"parts": kept})
        return gone

    def compact(self, rows: int = 1 << 20) -> int:
        """Writes parts of fewer rows as one, and says how many there were: so a long stream of small batches keeps few parts."""
        self._open()
        manifest = self._manifest()
        few = [p for p in manifest["parts"] if p["rows"] < rows]
        if len(few) < 2:
            return 0
        part = self._write(self._files(self._schema(manifest), [p["path"] for p in few]).drop("shard"))
        self._publish(manifest | {"parts": [p for p in manifest["parts"] if p not in few] + [vars(part)]})
        return len(few)

    def vacuum(self) -> None:
        """Deletes older manifests and data that the newest doesn't name. No reader may still use them."""
        self._open()
        named = {p["path"].rsplit("/", 1)[1] for p in self._manifest()["parts"]}
        for s in self._fs.listStatus(self._path(f"{self.base}/manifest")) if self.versions() else []:
            if s.getPath().getName() != f"{self.versions()[-1]:012d}.json":
                self._fs.delete(s.getPath(), False)
        folder = self._path(f"{self.base}/data")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
