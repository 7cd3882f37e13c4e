"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a narrow side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of its texts and binaries up to which a side may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of files a core below which a table is dealt out again.
SPREAD = 8 << 20

_local: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset and Spark runs in this
    process (tests), a temporary folder stands in; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return _local["dir"]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration())
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(jvm, conf) -> None:
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def cleanup(spark: SparkSession) -> int:
    """Deletes every table that materialize has written in this process, and says how many there were.

    It runs at the end of the process by itself. Call it in a long session when no frame that an operator returned is
    needed any more; they read these tables.
    """
    n = len(_written)
    _delete(spark._jvm, spark._jsc.hadoopConfiguration())
    return n


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a materialized df for broadcast if it has at most max_rows rows and max_bytes of texts and binaries; else leaves it
    to a shuffled join, whose hot keys adaptive execution splits."""
    long = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = sum(long, F.lit(0)).cast("long")
    rows, octets_ = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and octets_ <= max_bytes else df


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def octets(column: Column) -> Column:
    """Bytes of a text in UTF-8; null counts 0."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, steady: tuple[str, ...] = ()) -> DataFrame:
    """A table whose rows are worked on one by one: dealt out to all cores where it is a few small files, which may be one task otherwise.

    steady: the columns that are read, if rows of a task must be in the same order whenever it runs; what is dealt out is sorted by these.
    """
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    dealt = size < cores * SPREAD and df._jdf.rdd().getNumPartitions() < 2 * cores
    if steady:
        df = df.select(*steady)
        return df.repartition(cores).sortWithinPartitions(F.xxhash64(*steady)) if dealt else df
    return df.repartition(cores) if dealt else df


def give_back() -> None:
    """Returns what has been freed to the system. A worker lives on after its task, and else holds the most that it ever needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    return [b"" if x is None else x.encode() for x in texts]


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys (nulls are equal) the one whose other columns sort first; columns in df's order."""
    row = fresh(df, "row")[0]
    return df.groupBy(*keys).agg(F.min(F.struct(*df.columns)).alias(row)).select(f"{row}.*")
