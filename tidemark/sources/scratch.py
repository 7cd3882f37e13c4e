"""Folders for tables that queries make on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []
_local: list[str] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new name below ``spark.checkpoint.dir``; what is written there is deleted when the process ends.

    Where that is unset, a temporary folder stands in for a session in this process; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tidemark-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = _local[0]
    if not _made:
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration())
    _made.append(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(jvm, conf) -> None:
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def cleanup(spark: SparkSession) -> int:
    """Deletes all these tables at once, and says how many there were; no frame that reads one may be used afterwards."""
    n = len(_made)
    with contextlib.suppress(FileNotFoundError):
        _delete(spark._jvm, spark._jsc.hadoopConfiguration())
    return n
