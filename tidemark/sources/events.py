"""The events table as a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: arrival_seq per bucket of about 65,536 arrivals: what one window sorts at once.
ARRIVAL_SPAN = 1 << 36


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def as_stream(events: DataFrame) -> DataFrame:
    """Records keyed by user, in a shuffled order of arrival that gives every route. value stands in for the payload."""
    e = F.col("event_id")
    return events.select(
        "event_id",
        F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("primary_index"),
        F.col("user_id").cast("int").alias("secondary_index"),
        (e % 3 + 1).cast("int").alias("version"),
        "value",
        ((e + (e * 7919) % 2003) * 1_048_576 + e).alias("arrival_seq"),
    )
