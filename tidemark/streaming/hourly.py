"""The hourly operators over an event stream.

State is bounded by the watermark.  Event time is cast to ``timestamp``, the type that
watermarks take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.groups import GAP_HOURS


def event_stream(spark, schema, path: str, **options) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def timed(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def hourly_counts(events: DataFrame, member: str, time: str = "event_timestamp", by=(),
                  delay: str = "1 hour") -> DataFrame:
    """Rows per hour and member; an hour is given out once the watermark has passed it."""
    window = F.window(time, "1 hour")
    counts = timed(events, time, delay).groupBy(*by, window.alias("hour"), F.col(member).alias("member"))
    return counts.agg(F.count("*").alias("n")).select(
        *by, F.col("hour.start").cast("timestamp_ntz").alias("time"), "member", "n")


def unique_keys(events: DataFrame, keys, time: str = "event_timestamp", delay: str = "1 day") -> DataFrame:
    """First arrival of each key; repeats within the watermark are dropped."""
    return timed(events, time, delay).dropDuplicatesWithinWatermark(list(keys))


def anomaly_groups(signed: DataFrame, time: str = "ds", gap: int = GAP_HOURS, delay: str = "1 day") -> DataFrame:
    """Same-sign anomalous hours at most ``gap`` hours apart, as session windows."""
    hours = timed(signed, time, delay)
    window = F.session_window(time, f"{gap} hours")
    groups = hours.groupBy("tenant", "sign", window.alias("span")).agg(
        F.min(time).alias("start_hour"), F.max(time).alias("end_hour"), F.count("*").alias("hours"))
    return groups.select(
        "tenant", "sign", F.col("start_hour").cast("timestamp_ntz").alias("start_hour"),
        F.col("end_hour").cast("timestamp_ntz").alias("end_hour"), "hours")
