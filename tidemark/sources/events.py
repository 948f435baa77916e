"""Event tables: schema, reader and adapters to the canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeparts import utc_ntz

# Columns of the canonical event table.
EVENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("event_type", "event_name")]
    + [T.StructField("event_timestamp", T.TimestampNTZType())]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "shop", "page_url", "user_agent", "session_id", "client_id", "event_details_id",
            "event_details_clientid", "processed_timestamp", "events_tag_id",
        )
    ]
    + [T.StructField("price_amount", T.DoubleType())]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "price_currency", "product_id", "product_title", "product_type", "variant_id",
            "variant_sku",
        )
    ]
    + [T.StructField(name, T.IntegerType()) for name in ("screen_width", "screen_height")]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "device_type", "browser", "os", "utm_source", "utm_medium", "utm_campaign",
            "utm_content", "utm_term", "utm_id",
        )
    ]
)

# Columns that a null makes unusable for the original metrics.
CORE_COLUMNS = (
    "event_type", "event_name", "event_timestamp", "shop", "page_url", "user_agent",
    "session_id", "client_id", "event_details_id", "event_details_clientid",
)


def check_columns(df: DataFrame, schema: T.StructType, required=None) -> DataFrame:
    """Raise ``ValueError`` for a missing column or one of the wrong type."""
    wanted = {f.name: f.dataType for f in schema if required is None or f.name in required}
    have = {f.name: f.dataType for f in df.schema}
    missing = sorted(set(wanted) - set(have))
    if missing:
        raise ValueError(f"missing event columns: {', '.join(missing)}")

    def agrees(want: T.DataType, got: T.DataType) -> bool:
        times = (T.TimestampNTZType, T.TimestampType)
        if isinstance(want, times):
            return isinstance(got, times)
        if isinstance(want, (T.DoubleType, T.IntegerType)):
            return isinstance(got, T.NumericType)
        return isinstance(got, type(want))

    wrong = [n for n, t in wanted.items() if not agrees(t, have[n])]
    if wrong:
        raise ValueError("event columns of the wrong type: " + ", ".join(
            f"{n} is {have[n].simpleString()}, expected {wanted[n].simpleString()}" for n in wrong))
    return df


def without_zone(df: DataFrame, column: str = "event_timestamp") -> DataFrame:
    """Turn a zoned time column into UTC wall time."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return df.withColumn(column, utc_ntz(F.col(column)))
    return df


def read_events(spark: SparkSession, path: str, required=CORE_COLUMNS) -> DataFrame:
    """Parquet event table with the canonical columns checked."""
    return without_zone(check_columns(spark.read.parquet(path), EVENT_SCHEMA, required))


# Canonical name of each column of the second tracker.
SECOND_TRACKER_COLUMNS = {
    "event_datetime": "event_timestamp",
    "event_name": "event_name",
    "session_id": "session_id",
    "device_platform": "device_type",
    "browser_name": "browser",
    "os_name": "os",
    "country_name": "country_name",
    "search_utm_source": "utm_source",
    "search_utm_medium": "utm_medium",
    "search_utm_content": "utm_content",
    "search_utm_term": "utm_term",
}


def from_second_tracker(df: DataFrame, tenant: str = "client_id") -> DataFrame:
    """Second tracker's columns under their canonical names.

    That tracker has no visitor key of its own: the session takes its place.
    """
    missing = sorted(set(SECOND_TRACKER_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing event columns: {', '.join(missing)}")
    shop = F.col(tenant) if tenant in df.columns else F.lit("all")
    renamed = df.select(
        shop.alias("client_id"),
        *[F.col(old).alias(new) for old, new in SECOND_TRACKER_COLUMNS.items()],
        F.col("session_id").alias("event_details_clientid"),
    )
    return without_zone(renamed)
