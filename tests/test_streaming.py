"""Stream and batch give the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.sql import BROWSER
from tidemark.operators import cube as Q
from tidemark.operators import groups as G
from tidemark.streaming import hourly as H

SF_DIR = "/root/testdata/sf0.001"
FAR = dt.datetime(2030, 1, 1)


def drained(stream, folder, mode="append"):
    """Rows of a stream run to the end of its input."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def source(spark, df, folder, closing):
    """Write events and one far later row that moves the watermark past all others."""
    df.repartition(3).write.parquet(f"{folder}/in")
    closing.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return H.event_stream(spark, df.schema, f"{folder}/in")


def test_hourly_counts(spark, tmp_path):
    events = T.browser_events(spark, SF_DIR).select("event_timestamp", "client_id", BROWSER.geo().alias("geo"))
    closing = events.limit(1).withColumn("event_timestamp", F.lit(FAR))
    stream = H.hourly_counts(source(spark, events, tmp_path, closing), "geo", by=["client_id"])
    got = drained(stream, tmp_path)
    want = Q.hourly_counts(events, "geo", by=["client_id"]).drop("time_hour").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_unique_keys(spark, tmp_path):
    events = T.browser_events(spark, SF_DIR).select("event_timestamp", "client_id", "event_details_clientid")
    closing = events.limit(1).withColumn("event_details_clientid", F.lit("last"))
    stream = H.unique_keys(source(spark, events, tmp_path, closing), ["client_id", "event_details_clientid"], delay="60 days")
    got = drained(stream, tmp_path).select("client_id", "event_details_clientid")
    want = events.select("client_id", "event_details_clientid").distinct()
    assert got.where("event_details_clientid <> 'last'").exceptAll(want).count() == 0
    assert got.count() == want.count() + 1


def test_groups(spark, tmp_path):
    hours = [(0, 1), (3, 1), (7, 1), (8, -1), (9, 1), (20, -1), (23, -1), (27, -1)]
    start = dt.datetime(2024, 1, 1)
    signed = spark.createDataFrame(
        [("t", start + dt.timedelta(hours=h), s) for h, s in hours], "tenant string, ds timestamp_ntz, sign int")
    closing = spark.createDataFrame([("t", FAR, 1)], signed.schema)
    got = drained(H.anomaly_groups(source(spark, signed, tmp_path, closing)), tmp_path)
    want = G.group_spans(G.anomaly_groups(signed)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
