"""Scenario of each anomaly group, from its hours' top metrics and their contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.groups import hours_in_span

# Fixed value: share of a metric's hours a contributor needs to count as consistent.
CONSISTENT_SHARE = 0.5


def group_hours(spans: DataFrame, top: DataFrame) -> DataFrame:
    """Top metric and contributors of every anomalous hour inside each group's span.

    Hours of the other sign inside the span count too.
    """
    return hours_in_span(spans).join(top, ["tenant", "ds"]).select(
        "tenant", "group_id", "ds", "metric",
        F.when(F.size("contributors") > 0, F.col("contributors")).alias("contributors"))


def consistent_contributors(hours: DataFrame, share: float = CONSISTENT_SHARE) -> DataFrame:
    """Contributors in at least ``share`` of the metric's hours that have any."""
    keys = ["tenant", "group_id", "metric"]
    with_any = hours.where(F.col("contributors").isNotNull())
    total = with_any.groupBy(*keys).agg(F.count("*").alias("hours"))
    names = with_any.select(*keys, F.explode("contributors").alias("contributor"))
    counts = names.groupBy(*keys, "contributor").agg(F.count("*").alias("n"))
    return counts.join(total, keys).where(F.col("n") >= F.col("hours") * share)


def shared_contributors(consistent: DataFrame) -> DataFrame:
    """Contributors consistent for at least two metrics of the group."""
    return (
        consistent.groupBy("tenant", "group_id", "contributor")
        .agg(F.count("metric").alias("metrics"))
        .where(F.col("metrics") >= 2)
    )


def scenarios(spans: DataFrame, hours: DataFrame) -> DataFrame:
    """Scenario of each group.

    D: one hour or one metric.  C: several metrics, no consistent contributor.
    A: one contributor consistent for two metrics.  B: the rest.  A and B list every metric that has
    contributors in some hour, those with none that is consistent with an empty list.
    """
    keys = ["tenant", "group_id"]
    consistent = consistent_contributors(hours)
    metrics = hours.groupBy(*keys).agg(
        F.array_sort(F.collect_set("metric")).alias("metrics"),
        F.min_by("contributors", F.when(F.col("contributors").isNotNull(), F.col("ds"))).alias("first_names"))
    # Every metric with contributors, also where none of them is consistent.
    named = hours.where(F.col("contributors").isNotNull()).select(*keys, "metric", F.lit(None).cast("string").alias("contributor"))
    per_metric = consistent.select(*keys, "metric", "contributor").unionByName(named).groupBy(*keys, "metric").agg(
        F.array_sort(F.collect_list("contributor")).alias("names"))
    by_metric = per_metric.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "names")))).alias("by_metric"),
        F.max(F.size("names")).alias("most_names"))
    shared = shared_contributors(consistent).groupBy(*keys).agg(
        F.array_sort(F.collect_list("contributor")).alias("shared"))
    single_hour = F.col("start_hour") == F.col("end_hour")
    scenario = (
        F.when(single_hour | (F.size("metrics") == 1), "D")
        .when(F.coalesce(F.col("most_names"), F.lit(0)) == 0, "C")
        .when(F.col("shared").isNotNull(), "A")
        .otherwise("B")
    )
    joined = (
        spans.join(metrics, keys).join(by_metric, keys, "left").join(shared, keys, "left")
        .withColumn("scenario", scenario)
    )
    single = F.col("scenario") == "D"
    return joined.select(
        *keys, "scenario", "start_hour", "end_hour",
        F.when(F.col("sign") > 0, "Positive").otherwise("Negative").alias("sign"),
        "metrics",
        F.when(F.col("scenario") == "A", F.col("shared")).alias("shared_contributors"),
        F.when(F.col("scenario").isin("A", "B"), F.col("by_metric")).alias("metric_contributors"),
        F.when(single, F.coalesce("first_names", F.array().cast("array<string>"))).alias("contributors"),
        F.when(single, single_hour).alias("is_single_hour"))


def scenarios_json(cases: DataFrame) -> DataFrame:
    """One JSON object per case."""
    body = F.to_json(F.struct(
        F.date_format("start_hour", "yyyy-MM-dd'T'HH:mm:ss").alias("start_hour"),
        F.date_format("end_hour", "yyyy-MM-dd'T'HH:mm:ss").alias("end_hour"),
        "sign", "metrics", "shared_contributors", "metric_contributors", "contributors",
        "is_single_hour"))
    return cases.select("tenant", "group_id", "scenario", body.alias("body"))
