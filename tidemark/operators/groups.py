"""Groups of neighbouring anomalous hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import as_text, union_of_lists
from tidemark.functions.numbers import exact_mean, rounded
from tidemark.functions.timeparts import hours, label, whole_hours
from tidemark.operators.report import member_columns

# Longest gap inside a group, share of upstream anomalies for a funnel effect.
GAP_HOURS = 3
UPSTREAM_SHARE = 0.5


def _islands(df: DataFrame, keys, breaks: Column, order: str = "ds") -> DataFrame:
    """Running number of the island each row is in; ``breaks`` starts a new one."""
    run = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("breaks", breaks).withColumn(
        "island", F.sum(F.when(F.col("breaks"), 1).otherwise(0)).over(
            run.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("breaks")


def anomaly_groups(signed: DataFrame, gap: int = GAP_HOURS) -> DataFrame:
    """Same-sign groups: an hour belongs to the group of any hour of its sign at most ``gap``
    hours away.  Groups of both signs may interleave; ids follow the first hour."""
    run = Window.partitionBy("tenant", "sign").orderBy("ds")
    apart = whole_hours(F.lag("ds").over(run), F.col("ds")) > gap
    rows = _islands(signed, ["tenant", "sign"], F.coalesce(apart, F.lit(False)))
    start = F.min("ds").over(Window.partitionBy("tenant", "sign", "island"))
    return rows.withColumn("start_hour", start).select(
        "tenant",
        F.dense_rank().over(Window.partitionBy("tenant").orderBy("start_hour")).alias("group_id"),
        "sign", "ds")


def group_spans(grouped: DataFrame, min_hours: int = 1) -> DataFrame:
    """Start, end, sign and number of anomalous hours of each group."""
    return (
        grouped.groupBy("tenant", "group_id")
        .agg(F.first("sign").alias("sign"), F.min("ds").alias("start_hour"),
             F.max("ds").alias("end_hour"), F.count("*").alias("hours"))
        .where(F.col("hours") >= min_hours)
    )


def summary_groups(top: DataFrame, gap: int = GAP_HOURS) -> DataFrame:
    """Chronological groups of anomalous hours: a new one after more than ``gap`` hours or
    when the direction of the hour's highest-priority metric changes."""
    run = Window.partitionBy("tenant").orderBy("ds")
    rows = top.withColumn("positive", F.coalesce(F.col("percent_diff") > 0, F.lit(False)))
    breaks = (whole_hours(F.lag("ds").over(run), F.col("ds")) > gap) | (
        F.lag("positive").over(run) != F.col("positive"))
    return _islands(rows, ["tenant"], F.coalesce(breaks, F.lit(False))).select(
        "tenant", (F.col("island") + 1).alias("group_id"), "positive", "ds", "metric",
        "percent_diff", "contributors")


def summary_spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant", "group_id").agg(
        F.first("positive").alias("positive"), F.min("ds").alias("start_hour"),
        F.max("ds").alias("end_hour"), F.count("*").alias("hours"))


def long_groups(spans: DataFrame, longer_than: int = 1) -> DataFrame:
    """Groups whose span is more than ``longer_than`` hours."""
    return spans.where(hours(F.col("start_hour"), F.col("end_hour")) > longer_than)


def group_labels(spans: DataFrame) -> DataFrame:
    return spans.withColumn("period", F.concat(
        label(F.col("start_hour")), F.lit(" - "), label(F.col("end_hour"))))


def group_duration(spans: DataFrame) -> DataFrame:
    return spans.withColumn("duration_hours", hours(F.col("start_hour"), F.col("end_hour")))


def hours_in_span(spans: DataFrame, keys=("tenant", "group_id"), shift: Column | None = None) -> DataFrame:
    """Every hour from start to end of each group.

    Turns a range join into an equi join on the hour.  Groups of one sign do not overlap, so
    the rows stay within a small multiple of the shop's hours.
    """
    first, last = F.col("start_hour"), F.col("end_hour")
    if shift is not None:
        first, last = first - shift, last - shift
    return spans.select(*keys, F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("ds"))


def group_metrics(grouped: DataFrame, hour_report: DataFrame) -> DataFrame:
    """Per group and metric: anomalies, mean percent difference, merged contributors."""
    rows = grouped.select("tenant", "group_id", "ds").join(hour_report, ["tenant", "ds"])
    return rows.groupBy("tenant", "group_id", "metric", "metric_ord", "priority", "funnel_rank").agg(
        F.sum("anomaly").alias("anomalies"),
        F.coalesce(rounded(exact_mean(F.col("percent_diff"))), F.lit(0.0)).alias("percent_diff"),
        union_of_lists(F.collect_set("contributors")).alias("contributors"))


def group_members(grouped: DataFrame, members_long: DataFrame) -> DataFrame:
    """Per group and member: mean percent difference."""
    rows = grouped.select("tenant", "group_id", "ds").join(members_long, ["tenant", "ds"])
    return rows.groupBy("tenant", "group_id", "metric", "dim", "member").agg(
        F.coalesce(rounded(exact_mean(F.col("percent_diff"))), F.lit(0.0)).alias("percent_diff"))


def wide_group_members(per_member: DataFrame, member_rows: list[dict]) -> DataFrame:
    """One row per group with the mean percent difference of every member."""
    return per_member.groupBy("tenant", "group_id").agg(*member_columns(member_rows))


def root_cause(per_metric: DataFrame, share: float = UPSTREAM_SHARE) -> DataFrame:
    """Where a group comes from.

    The metric with most anomalies (ties by priority, then report order).  When the metrics
    above it in the funnel have at least ``share`` of its anomalies, the busiest of them is
    named as the origin; contributors follow in brackets.
    """
    main = per_metric.groupBy("tenant", "group_id").agg(F.min(F.struct(
        (-F.col("anomalies")).alias("rank"), "priority", "metric_ord", "metric", "funnel_rank",
        "contributors")).alias("main"))
    above = (
        per_metric.join(main, ["tenant", "group_id"])
        .where(F.col("funnel_rank") < F.col("main.funnel_rank"))
        .groupBy("tenant", "group_id")
        .agg(F.sum("anomalies").alias("above"),
             F.min(F.struct((-F.col("anomalies")).alias("rank"), "funnel_rank", "metric",
                            "contributors")).alias("origin"))
    )
    funnel = F.coalesce(F.col("above") >= -F.col("main.rank") * share, F.lit(False))
    names = F.when(funnel, F.col("origin.contributors")).otherwise(F.col("main.contributors"))
    metric = F.when(funnel, F.col("origin.metric")).otherwise(F.col("main.metric"))
    text = F.concat(
        F.when(funnel, "Funnel effect from ").otherwise("Direct anomaly in "), metric,
        F.when(F.size(names) > 0, F.concat(F.lit(" ("), as_text(names), F.lit(")"))).otherwise(""))
    return main.join(above, ["tenant", "group_id"], "left").select(
        "tenant", "group_id", F.col("main.metric").alias("main_metric"), text.alias("root_cause"))


def group_report(grouped: DataFrame, per_metric: DataFrame, metrics, min_hours: int = 1) -> DataFrame:
    """One row per group: span, sign, root cause, and per metric its anomalies, mean percent
    difference and contributors."""
    columns = []
    for m in metrics:
        here = F.col("metric") == m
        columns += [
            F.max(F.when(here, F.col("anomalies"))).alias(f"{m}_anomaly"),
            F.max(F.when(here, F.col("percent_diff"))).alias(f"{m}_percent_diff"),
            F.max(F.when(here, F.col("contributors"))).alias(f"{m}_contributors"),
        ]
    wide = per_metric.groupBy("tenant", "group_id").agg(*columns)
    return (
        group_spans(grouped, min_hours)
        .join(root_cause(per_metric), ["tenant", "group_id"])
        .join(wide, ["tenant", "group_id"])
        .drop("main_metric")
    )
