"""Summary lines of the chronological groups, and the patterns behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import as_text
from tidemark.operators.baseline import top_level
from tidemark.operators.groups import group_labels, long_groups, summary_spans

# Fixed value: relative change that counts as one.
CHANGE = 0.1


def summary_lines(rows: DataFrame, combined: DataFrame, metrics: DataFrame) -> DataFrame:
    """One line per chronological group: period, direction, and per top metric its number of
    hours and its contributors in the group's first hour."""
    spans = summary_spans(rows)
    counts = rows.groupBy("tenant", "group_id", "metric").agg(F.count("*").alias("n"))
    at_start = counts.join(spans.select("tenant", "group_id", F.col("start_hour").alias("ds")), ["tenant", "group_id"])
    parts = (
        at_start.join(combined, ["tenant", "metric", "ds"], "left")
        .join(metrics.select("metric", "priority", "metric_ord"), "metric")
        .withColumn("part", F.concat(
            "metric", F.lit(" ("), F.col("n").cast("string"), F.lit(")"),
            F.when(F.size("contributors") > 0, F.concat(F.lit(": "), as_text(F.col("contributors")))).otherwise("")))
        .groupBy("tenant", "group_id")
        .agg(F.array_sort(F.collect_list(F.struct("priority", "metric_ord", "part"))).alias("parts"))
    )
    line = F.concat(
        F.col("period"), F.lit(": "), F.when(F.col("positive"), "Positive ").otherwise("Negative "),
        F.array_join(F.transform("parts", lambda p: p["part"]), "; "))
    return group_labels(spans).join(parts, ["tenant", "group_id"]).select(
        "tenant", "group_id", "start_hour", "end_hour", line.alias("line"))


def funnel_pattern(rows: DataFrame, scored: DataFrame, change: float = CHANGE) -> DataFrame:
    """Traffic against orders at the start of every long group that has both as top metrics."""
    both = rows.groupBy("tenant", "group_id").agg(
        F.max(F.col("metric") == "visitors").alias("has_visitors"),
        F.max(F.col("metric") == "orders").alias("has_orders"))
    groups = long_groups(summary_spans(rows)).join(
        both.where(F.col("has_visitors") & F.col("has_orders")), ["tenant", "group_id"])
    at = top_level(scored).groupBy("tenant", F.col("ds").alias("start_hour")).agg(
        F.max(F.when(F.col("metric") == "visitors", F.col("percent_diff"))).alias("traffic_change"),
        F.max(F.when(F.col("metric") == "orders", F.col("percent_diff"))).alias("orders_change"))
    traffic, orders = F.col("traffic_change"), F.col("orders_change")
    pattern = (
        F.when((F.abs(traffic) < change) & (F.abs(orders) > change), "orders changed, traffic stable")
        .when((traffic > change) & (orders <= 0), "traffic up, orders flat or down")
        .when((traffic > change) & (orders > change), "traffic and orders up")
        .otherwise("no intuitive pattern")
    )
    return groups.join(at, ["tenant", "start_hour"], "left").select(
        "tenant", "group_id", "start_hour", "end_hour", "traffic_change", "orders_change",
        pattern.alias("pattern"))


def hierarchy_pattern(rows: DataFrame, scored: DataFrame, by_dim: DataFrame, change: float = CHANGE) -> DataFrame:
    """Top-level change against contributor changes at the start of each long group, per top
    metric, with the dimensions that changed."""
    keys = ["tenant", "group_id", "metric"]
    groups = long_groups(summary_spans(rows)).select("tenant", "group_id", F.col("start_hour").alias("ds"))
    wanted = rows.select(*keys).distinct().join(groups, ["tenant", "group_id"])
    top = top_level(scored).select("tenant", "metric", "ds", F.col("percent_diff").alias("top_change"))
    changes = (
        by_dim.select("tenant", "metric", "dim", "ds", F.explode("contributors").alias("member"))
        .join(scored.select("tenant", "metric", "dim", "member", "ds", "percent_diff"),
              ["tenant", "metric", "dim", "member", "ds"], "left")
        .withColumn("moved", F.abs(F.coalesce("percent_diff", F.lit(0.0))) > change)
        .groupBy("tenant", "metric", "ds")
        .agg(F.max("moved").alias("any_moved"),
             F.array_sort(F.collect_set(F.when(F.col("moved"), F.col("dim")))).alias("moved_dims"))
    )
    high, low = F.abs(F.col("top_change")) > change, F.abs(F.col("top_change")) <= change
    pattern = (
        F.when(high & F.col("any_moved"), "top level and members")
        .when(high & ~F.col("any_moved"), "top level only")
        .when(low & F.col("any_moved"), "members only")
    )
    return (
        wanted.join(top, ["tenant", "metric", "ds"], "left")
        .join(changes, ["tenant", "metric", "ds"], "left")
        .select(*keys, F.col("ds").alias("start_hour"), "top_change",
                F.coalesce("moved_dims", F.array().cast("array<string>")).alias("moved_dims"),
                pattern.alias("pattern"))
    )
