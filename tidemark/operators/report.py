"""Hour spine, hour report and what each hour's anomalies say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import any_contains, as_text
from tidemark.functions.numbers import percent_text
from tidemark.functions.timeparts import stamp, truncate
from tidemark.operators.baseline import top_level
from tidemark.plans.profiles import each_of

#: Days of the longest spine; a shop with more (as by an event dated far ahead) raises.
SPINE_DAYS = 7320


def hour_spine(series: DataFrame, start: Column | None = None, end: Column | None = None,
               most_days: int = SPINE_DAYS) -> DataFrame:
    """Every hour from the shop's first to its last one, or from ``start`` to before ``end``.

    Days are listed first and dealt out by shop and day, then each day's hours, so no shop's spine is
    an array or a task of its own.  More than ``most_days`` days raise an error that names the shop.
    """
    bounds = series.groupBy("tenant").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    first = F.col("first") if start is None else truncate(start)
    last = F.col("last") if end is None else truncate(end - F.expr("interval 1 microsecond"))
    spans = bounds.select("tenant", first.alias("first"), last.alias("last"))
    days = F.datediff(F.col("last").cast("date"), F.col("first").cast("date"))
    too_long = F.raise_error(F.concat(
        F.lit("the hours of shop "), F.coalesce("tenant", F.lit("null")), F.lit(" span "), F.col("first").cast("string"), F.lit(" to "),
        F.col("last").cast("string"), F.lit(f", more than {most_days} days: bound them with start and end")))
    day = F.sequence(F.col("first").cast("date"), F.when(days > most_days, too_long.cast("date")).otherwise(F.col("last").cast("date")))
    listed = spans.select("tenant", "first", "last", F.explode(day).alias("day")).repartition("tenant", "day")
    hourly = listed.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    hour = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    return hourly.select("tenant", "first", "last", hour.alias("ds")).where("ds >= first AND ds <= last").select("tenant", "ds")


def hour_metrics(scored: DataFrame, metric_rows: list[dict], contributors: DataFrame,
                 start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Long hour report: flag, percent difference and contributors per spine hour and metric.

    An hour without a row in the series gets flag 0 and difference 0.  Contributors only
    appear where the metric is anomalous.
    """
    top = top_level(scored).select(
        "tenant", "metric", "ds", "y", F.col("is_anomaly").alias("flag"),
        F.col("percent_diff").alias("change"))
    grid = hour_spine(scored, start, end).select("tenant", "ds", F.inline(each_of(metric_rows)))
    return (
        grid.join(top, ["tenant", "metric", "ds"], "left")
        .join(contributors, ["tenant", "metric", "ds"], "left")
        .select(
            "tenant", "ds", "metric", "metric_ord", "priority", "funnel_rank", "y",
            F.coalesce("flag", F.lit(0)).alias("anomaly"),
            F.when(F.col("flag").isNull(), 0.0).otherwise(F.col("change")).alias("percent_diff"),
            F.when(F.col("flag") == 1, F.col("contributors")).alias("contributors"))
    )


def hour_events(hour_report: DataFrame) -> DataFrame:
    """Hour table: every spine hour with the anomalous metrics in report order."""
    return hour_report.groupBy("tenant", "ds").agg(
        F.array_sort(F.collect_list(F.when(
            F.col("anomaly") == 1, F.struct("metric_ord", "metric")))).alias("found")
    ).select("tenant", F.col("ds").alias("hour"),
             F.transform("found", lambda m: m["metric"]).alias("event_names"))


def member_report(scored: DataFrame, member_rows: list[dict],
                  start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Percent difference of every registered member at every spine hour, missing rows 0."""
    below = [r for r in member_rows if r["dim"] != "total"]
    grid = hour_spine(scored, start, end).select("tenant", "ds", F.inline(each_of(below)))
    known = scored.select("tenant", "metric", "dim", "member", "ds", "percent_diff", F.lit(1).alias("known"))
    return grid.join(known, ["tenant", "metric", "dim", "member", "ds"], "left").select(
        "tenant", "ds", "metric", "dim", "member", "ord",
        F.when(F.col("known").isNull(), 0.0).otherwise(F.col("percent_diff")).alias("percent_diff"))


def _picked(metric: str, value: Column | str) -> Column:
    return F.max(F.when(F.col("metric") == metric, F.col(value) if isinstance(value, str) else value))


def wide_report(hour_report: DataFrame, metrics) -> DataFrame:
    """One row per hour: flag, percent difference, contributors of each metric, any flag."""
    columns = []
    for m in metrics:
        columns += [
            _picked(m, "anomaly").alias(f"{m}_anomaly"),
            _picked(m, "percent_diff").alias(f"{m}_percent_diff"),
            _picked(m, "contributors").alias(f"{m}_contributors"),
        ]
    wide = hour_report.groupBy("tenant", F.col("ds").alias("hour")).agg(*columns)
    flags = [F.col(f"{m}_anomaly") for m in metrics]
    return wide.withColumn("has_anomaly", F.greatest(*flags) if len(flags) > 1 else flags[0])


def member_columns(member_rows: list[dict]) -> list[Column]:
    """A ``<metric>_<dim>_<member>_percent_diff`` aggregate per member."""
    return [
        F.max(F.when(
            (F.col("metric") == r["metric"]) & (F.col("dim") == r["dim"]) & (F.col("member") == r["member"]),
            F.col("percent_diff"))).alias(f"{r['metric']}_{r['dim']}_{r['member']}_percent_diff")
        for r in member_rows if r["dim"] != "total"
    ]


def wide_member_report(members_long: DataFrame, member_rows: list[dict]) -> DataFrame:
    """One row per hour with the percent difference of every member."""
    return members_long.groupBy("tenant", F.col("ds").alias("hour")).agg(*member_columns(member_rows))


def hour_sign(scored: DataFrame, hour_report: DataFrame, members: DataFrame,
              sign_rule: str = "first_nonzero") -> DataFrame:
    """Anomalous hours with the sign (+1 or -1) of the first percent difference, in report
    column order, that is neither missing nor 0.  Hours without one are left out.

    ``sign_rule='top_metric'`` takes the sign of the hour's highest-priority metric instead.
    """
    flagged = hour_report.where(F.col("anomaly") == 1)
    if sign_rule == "top_metric":
        top = top_event(hour_report)
        return top.where(F.col("percent_diff") != 0).select(
            "tenant", "ds", F.signum("percent_diff").cast("int").alias("sign"))
    if sign_rule != "first_nonzero":
        raise ValueError(f"unknown sign rule {sign_rule!r}")
    ordered = scored.where(F.col("percent_diff") != 0).join(
        members.select("metric", "dim", "member", "ord"), ["metric", "dim", "member"])
    sign = ordered.groupBy("tenant", "ds").agg(
        F.min_by(F.signum("percent_diff").cast("int"), "ord").alias("sign"))
    return flagged.select("tenant", "ds").distinct().join(sign, ["tenant", "ds"])


def top_event(hour_report: DataFrame) -> DataFrame:
    """Highest-priority anomalous metric of each hour, ties in report order."""
    return (
        hour_report.where(F.col("anomaly") == 1)
        .groupBy("tenant", "ds")
        .agg(
            F.min(F.struct("priority", "metric_ord", "metric", "percent_diff", "contributors")).alias("top"))
        .select("tenant", "ds", "top.metric", "top.percent_diff", "top.contributors")
    )


def metric_summary(hours: DataFrame, contributors: DataFrame, metrics) -> DataFrame:
    """Per shop and metric: hours whose list names the metric, and the contributor seen most
    often in them (ties by name) with its count."""
    named = F.explode(F.array_compact(F.array(*[
        F.when(any_contains(F.col("event_names"), m), F.lit(m)) for m in metrics])))
    hits = hours.select("tenant", F.col("hour").alias("ds"), named.alias("metric"))
    counts = hits.groupBy("tenant", "metric").agg(F.count("*").alias("anomalies"))
    names = (
        hits.join(contributors, ["tenant", "metric", "ds"])
        .select("tenant", "metric", F.explode("contributors").alias("name"))
        .groupBy("tenant", "metric", "name").agg(F.count("*").alias("n"))
        .groupBy("tenant", "metric").agg(
            F.min(F.struct((-F.col("n")).alias("rank"), "name")).alias("top"))
    )
    return counts.join(names, ["tenant", "metric"], "left").select(
        "tenant", "metric", "anomalies",
        F.col("top.name").alias("top_contributor"), (-F.col("top.rank")).alias("occurrences"))


def percent_diff_at(points: DataFrame, scored: DataFrame) -> DataFrame:
    """Top-level percent difference for each ``(tenant, metric, ds)`` of ``points``."""
    top = top_level(scored).select("tenant", "metric", "ds", "percent_diff")
    return points.join(top, ["tenant", "metric", "ds"], "left")


def merged_wide(scored: DataFrame, member_rows: list[dict],
                metrics=("visitors", "orders", "buyers")) -> DataFrame:
    """Flags, values, percent differences and member contributions of the chosen metrics
    side by side, for hours the first metric has, with the list of anomalous metrics."""
    columns = []
    for m in metrics:
        columns += [
            _picked(m, F.when(F.col("dim") == "total", F.col("is_anomaly"))).alias(f"{m}_anomaly"),
            _picked(m, F.when(F.col("dim") == "total", F.col("y"))).alias(f"{m}_value"),
            _picked(m, F.when(F.col("dim") == "total", F.col("percent_diff"))).alias(f"{m}_percent_diff"),
        ]
    for r in member_rows:
        if r["metric"] in metrics and r["dim"] != "total":
            at = (F.col("dim") == r["dim"]) & (F.col("member") == r["member"])
            columns.append(_picked(r["metric"], F.when(at, F.col("percent_diff"))).alias(
                f"{r['metric']}_{r['dim']}_{r['member']}_contribution"))
    wide = scored.where(F.col("metric").isin(list(metrics))).groupBy("tenant", "ds").agg(*columns)
    wide = wide.where(F.col(f"{metrics[0]}_anomaly").isNotNull())
    texts = [
        F.when(F.col(f"{m}_anomaly") == 1, F.concat(
            F.lit(f"{m} %diff: "), F.coalesce(F.format_string(
                "%.1f%%", F.round(F.col(f"{m}_percent_diff") * 100, 1)), F.lit("n/a"))))
        for m in metrics
    ]
    return wide.withColumns({
        "time_hour": F.hour("ds"),
        "anomalous_metrics": F.array_compact(F.array(*texts)),
    })


def hour_annotations(hour_report: DataFrame, contributors: DataFrame, scored: DataFrame) -> DataFrame:
    """Text and colour of every spine hour: visitors, highest-priority metric with its overall
    change, and the metric's contributors with their own changes."""
    visitors = hour_report.where(F.col("metric") == "visitors").select("tenant", "ds", "y")
    top = top_event(hour_report).select(
        "tenant", "ds", "metric", F.col("percent_diff").alias("change"))
    own = (
        contributors.select("tenant", "metric", "dim", "ds", F.explode("contributors").alias("member"))
        .join(scored.select("tenant", "metric", "dim", "member", "ds", "percent_diff"),
              ["tenant", "metric", "dim", "member", "ds"], "left")
        .groupBy("tenant", "metric", "ds")
        .agg(F.array_sort(F.collect_list(F.concat(
            "member", F.lit(" ("), percent_text(F.coalesce("percent_diff", F.lit(0.0))), F.lit(")")))
        ).alias("names"))
    )
    joined = visitors.join(top, ["tenant", "ds"], "left").join(own, ["tenant", "metric", "ds"], "left")
    listed = F.coalesce(as_text(F.col("names")), F.lit("N/A"))
    text = F.concat(
        F.lit("Time: "), stamp(F.col("ds")),
        F.lit(" | Visitors: "), F.coalesce(F.col("y").cast("string"), F.lit("N/A")),
        F.when(F.col("metric").isNull(), F.lit("")).otherwise(F.concat(
            F.lit(" | Anomaly: "), F.col("metric"),
            F.lit(" (Overall Change: "), F.coalesce(percent_text(F.col("change")), F.lit("N/A")), F.lit(")"),
            F.lit(" (Contributors: "), listed, F.lit(")"))))
    colour = F.when(F.col("metric").isNotNull(), F.when(F.col("change") > 0, "green").otherwise("red"))
    return joined.select(
        "tenant", F.col("ds").alias("hour"), "metric", "change", colour.alias("colour"), text.alias("text"))
