"""Expected value and band per hourly series, and the flags that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio, rounded
from tidemark.functions.timeparts import whole_hours
from tidemark.operators.trend import break_segments

SERIES = ("tenant", "metric", "dim", "member")

# Half width of an 80 % normal band, hours on either side that the anomaly weight looks at.
BAND_WIDTH = 1.28155
WEIGHT_HOURS = 8


def seasonal_baseline(series: DataFrame, keys=SERIES, band_width: float = BAND_WIDTH,
                      weekday: bool = True, break_rounds: int = 0) -> DataFrame:
    """Adds ``yhat, yhat_lower, yhat_upper`` to ``keys + ds + y``.

    Linear trend, plus the mean remainder per hour of day, plus (with ``weekday``) the mean
    remainder per weekday, however long the series; the band is a multiple of the standard
    deviation of what is left.  A series of one point expects itself.  With ``break_rounds`` the trend is a line
    for each segment of the series between its breaks (``trend.break_segments``).

    All windows partition by the series or by more than it, so one shuffle serves them all,
    and two sorts: by series, hour of day and hour (so sums are taken in one order), then by weekday.  A series has one
    row per hour, whatever the number of events behind it.
    """
    whole = Window.partitionBy(*keys)
    by_hour = Window.partitionBy(*keys, "hour_of_day")
    by_weekday = Window.partitionBy(*keys, "weekday")
    timed = series.withColumns({"hour_of_day": F.hour("ds"), "weekday": F.weekday("ds")})
    straight = whole
    if break_rounds:
        segments = break_segments(series, keys, break_rounds)
        timed = timed.withColumn("day", F.col("ds").cast("date")).join(segments, [*keys, "day"])
        straight = Window.partitionBy(*keys, "segment")
    # A set number of partitions: the windows cost far more than the size of their rows tells
    # the adaptive planner, which would put too many series into one task.
    partitions = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        timed.repartition(partitions, *keys).sortWithinPartitions(*keys, "hour_of_day", "ds")
        .withColumn("start", F.min("ds").over(whole))
        .withColumn("x", whole_hours(F.col("start"), F.col("ds")))
        .withColumn("trend", F.coalesce(
            F.regr_slope("y", "x").over(straight) * F.col("x") + F.regr_intercept("y", "x").over(straight),
            F.avg("y").over(straight)))
        .withColumn("by_hour", F.avg(F.col("y") - F.col("trend")).over(by_hour))
        .withColumn("by_weekday", F.avg(
            F.col("y") - F.col("trend") - F.col("by_hour")).over(by_weekday) if weekday else F.lit(0.0))
        .withColumn("expected", F.col("trend") + F.col("by_hour") + F.col("by_weekday"))
        .withColumn("spread", band_width * F.coalesce(
            F.stddev_samp(F.col("y") - F.col("expected")).over(whole), F.lit(0.0)))
        .select(
            *keys, "ds", "y",
            rounded(F.col("expected")).alias("yhat"),
            rounded(F.col("expected") - F.col("spread")).alias("yhat_lower"),
            rounded(F.col("expected") + F.col("spread")).alias("yhat_upper"))
    )


def score(forecast: DataFrame) -> DataFrame:
    """Adds ``is_anomaly, diff, percent_diff`` to a forecast.

    A missing ``y`` counts as an anomaly; the percent difference is null where ``y`` is 0.
    Any forecaster that gives ``yhat, yhat_lower, yhat_upper`` fits in.  The division is done
    on decimals: with small counts its outcome often lies exactly between two roundings.
    """
    y, yhat = F.col("y").cast("decimal(24,6)"), F.col("yhat").cast("decimal(24,6)")
    inside = (F.col("y") >= F.col("yhat_lower")) & (F.col("y") <= F.col("yhat_upper"))
    return forecast.withColumns({
        "is_anomaly": F.when(inside, 0).otherwise(1),
        "diff": rounded(F.abs(F.col("yhat") - F.col("y"))),
        "percent_diff": rounded(ratio(y - yhat, y)),
    })


def anomaly_weight(scored: DataFrame, keys=SERIES, hours: int = WEIGHT_HOURS) -> DataFrame:
    """Adds ``anomaly_weight``: distance of an anomalous value to the nearest bound of the
    hours around it, 0 for other rows.  The frame holds at most ``2 * hours + 1`` rows."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    near = (
        Window.partitionBy(*keys).orderBy("hour_number")
        .rangeBetween(-hours, hours)
    )
    lowest = F.collect_list("yhat_lower").over(near)
    highest = F.collect_list("yhat_upper").over(near)
    nearest = F.array_min(F.transform(
        F.concat(lowest, highest), lambda bound: F.abs(bound - F.col("y"))))
    return (
        scored.withColumn("hour_number", whole_hours(epoch, F.col("ds")))
        .withColumn("nearest", nearest)
        .withColumn("anomaly_weight", F.when(
            F.col("is_anomaly") == 1, rounded(F.col("nearest"))).otherwise(F.lit(0.0)))
        .drop("hour_number", "nearest")
    )


def top_level(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("dim") == "total").drop("dim", "member")


def below_top(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("dim") != "total")


def contribution_share(scored: DataFrame, dim: str = "device") -> DataFrame:
    """Prediction, difference and share of the summed difference of each member, with the
    top level's values of the same hour."""
    hour = Window.partitionBy("tenant", "metric", "ds")
    members = scored.where(F.col("dim") == dim).select(
        "tenant", "metric", "ds", "member",
        F.col("yhat").alias("pred"), "diff", "percent_diff",
        rounded(F.sum("yhat").over(hour)).alias("pred_added"),
        rounded(F.sum("diff").over(hour)).alias("diff_added"),
        F.lit(0).alias("diff_sign_added"))
    top = top_level(scored).select(
        "tenant", "metric", "ds", "is_anomaly", F.col("yhat").alias("top_yhat"),
        F.col("percent_diff").alias("top_percent_diff"))
    return members.withColumn(
        "share", rounded(ratio(F.col("diff"), F.col("diff_added")))
    ).join(top, ["tenant", "metric", "ds"])


def member_percent_diff(scored: DataFrame, dims) -> DataFrame:
    """Percent difference of each member next to the top level's flag."""
    top = top_level(scored).select("tenant", "metric", "ds", "is_anomaly")
    members = scored.where(F.col("dim").isin(list(dims))).select(
        "tenant", "metric", "dim", "member", "ds", "percent_diff")
    return members.join(top, ["tenant", "metric", "ds"])
