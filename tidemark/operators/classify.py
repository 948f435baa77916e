"""Confidence score and true or false positive per anomaly group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import at_most_one, exact_mean, ratio, rounded
from tidemark.functions.timeparts import hours

# Base score per scenario, weights, full-score sizes and the cut.
BASE_SCORES = {"A": 0.8, "B": 0.6, "C": 0.4, "D": 0.3}
HISTORY_WEIGHT = 0.4
METRICS_WEIGHT = 0.2
DURATION_WEIGHT = 0.2
FULL_METRICS = 5
FULL_HOURS = 24
TRUE_POSITIVE_FROM = 0.5


def _two(value: Column) -> Column:
    """Two digits, half away from zero, from the six places of the library."""
    return F.round(value.cast("decimal(18,6)"), 2).cast("string")


def classify(cases: DataFrame, top_history: DataFrame) -> DataFrame:
    """Score and class of each scenario case, with the parts of the score.

    ``top_history`` has the top-level rows of the historical changes.
    """
    labels = top_history.groupBy("tenant", "start_hour").agg(
        F.sum(F.when(F.col("vs_prev_day") == "Significant", 1).otherwise(0)
              + F.when(F.col("vs_prev_week") == "Significant", 1).otherwise(0)).alias("significant"),
        (F.count("*") * 2).alias("comparisons"))
    base = F.lit(None).cast("double")
    for scenario, value in BASE_SCORES.items():
        base = F.when(F.col("scenario") == scenario, value).otherwise(base)
    return (
        cases.join(labels, ["tenant", "start_hour"], "left")
        .withColumn("duration_hours", hours(F.col("start_hour"), F.col("end_hour")))
        .withColumn("base_score", base)
        .withColumn("history_share", ratio(F.col("significant"), F.col("comparisons")))
        .withColumn("history_part", F.coalesce(F.col("history_share") * HISTORY_WEIGHT, F.lit(0.0)))
        .withColumn("metrics_part", at_most_one(F.size("metrics") / FULL_METRICS) * METRICS_WEIGHT)
        .withColumn("duration_part", at_most_one(F.col("duration_hours") / FULL_HOURS) * DURATION_WEIGHT)
        .withColumn("confidence_score", rounded(
            F.col("base_score") + F.col("history_part") + F.col("metrics_part") + F.col("duration_part")))
        .withColumn("classification", F.when(
            F.col("confidence_score") >= TRUE_POSITIVE_FROM, "TP").otherwise("FP"))
        .select(
            "tenant", "group_id", "start_hour", "end_hour", "classification", "confidence_score",
            F.col("scenario").alias("scenario_type"), "metrics", "duration_hours", "base_score",
            "history_share", "history_part", "metrics_part", "duration_part")
    )


def reasons(classified: DataFrame) -> DataFrame:
    """Adds the score's parts as a list of sentences."""
    history = F.when(F.col("history_share").isNotNull(), F.concat(
        F.lit("Historical consistency: "), _two(F.col("history_share")),
        F.lit(" (contributes "), _two(F.col("history_part")), F.lit(")")))
    return classified.withColumn("reasoning", F.array_compact(F.array(
        F.concat(F.lit("Base score (Scenario "), F.col("scenario_type"), F.lit("): "), _two(F.col("base_score"))),
        history,
        F.concat(F.lit("Metric count bonus: "), _two(F.col("metrics_part"))),
        F.concat(F.lit("Duration bonus: "), _two(F.col("duration_part"))),
        F.concat(F.lit("Total confidence score: "), _two(F.col("confidence_score"))))))


def classification_summary(classified: DataFrame, by=()) -> DataFrame:
    """Counts, share of true positives and mean confidence per class."""
    true, false = F.col("classification") == "TP", F.col("classification") == "FP"
    score = F.col("confidence_score")
    return classified.groupBy(*by).agg(
        F.count("*").alias("total_anomalies"),
        F.count_if(true).alias("tp_count"),
        F.count_if(false).alias("fp_count"),
        rounded(F.coalesce(ratio(F.count_if(true), F.count("*")), F.lit(0.0))).alias("tp_share"),
        F.coalesce(rounded(exact_mean(F.when(true, score))), F.lit(0.0)).alias("tp_avg_confidence"),
        F.coalesce(rounded(exact_mean(F.when(false, score))), F.lit(0.0)).alias("fp_avg_confidence"))


def scenario_breakdown(classified: DataFrame, by=()) -> DataFrame:
    """True and false positives per scenario."""
    return classified.groupBy(*by, "scenario_type").agg(
        F.count_if(F.col("classification") == "TP").alias("TP"),
        F.count_if(F.col("classification") == "FP").alias("FP"))
