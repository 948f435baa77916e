"""Each group's window compared with the same window one day and one week earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import exact_mean, rounded
from tidemark.operators.groups import hours_in_span
from tidemark.plans.profiles import each_of

# Percentage points that make a change significant, days back per window.
SIGNIFICANT_POINTS = 10
WINDOWS = {"current": 0, "prev_day": 1, "prev_week": 7}

HISTORY_SCHEMA = (
    "array<struct<metric:string,dim:string,member:string,current_value:double,"
    "prev_day_value:double,prev_week_value:double,vs_prev_day:string,vs_prev_week:string,"
    "prev_day_change_pct:double,prev_week_change_pct:double>>"
)


def _label(rows: Column, now_rows: Column, change: Column) -> Column:
    no_rows = (F.coalesce(rows, F.lit(0)) == 0) | (F.coalesce(now_rows, F.lit(0)) == 0)
    return F.when(no_rows, "No data").when(F.abs(change) > SIGNIFICANT_POINTS, "Significant").otherwise("Similar")


def historical_changes(spans: DataFrame, scored: DataFrame, member_rows: list[dict]) -> DataFrame:
    """Mean percent difference (in percent) of each series in the group's window, the day and
    the week before, with changes and labels.

    ``member_rows`` lists the series to report, so one without rows still appears.  A window without rows gives "No data"; one whose values are all missing gives
    "Similar".  The windows' hours are spelled out, which makes the range join an equi join.
    """
    hours = None
    for name, days in WINDOWS.items():
        back = F.make_dt_interval(days=F.lit(days))
        part = hours_in_span(spans, shift=back).withColumn("window", F.lit(name))
        hours = part if hours is None else hours.unionByName(part)
    listed = [{k: r[k] for k in ("metric", "dim", "member")} for r in member_rows]
    series = scored.select("tenant", "metric", "dim", "member", "ds", "percent_diff")

    def mean(name: str) -> Column:
        return exact_mean(F.when(F.col("window") == name, F.col("percent_diff"))) * 100

    measured = (
        hours.join(series, ["tenant", "ds"])
        .groupBy("tenant", "group_id", "metric", "dim", "member")
        .agg(
            *[rounded(mean(n)).alias(f"{n}_value") for n in WINDOWS],
            *[F.count_if(F.col("window") == n).alias(f"{n}_rows") for n in WINDOWS])
    )
    grid = spans.select("tenant", "group_id", "start_hour", "end_hour", F.inline(each_of(listed)))
    out = grid.join(measured, ["tenant", "group_id", "metric", "dim", "member"], "left")
    for name in ("prev_day", "prev_week"):
        change = rounded(F.col("current_value") - F.col(f"{name}_value"))
        out = out.withColumn(f"{name}_change_pct", change).withColumn(
            f"vs_{name}", _label(F.col(f"{name}_rows"), F.col("current_rows"), F.col(f"{name}_change_pct")))
    return out.drop(*[f"{n}_rows" for n in WINDOWS])


def nested_history(changes: DataFrame) -> DataFrame:
    """One row per group with all series in one array, ordered."""
    fields = ("metric", "dim", "member", "current_value", "prev_day_value", "prev_week_value",
              "vs_prev_day", "vs_prev_week", "prev_day_change_pct", "prev_week_change_pct")
    return changes.groupBy("tenant", "group_id", "start_hour", "end_hour").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("metrics_analysis"))


def history_json(changes: DataFrame) -> DataFrame:
    return nested_history(changes).withColumn("metrics_analysis", F.to_json("metrics_analysis"))


def history_from_json(nested: DataFrame) -> DataFrame:
    """Flat rows back from the JSON form."""
    parsed = nested.withColumn("item", F.explode(F.from_json("metrics_analysis", HISTORY_SCHEMA)))
    return parsed.select("tenant", "group_id", "start_hour", "end_hour", "item.*")
