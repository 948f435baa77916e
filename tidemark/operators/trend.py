"""Where the trend of a series breaks: least-squares segmentation on its daily sums.

Days, not hours, are segmented, so that the daily cycle is not taken for breaks.  Sums of days are
whole numbers, and running sums of them, of their squares and of their products give the error of the
best line over any run of days in closed form and without rounding; two windows price every break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shortest segment in days, and the weight of the penalty for a further break.
LEAST_DAYS = 3
PENALTY = 1.0
#: What a break adds: an intercept, a slope and its place.
BREAK_PARAMETERS = 3

_WHOLE = "decimal(38,0)"
_SUMS = ("n", "x", "y", "xx", "xy", "yy")


def line_error(n: Column, x: Column, y: Column, xx: Column, xy: Column, yy: Column) -> Column:
    """Sum of squared distances to the least-squares line, from exact sums."""
    def whole(value: Column) -> Column:
        return value.cast(_WHOLE).cast("double")

    across, both, down = whole(n * xx - x * x), whole(n * xy - x * y), whole(n * yy - y * y)
    return (down - F.coalesce(both * both / F.nullif(across, F.lit(0.0)), F.lit(0.0))) / n.cast("double")


def _sums(window) -> dict[str, Column]:
    x, y = F.col("x").cast("decimal(18,0)"), F.col("total").cast("decimal(18,0)")
    values = {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    return {k: F.sum(v).over(window).cast("decimal(19,0)") for k, v in values.items()}


def break_segments(series: DataFrame, keys, rounds: int, least_days: int = LEAST_DAYS,
                   penalty: float = PENALTY) -> DataFrame:
    """``keys + day + segment``: segments are numbered in the order of their days, with gaps.

    In each round the break of a segment with the least error (the earliest of equal ones) is taken if the
    error falls below what a line more may cost: by a factor of ``N ** (3 * penalty / n)`` or more, for
    ``n`` days in the segment and ``N`` in the series, which is the Bayesian information criterion.
    Both sides have ``least_days`` days at least.  ``rounds`` rounds give at most ``2 ** rounds`` segments.

    One shuffle, as all windows partition by the series; a series has a row a day.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    days = series.groupBy(*keys, F.col("ds").cast("date").alias("day")).agg(F.sum("y").alias("total"))
    rows = (
        days.repartition(*keys)
        .withColumn("x", F.datediff("day", F.min("day").over(whole)))
        .withColumn("days", F.count("*").over(whole))
        .withColumn("segment", F.lit(0)))
    for _ in range(rounds):
        here = Window.partitionBy(*keys, "segment")
        so_far = here.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left, all_ = _sums(so_far), _sums(here)
        rows = rows.withColumns({**{f"l_{k}": v for k, v in left.items()}, **{f"a_{k}": v for k, v in all_.items()}})
        one, every = [F.col(f"l_{k}") for k in _SUMS], [F.col(f"a_{k}") for k in _SUMS]
        fits = (F.col("l_n") >= least_days) & (F.col("a_n") - F.col("l_n") >= least_days)
        after = F.when(fits, line_error(*one) + line_error(*[a - b for a, b in zip(every, one)]))
        rows = rows.withColumns({"after": after, "before": line_error(*every)})
        rows = rows.withColumn("best", F.min(F.when(F.col("after").isNotNull(), F.struct("after", "x"))).over(here))
        allowed = F.pow(F.col("days").cast("double"), F.lit(BREAK_PARAMETERS * penalty) / F.col("a_n").cast("double"))
        broken = F.coalesce(F.col("before") > F.col("best.after") * allowed, F.lit(False))
        later = F.when(broken & (F.col("x") > F.col("best.x")), 1).otherwise(0)
        rows = rows.select(*keys, "day", "total", "x", "days", (F.col("segment") * 2 + later).alias("segment"))
    return rows.select(*keys, "day", "segment")
