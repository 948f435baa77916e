"""Points joined to the intervals that hold them, at any grain and any length.

Intervals are dealt to bins as wide as themselves, rounded up to a power of two of the grain, so each
lies in one bin or two, however long it is.  A point is in one bin of each width that occurs.  The join is
an equality on key, width and bin, with the range as a residual test; nothing is listed by the hour, and
a key with most points is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def _micros(time: Column) -> Column:
    """Microseconds of a wall time since 1970, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return ((time.cast("timestamp_ntz") - epoch).cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("bigint")


def interval_join(points: DataFrame, intervals: DataFrame, keys, time: str, start: str, end: str,
                  grain_minutes: int = 15) -> DataFrame:
    """``points`` next to every interval of the same ``keys`` with ``start <= time <= end``.

    Columns of ``intervals`` other than the keys follow those of ``points``; their names must differ.  Rows with
    a null key, time or bound match nothing, nor do intervals that end before they start.  The widths
    that occur, at most one for each power of two, are read first.
    """
    if grain_minutes < 1:
        raise ValueError("grain_minutes must be 1 or more")
    clash = (set(points.columns) & set(intervals.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are on both sides")
    unit = grain_minutes * MICROS_PER_MINUTE
    units = F.greatest(F.ceil((_micros(F.col(end)) - _micros(F.col(start))) / unit), F.lit(1)).cast("bigint")
    width = F.when(units <= 1, 0).otherwise(F.length(F.bin(units - 1)))
    valid = intervals.where(F.col(start) <= F.col(end)).withColumn("bin_width", width)
    widths = sorted(r[0] for r in valid.select("bin_width").distinct().collect())

    def bin_of(t: Column, w: Column) -> Column:
        return F.floor(_micros(t) / (F.lit(unit) * F.pow(F.lit(2.0), w))).cast("bigint")

    of_start, of_end = (bin_of(F.col(c), F.col("bin_width")) for c in (start, end))
    dealt = valid.withColumn("bin", F.explode(F.array_distinct(F.array(of_start, of_end))))
    each = points.withColumn("bin_width", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>")))
    each = each.withColumn("bin", bin_of(F.col(time), F.col("bin_width")))
    found = each.join(dealt, [*keys, "bin_width", "bin"])
    return found.where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("bin_width", "bin")
