"""Time expressions that do not depend on the session time zone.

All of them take and return ``timestamp_ntz``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named units; ``<n>m`` and ``<n>h`` that divide a day are known too.
TRUNCATE_UNITS = ("1h", "1d", "1w", "1mo")
DAY_MINUTES = 24 * 60

# Month names of the report labels.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def unit_minutes(unit: str) -> int | None:
    """Minutes of ``<n>m`` or ``<n>h``; None for other units and those that do not divide a day."""
    found = re.fullmatch(r"([1-9][0-9]*)([mh])", str(unit))
    minutes = int(found[1]) * (60 if found[2] == "h" else 1) if found else DAY_MINUTES + 1
    return minutes if DAY_MINUTES % minutes == 0 else None


def known_unit(unit: str) -> bool:
    return unit in TRUNCATE_UNITS or unit_minutes(unit) is not None


def truncate(ts: Column, unit: str = "1h") -> Column:
    """Start of the hour, day, week (Monday), month, or minutes or hours of the day that holds ``ts``."""
    if not known_unit(unit):
        raise ValueError(f"unknown time unit {unit!r}, expected one of {TRUNCATE_UNITS}, or minutes (15m) "
                         "or hours (6h) that divide a day")
    day = ts.cast("date")
    if unit == "1h":
        return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))
    if unit == "1d":
        return day.cast("timestamp_ntz")
    if unit == "1w":
        return F.trunc(day, "week").cast("timestamp_ntz")
    if unit == "1mo":
        return F.trunc(day, "month").cast("timestamp_ntz")
    past = F.hour(ts) * 60 + F.minute(ts)
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=past - past % unit_minutes(unit))


def utc_ntz(ts: Column) -> Column:
    """UTC wall time of a zoned ``timestamp``, whatever the session zone is."""
    seconds = (F.unix_micros(ts) / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds)


def parse_time(text: Column) -> Column:
    """Time from mixed ISO-like text; a zone suffix is dropped, junk gives null."""
    return text.try_cast("timestamp_ntz")


def whole_hours(start: Column, end: Column) -> Column:
    """Whole hours from ``start`` to ``end``."""
    return (end - start).cast("interval hour").cast("bigint")


def hours(start: Column, end: Column) -> Column:
    """Hours from ``start`` to ``end`` as a double, with fractions."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double") / F.lit(3600.0)


def label(ts: Column) -> Column:
    """``Jan 02 2024 03:00``."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts))
    return F.format_string(
        "%s %02d %d %02d:%02d", month, F.dayofmonth(ts), F.year(ts), F.hour(ts), F.minute(ts))


def stamp(ts: Column) -> Column:
    """``2024-01-02 03:00:00``."""
    return F.substring(ts.cast("string"), 1, 19)
