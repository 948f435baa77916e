"""Small numeric and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6


def rounded(value: Column) -> Column:
    """Round to the six places that every comparison in the library uses."""
    return F.round(value, PLACES).cast("double")


def exact_mean(value: Column) -> Column:
    """Mean of rounded doubles as a decimal: the sum is exact, so neither the order of rows
    nor the number of partitions shows in the last digit."""
    return F.avg(value.cast("decimal(24,12)"))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null for a zero divisor."""
    return top / F.nullif(bottom, F.lit(0))


def percent_text(share: Column) -> Column:
    """``+12.3%`` for 0.123."""
    return F.format_string("%+.1f%%", F.round(share * 100, 1))


def at_most_one(value: Column) -> Column:
    return F.least(value, F.lit(1.0))
