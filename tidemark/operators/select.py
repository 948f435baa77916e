"""Predicates, null handling and value counts over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


def predicate(column: str, operator: str, value) -> Column:
    """Comparison named in a config; an unknown operator raises."""
    if operator not in COMPARISONS:
        raise ValueError(f"unknown operator {operator!r}, expected one of {list(COMPARISONS)}")
    return COMPARISONS[operator](F.col(column), F.lit(value))


def only_event(df: DataFrame, name: str, column: str = "event_name") -> DataFrame:
    return df.where(F.col(column) == name)


def members_in(df: DataFrame, column: str, members) -> DataFrame:
    return df.where(F.col(column).isin(list(members)))


def complete_rows(df: DataFrame, columns=None) -> DataFrame:
    """Rows without a null in ``columns`` (all columns by default)."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def null_profile(df: DataFrame) -> DataFrame:
    """One row: null count of every column."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def pad_columns(df: DataFrame, columns, value=0) -> DataFrame:
    """Add each expected column that is missing, filled with ``value``."""
    return df.withColumns({c: F.lit(value).cast("bigint") for c in columns if c not in df.columns})


def any_flag(df: DataFrame, flags) -> DataFrame:
    """Rows where at least one of the 0/1 columns is set."""
    return df.where(reduce(lambda a, b: a | b, [F.col(f) == 1 for f in flags]))


def between_days(df: DataFrame, column: str, first_day: str, last_day: str) -> DataFrame:
    """Rows from the start of the first calendar day to the end of the last one."""
    start = F.lit(first_day).cast("date").cast("timestamp_ntz")
    stop = (F.date_add(F.lit(last_day).cast("date"), 1)).cast("timestamp_ntz")
    return df.where((F.col(column) >= start) & (F.col(column) < stop))


def registered_members(long: DataFrame, registry: DataFrame, on=("dim", "member")) -> DataFrame:
    """Rows of a long table whose member is registered."""
    return long.join(registry.select(*on).distinct(), list(on), "left_semi")


def value_counts(df: DataFrame, column: str, top: int | None = None, by=()) -> DataFrame:
    """Rows per value, most frequent first, ties by value (nulls first)."""
    keys = [*by, column]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(*by, F.col("n").desc(), F.col(column).asc_nulls_first())
    return ordered.limit(top) if top else ordered


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def time_bounds(df: DataFrame, column: str, by=()) -> DataFrame:
    """Earliest and latest time."""
    return df.groupBy(*by).agg(F.min(column).alias("first_time"), F.max(column).alias("last_time"))
