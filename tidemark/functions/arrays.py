"""Expressions over arrays of member names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_names(names: Column, prefix: str = "percent_diff") -> Column:
    """Strip the column prefix and blanks, drop nulls and empties, sort, keep one of each."""
    bare = F.transform(names, lambda x: F.trim(F.regexp_replace(x, prefix, "")))
    kept = F.filter(bare, lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(kept))


def clean_name_lists(lists: Column, prefix: str = "percent_diff") -> Column:
    """The same for an array of arrays; null when nothing is left."""
    flat = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    names = clean_names(flat, prefix)
    return F.when(F.size(names) > 0, names)


def union_of_lists(lists: Column) -> Column:
    """Sorted distinct union of an array of arrays (nulls already absent)."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def any_contains(names: Column, part: str) -> Column:
    """True when any entry contains ``part``, ignoring case."""
    return F.exists(names, lambda x: F.contains(F.lower(x), F.lit(part.lower())))


def as_text(names: Column, separator: str = ", ") -> Column:
    return F.array_join(names, separator)
