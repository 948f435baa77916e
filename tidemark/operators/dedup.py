"""One row per key: earliest events and session roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Combinations of kept values that a time carries, so times of the years 1685 to 2255 fit.
PACKED = 1024


def _micros(span: Column) -> Column:
    return (span.cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("bigint")


def _packed_first(df: DataFrame, keys: list[str], time: str, keep: list[str], values: Mapping[str, Sequence[str]]) -> DataFrame:
    """``earliest_per_key`` in a buffer of one fixed-width interval: the time since 1970, times
    ``PACKED``, and the number of the kept values' combination, nulls first and then by their order."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    lists = {c: sorted(set(values[c]), key=str.encode) for c in keep}
    step, number = 1, F.expr("interval '0.000000' second")
    for c in reversed(keep):
        place = F.when(F.col(c).isNull(), F.expr("interval '0.000000' second"))
        for i, v in enumerate(lists[c], 1):
            place = place.when(F.col(c) == v, F.expr(f"interval '{i * step / 1e6:.6f}' second"))
        unlisted = F.raise_error(F.concat(F.lit(f"{c} has a value that is not listed: "), F.col(c)))
        number = number + place.otherwise(unlisted.cast("interval day to second"))
        step *= len(lists[c]) + 1
    packed = (F.col(time) - epoch) * PACKED + number
    first = df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.min(packed).alias("packed_first"))
    micros = _micros(F.col("packed_first"))
    found = first.select(*keys, micros.alias("packed_first"))
    code, columns = F.pmod(F.col("packed_first"), F.lit(PACKED)), []
    step = 1
    for c in reversed(keep):
        size = len(lists[c]) + 1
        at = F.floor(code / step) % size
        columns.insert(0, F.get(F.array(*[F.lit(v) for v in [None, *lists[c]]]).cast("array<string>"), at.cast("int")).alias(c))
        step *= size
    since = (F.floor(F.col("packed_first") / PACKED) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return found.select(*keys, (epoch + F.make_dt_interval(secs=since)).alias(time), *columns)


def earliest_per_key(df: DataFrame, keys, time: str, keep, values: Mapping[str, Sequence[str]] | None = None,
                     least: Mapping[str, str] | None = None) -> DataFrame:
    """Earliest row of each key, as ``keys + time + keep``.

    Rows without a time are left out.  Rows of one key at the very same time are ordered by
    the kept columns, so the outcome never depends on file order or on event ids.

    One aggregate with one shuffle.  Each map task sends a single row per key, so a key that
    holds a third of all rows weighs no more than any other.  Where ``values`` lists all that every
    kept column can be besides null (few enough to number), the aggregate hashes; otherwise its buffer holds texts
    and it sorts.  A value that is not listed raises an error.  ``least`` maps further columns to the names of their
    own smallest values, over the same rows.
    """
    keys, keep = list(keys), [c for c in keep if c not in keys]
    lows = [F.min(c).alias(name) for c, name in (least or {}).items()]
    listed = not lows and values is not None and all(c in values for c in keep)
    if listed and df.schema[time].dataType.typeName() == "timestamp_ntz":
        combinations = 1
        for c in keep:
            combinations *= len(set(values[c])) + 1
        if combinations <= PACKED:
            return _packed_first(df, keys, time, keep, values)
    first = (
        df.where(F.col(time).isNotNull())
        .groupBy(*keys)
        .agg(F.min(F.struct(time, *keep)).alias("first_row"), *lows)
    )
    return first.select(*keys, "first_row.*", *(least or {}).values())


def session_rollup(df: DataFrame, attributes: dict[str, str], key: str = "session_id",
                   time: str = "event_timestamp", by=(), complete: bool = False) -> DataFrame:
    """One row per session: its start and the attributes of its earliest event.

    ``attributes`` maps source column to output column.  ``complete`` drops sessions with
    a null anywhere.
    """
    rows = df.select(
        *by, key, F.col(time).alias("session_start"),
        *[F.col(old).alias(new) for old, new in attributes.items()])
    out = earliest_per_key(rows, [*by, key], "session_start", list(attributes.values()))
    return out.na.drop("any") if complete else out
