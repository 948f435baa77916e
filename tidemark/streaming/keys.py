"""Unique keys of a stream, exact in any order of arrival.

What is known of a key is its earliest row so far.  The first row of a key, and any later arrival that is
earlier than what is known, is given out as a change: the new row with ``change`` 1, and before it, if
there was one, the old row with -1.  Sums over changes are therefore right at any moment: rows that sum
to 1 are the earliest rows (``settled``), and hourly counts follow by adding ``change`` up, so a late
event moves its key from one hour to another.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators.cube import hourly_counts

#: Buckets that keys are dealt to.  A bucket is one row of state, read and written whole, and one call of
#: Python a batch.  The number is part of a stream's checkpoint: a stream that goes on has to keep it.
BUCKETS = 256

_TIME, _MICROS, _BUCKET, _FRESH, _UNTIL = "event_time_of_row", "micros_of_row", "bucket_of_key", "fresh_row", "known_until"


def _text(column: str, kind: S.DataType) -> Column:
    """A key as a text that no other key has, ``""`` for null."""
    value = F.col(column)
    if isinstance(kind, (S.FloatType, S.DoubleType)):
        value = value + F.lit(0).cast(kind)  # 0.0 and -0.0 are one key
    elif isinstance(kind, S.BinaryType):
        value = F.hex(value)
    elif isinstance(kind, S.TimestampType):
        value = F.unix_micros(value)
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _untext(column: str, kind: S.DataType) -> Column:
    value = F.when(F.col(column) != "", F.substring(F.col(column), 2, 2_147_483_647))
    if isinstance(kind, S.BinaryType):
        return F.unhex(value)
    if isinstance(kind, S.TimestampType):
        return F.timestamp_micros(value.cast("long"))
    return value.cast(kind)


def earliest_keys(events: DataFrame, keys, keep=(), time: str = "event_timestamp",
                  delay: str | None = None, hold_hours: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Changes ``keys + time + keep + change`` of the earliest row of each key.

    Without ``delay`` and ``hold_hours`` the outcome is that of ``earliest_per_key`` over all rows, whatever
    their order, and a key is kept for good.  With ``delay``, rows later than the watermark are left out;
    with ``hold_hours`` too, an event-time timer forgets a key that long after its latest row, and it counts
    anew when it comes back.  Rows without a time are left out.  Kept columns are texts or numbers.

    Keys are dealt by a hash to ``buckets`` rows of state, and each batch merges the keys of a bucket with
    the known ones at once, so Python's work goes by rows of frames, not by calls for single keys.
    """
    keys, keep = list(keys), [c for c in keep if c not in keys]
    if hold_hours is not None and delay is None:
        raise ValueError("hold_hours needs a watermark: name a delay")
    kinds = {f.name: f.dataType for f in events.schema.fields}
    key_names = [f"key_{i}" for i in range(len(keys))]
    # Kept values as a flag and a value that is never null: nulls first, and no frame turns numbers to floats.
    order = [name for i in range(len(keep)) for name in (f"there_{i}", f"kept_{i}")]
    values = []
    for i, c in enumerate(keep):
        dated = kinds[c].typeName().startswith(("date", "timestamp"))
        none = F.lit("1970-01-01" if dated else "" if isinstance(kinds[c], (S.StringType, S.BinaryType)) else 0).cast(kinds[c])
        values += [F.col(c).isNotNull().alias(f"there_{i}"), F.coalesce(F.col(c), none).alias(f"kept_{i}")]
    rows = events.where(F.col(time).isNotNull()).select(
        *[_text(c, kinds[c]).alias(name) for c, name in zip(keys, key_names)], *values,
        F.col(time).cast("timestamp").alias(_TIME), F.unix_micros(F.col(time).cast("timestamp")).alias(_MICROS))
    rows = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*key_names), F.lit(buckets)))
    if delay is not None:
        rows = rows.withWatermark(_TIME, delay)
    columns = [*key_names, _MICROS, *order]
    row_kinds = {f.name: f for f in rows.schema.fields}
    out_kind = S.StructType([*[row_kinds[c] for c in columns], S.StructField("change", S.IntegerType())])
    state_kind = S.StructType([S.StructField("known", S.BinaryType())])

    def least(frame):
        """The first row of each key; a known row before a fresh one that equals it."""
        return frame.sort_values([_MICROS, *order, _FRESH]).drop_duplicates(key_names)

    def update(key, frames, state):
        known = pickle.loads(state.get[0]) if state.exists else None
        fresh, until = None, None
        for frame in [] if state.hasTimedOut else frames:
            frame = frame[columns].assign(**{_FRESH: True})
            if hold_hours is not None:
                latest = frame.groupby(key_names, sort=False)[_MICROS].max()
                until = latest if until is None else pd.concat([until, latest]).groupby(level=key_names, sort=False).max()
            fresh = least(frame if fresh is None else pd.concat([fresh, frame]))
        best = known if fresh is None else fresh
        if known is not None and fresh is not None:
            best = least(pd.concat([known.drop(columns=_UNTIL, errors="ignore"), fresh], ignore_index=True))
            gone = known.loc[known.index.difference(best.index[~best[_FRESH]])]
        changes = None
        if fresh is not None:
            come = best[best[_FRESH]]
            parts = [come[columns].assign(change=1)]
            if known is not None:
                parts.insert(0, gone[columns].assign(change=-1))
            changes = pd.concat(parts)
        if hold_hours is not None:
            now, hold = state.getCurrentWatermarkMs(), hold_hours * 3_600_000
            if fresh is not None:
                # Keys of this batch are held from it on, the others as long as they were.
                ends = [((until // 1000).clip(lower=now) + hold).rename(_UNTIL)]
                if known is not None:
                    others = known.set_index(key_names)[_UNTIL]
                    ends.append(others[(others >= now) & ~others.index.isin(ends[0].index)])
                best = best.merge(pd.concat(ends).reset_index(), on=key_names)
            else:
                best = best[best[_UNTIL] >= now]
            if len(best):
                state.setTimeoutTimestamp(int(best[_UNTIL].min()))
        if not len(best):
            state.remove()
        elif hold_hours is not None or len(changes):
            # Known rows are numbered from 0, so that a merge tells them by their places.
            state.update((pickle.dumps(best.assign(**{_FRESH: False}).reset_index(drop=True)),))
        if changes is not None and len(changes):
            yield changes

    timeout = GroupStateTimeout.NoTimeout if hold_hours is None else GroupStateTimeout.EventTimeTimeout
    found = rows.groupBy(_BUCKET).applyInPandasWithState(update, out_kind, state_kind, "append", timeout)
    # Wall time again, as the events have it, whatever the session zone is.
    moment = F.timestamp_micros(F.col(_MICROS)).cast(kinds[time])
    return found.select(
        *[_untext(name, kinds[c]).alias(c) for c, name in zip(keys, key_names)], moment.alias(time),
        *[F.when(F.col(f"there_{i}"), F.col(f"kept_{i}")).alias(c) for i, c in enumerate(keep)], "change")


def settled(changes: DataFrame) -> DataFrame:
    """The rows that stand after all changes, without ``change``."""
    columns = [c for c in changes.columns if c != "change"]
    return changes.groupBy(*columns).agg(F.sum("change").alias("change")).where("change > 0").select(*columns)


def hourly_changes(changes: DataFrame, member: str, time: str = "event_timestamp", by=()) -> DataFrame:
    """Keys per hour and member after all changes; hours that all keys have left are not there."""
    each = changes.withColumn("signed", F.col("change"))
    plus = hourly_counts(each.where("signed > 0"), member, time, by)
    minus = hourly_counts(each.where("signed < 0"), member, time, by).withColumn("n", -F.col("n"))
    both = plus.unionByName(minus)
    others = [c for c in both.columns if c != "n"]
    return both.groupBy(*others).agg(F.sum("n").alias("n")).where("n > 0")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream to the end of its present input; its rows so far, written below ``folder``.

    Called again with the same folder it takes up where it stopped.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
