"""Hourly KPI cubes: one pass over the events, then small tables only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import truncate
from tidemark.operators.dedup import earliest_per_key
from tidemark.plans.profiles import TOTAL, TOTAL_MEMBER, Metric, Profile

ACTIVITY_KEYS = ("tenant", "visitor", "session", "event_name", "ds", "geo", "device", "source", "medium")


def activity(events: DataFrame, profile: Profile) -> DataFrame:
    """The only table read from raw events: counts and first times per visitor hour.

    A hash aggregate with map-side combine.  Every metric of the profile follows from it
    exactly, counts by adding ``n`` and unique keys by the smallest ``first_time``, and
    tables of different days can be put together and grouped again.
    """
    time = F.col(profile.time)
    rows = events.where(time.isNotNull()).select(
        F.col(profile.tenant).alias("tenant"),
        F.col(profile.visitor).alias("visitor"),
        F.col(profile.session).alias("session"),
        "event_name",
        truncate(time).alias("ds"),
        profile.geo().alias("geo"),
        profile.device().alias("device"),
        F.col("utm_source").alias("source"),
        F.col("utm_medium").alias("medium"),
        time.alias("time"),
    )
    return rows.groupBy(*ACTIVITY_KEYS).agg(
        F.count("*").alias("n"), F.min("time").alias("first_time"))


def _pair(dim: str, member: Column) -> Column:
    return F.struct(F.lit(dim).alias("dim"), member.alias("member"))


def _sides(metric: Metric) -> list[Column]:
    """Dimensions that a row of the metric counts for, and its top level."""
    columns = {"geo": F.col("geo"), "device": F.col("device")}
    total = [] if metric.session_dims else [_pair(TOTAL, F.lit(TOTAL_MEMBER))]
    return [_pair(d, columns[d]) for d in metric.dims] + total


def _per_event(metrics: list[Metric], entry) -> Column:
    """Array of entries for the metrics that count the row's event."""
    options = [
        F.when(F.lit(True) if m.event is None else F.col("event_name") == m.event, entry(m))
        for m in metrics
    ]
    return F.array_compact(F.array(*options))


def _spread(rows: DataFrame, n: Column) -> DataFrame:
    """One row per side of the row's metric."""
    return rows.select("tenant", "metric", F.inline("sides"), "ds", n.alias("n"))


def counted_cells(act: DataFrame, profile: Profile) -> DataFrame:
    """Metrics that count every event."""
    counted = [m for m in profile.metrics if m.unique_by is None]
    entry = F.inline(_per_event(counted, lambda m: F.struct(
        F.lit(m.name).alias("metric"), F.array(*_sides(m)).alias("sides"))))
    return _spread(act.select("tenant", "ds", "n", entry), F.col("n"))


def unique_cells(act: DataFrame, profile: Profile) -> DataFrame:
    """Metrics that count each key once, in the hour of its earliest event."""
    unique = [m for m in profile.metrics if m.unique_by]
    entry = F.inline(_per_event(
        unique, lambda m: F.struct(F.lit(m.name).alias("metric"), F.col(m.unique_by).alias("key"))))
    rows = act.select("tenant", entry, "first_time", "geo", "device")
    first = earliest_per_key(rows, ["tenant", "metric", "key"], "first_time", ["geo", "device"], profile.values)
    sides = F.lit(None)
    for m in unique:
        sides = F.when(F.col("metric") == m.name, F.array(*_sides(m))).otherwise(sides)
    return _spread(first.select(
        "tenant", "metric", truncate(F.col("first_time")).alias("ds"), sides.alias("sides")), F.lit(1))


def session_cells(act: DataFrame, profile: Profile) -> DataFrame:
    """Sessions by the listed source and medium of their earliest event."""
    metric = next(m for m in profile.metrics if m.session_dims)
    first = earliest_per_key(act, ["tenant", "session"], "first_time", ["source", "medium"])

    def listed(dim: str) -> Column:
        return F.col(dim).isin(list(profile.members[dim]))

    sides = [F.when(listed(d), _pair(d, F.col(d))) for d in metric.session_dims]
    sides.append(F.when(listed(metric.top_level_from), _pair(TOTAL, F.lit(TOTAL_MEMBER))))
    return _spread(first.select(
        "tenant", F.lit(metric.name).alias("metric"), truncate(F.col("first_time")).alias("ds"),
        F.array_compact(F.array(*sides)).alias("sides")), F.lit(1))


def kpi_cube(act: DataFrame, profile: Profile) -> DataFrame:
    """Long cube ``tenant, metric, dim, member, ds, y``, top levels under dim ``total``."""
    cells = (
        counted_cells(act, profile)
        .unionByName(unique_cells(act, profile))
        .unionByName(session_cells(act, profile))
    )
    return cells.groupBy("tenant", "metric", "dim", "member", "ds").agg(F.sum("n").alias("y"))


def dense_series(cube: DataFrame, profile: Profile) -> DataFrame:
    """Every registered member at every hour its metric and dimension has a row, else 0.

    The rows of one hour are folded into a map of at most the registered members, so the
    fill needs one shuffle of the cube and no join.
    """
    listed = profile.members_of(F.col("metric"), F.col("dim"))
    hour = (
        cube.withColumn("listed", listed).where(F.col("listed").isNotNull())
        .groupBy("tenant", "metric", "dim", "ds")
        .agg(F.map_from_entries(F.collect_list(F.when(
            F.array_contains("listed", F.col("member")), F.struct("member", "y")))).alias("counts"))
    )
    return hour.select("tenant", "metric", "dim", F.explode(listed).alias("member"), "ds", "counts").select(
        "tenant", "metric", "dim", "member", "ds",
        F.coalesce(F.try_element_at("counts", F.col("member")), F.lit(0)).alias("y"))


def hourly_counts(rows: DataFrame, member: str, time: str = "event_timestamp", by=(), unit: str = "1h") -> DataFrame:
    """Rows per hour and member."""
    return rows.groupBy(
        *by, truncate(F.col(time), unit).alias("time"), F.col(member).alias("member")
    ).agg(F.count("*").alias("n")).withColumn("time_hour", F.hour("time"))


def pivot_members(counts: DataFrame, members, by=(), total=None, fill: int | None = 0,
                  member: str = "member", value: str = "n") -> DataFrame:
    """One column per listed member plus ``Total``.

    ``total`` lists the members that add up to ``Total``; by default it is every row of
    the hour, listed or not.
    """
    wide = counts.groupBy(*by, "time_hour", "time").agg(
        *[F.sum(F.when(F.col(member) == m, F.col(value))).alias(m) for m in members],
        F.sum(value if total is None else F.when(F.col(member).isin(list(total)), F.col(value))).alias("Total"))
    return wide if fill is None else wide.na.fill(fill, subset=[*members, "Total"])


def grouping_sets_cube(rows: DataFrame, time: str = "event_timestamp", by=("tenant",)) -> DataFrame:
    """Hourly counts at three levels in one job: all, by geography, by device."""
    hours = rows.select(*by, truncate(F.col(time)).alias("ds"), "geo", "device")
    hours = hours.groupBy(*by, "ds", "geo", "device").agg(F.count("*").alias("n"))
    keys = [F.col(c) for c in by] + [F.col("ds")]
    sets = [keys, keys + [F.col("geo")], keys + [F.col("device")]]
    return hours.groupingSets(sets, *keys, F.col("geo"), F.col("device")).agg(
        F.sum("n").alias("n"),
        F.when(F.grouping("geo") == 0, "geo").when(F.grouping("device") == 0, "device")
        .otherwise(TOTAL).alias("dim"))


def registry_totals(events: DataFrame, registry: dict[str, tuple[str, bool]]) -> DataFrame:
    """Size of each metric of a registry ``name -> (event, once per session)``, in one pass.

    Events are first counted per session and event, so a session is one row from then on.
    """
    sessions = events.groupBy("tenant", "event_name", "session").agg(F.count("*").alias("n"))
    entries = [
        F.when(F.col("event_name") == event, F.struct(
            F.lit(name).alias("metric"), (F.lit(1) if once else F.col("n")).cast("bigint").alias("n")))
        for name, (event, once) in registry.items()
    ]
    rows = sessions.select("tenant", F.inline(F.array_compact(F.array(*entries))))
    return rows.groupBy("tenant", "metric").agg(F.sum("n").alias("n"))
