"""KPI tables from a configuration.

The KPIs of one kind share one pass over the events: they are reduced to counts (or first
times per key) by all their dimensions at once, and only those few rows are repeated per KPI
and dimension.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.conditions import condition
from tidemark.functions.dimensions import mapped, when_then
from tidemark.functions.timeparts import truncate
from tidemark.operators.dedup import earliest_per_key
from tidemark.operators.select import predicate
from tidemark.sources.config import PIVOT_INDEX, load_config, validate
from tidemark.sources.events import without_zone
from tidemark.sources.sinks import write_kpi_tables
from tidemark.sources.work import WorkTables

KEEP_OWN_VALUE = "device"
#: Columns that a pivot may make of the data; more members stay in the long form.
MOST_MEMBERS = 10_000


def dimension_column(spec: dict, config: dict) -> Column:
    """Member of a configured dimension: transformations in turn, then the mapping; with
    neither, the source column itself."""
    value = F.col(spec["source_column"])
    for step in spec.get("transformations", []):
        if step.get("type") != "when_then":
            raise ValueError(f"unknown transformation {step.get('type')!r}")
        default = step.get("default")
        branches = [(condition(value, c["condition"]), c["value"]) for c in step["conditions"]]
        value = when_then(branches, value if default == KEEP_OWN_VALUE else F.lit(default))
    name = spec.get("mapping")
    if name:
        if name not in config["mappings"]:
            raise ValueError(f"unknown mapping {name!r}")
        mapping = config["mappings"][name]
        value = mapped(value, mapping, mapping.get("default"))
    return value


def dimension_members(spec: dict, config: dict) -> list[str] | None:
    """Members a dimension can have, in config order; None when it copies its source."""
    steps = spec.get("transformations", [])
    if not steps or steps[-1].get("default") == KEEP_OWN_VALUE:
        return None
    values = [c["value"] for c in steps[-1]["conditions"]] + [steps[-1].get("default")]
    mapping = config["mappings"].get(spec.get("mapping"), {})
    fallback = mapping.get("default")
    named = [mapping.get(v, fallback if mapping and fallback is not None else v) for v in values]
    return list(dict.fromkeys(v for v in named if v is not None))


def can_be_null(spec: dict, config: dict) -> bool:
    """Whether the last rule of a dimension leaves values without a member."""
    steps, mapping = spec.get("transformations", []), config["mappings"].get(spec.get("mapping"), {})
    return bool(steps) and steps[-1].get("default") is None and mapping.get("default") is None


def kpi_filter(kpi: dict) -> Column | None:
    condition = kpi["calculation"].get("filter")
    return predicate(condition["column"], condition["operator"], condition["value"]) if condition else None


def _used_dimensions(kpi: dict, config: dict) -> dict[str, dict]:
    """Dimensions that have a pivot."""
    return {d: s for d, s in kpi["dimensions"].items() if d in config["pivot_configs"]}


class _Shared:
    """Distinct dimension definitions and filters of several KPIs, as numbered columns."""

    def __init__(self, kpis: dict, config: dict):
        self.columns: dict[str, Column] = {}
        self.filters: dict[str, Column] = {}
        self.values: dict[str, list[str]] = {}
        self._dims: dict[str, str] = {}
        self._flags: dict[str, str] = {}
        for kpi in kpis.values():
            for spec in _used_dimensions(kpi, config).values():
                name = self._dims.setdefault(self._id(spec), f"dim_{len(self._dims)}")
                self.columns[name] = dimension_column(spec, config)
                members = dimension_members(spec, config)
                if members is not None and all(isinstance(m, str) for m in members):
                    self.values[name] = members
            if kpi_filter(kpi) is not None:
                name = self._flags.setdefault(
                    self._id(kpi["calculation"]["filter"]), f"is_{len(self._flags)}")
                self.filters[name] = kpi_filter(kpi)

    @staticmethod
    def _id(spec: dict) -> str:
        return json.dumps(spec, sort_keys=True)

    def member(self, spec: dict) -> Column:
        return F.col(self._dims[self._id(spec)])

    def counts(self, kpi: dict) -> Column:
        condition = kpi["calculation"].get("filter")
        return F.col(self._flags[self._id(condition)]) if condition else F.lit(True)

    def select(self, df: DataFrame, *columns) -> DataFrame:
        named = {**self.columns, **self.filters}
        return df.select(*columns, *[c.alias(n) for n, c in named.items()])


def _exploded(df: DataFrame, options: list[tuple[Column, Column]], keep) -> DataFrame:
    """One row per option whose condition holds."""
    entry = F.explode(F.array_compact(F.array(*[F.when(c, v) for c, v in options])))
    return df.select(*keep, entry.alias("entry")).select(*keep, "entry.*")


def _cell(kpi: str, dim: str, member: Column) -> Column:
    return F.struct(F.lit(kpi).alias("kpi"), F.lit(dim).alias("dim"), member.alias("member"))


def _counted(events: DataFrame, kpis: dict, config: dict, by, time: str, unit: str) -> DataFrame:
    shared = _Shared(kpis, config)
    rows = shared.select(events, *by, truncate(F.col(time), unit).alias("time"))
    cells = rows.groupBy(*rows.columns).agg(F.count("*").alias("cells"))
    options = [
        (shared.counts(kpi), _cell(name, dim, shared.member(spec)))
        for name, kpi in kpis.items() for dim, spec in _used_dimensions(kpi, config).items()
    ]
    long = _exploded(cells, options, [*by, "time", "cells"])
    return long.groupBy(*by, "kpi", "dim", "member", "time").agg(F.sum("cells").alias("n"))


def _unique(events: DataFrame, kpis: dict, config: dict, by, time: str, unit: str) -> DataFrame:
    shared = _Shared(kpis, config)
    keys = list(dict.fromkeys(k["calculation"]["column"] for k in kpis.values()))
    rows = shared.select(
        events, *by, F.col(time).alias("time"),
        *[F.col(k).cast("string").alias(f"key_{i}") for i, k in enumerate(keys)])
    options = [
        (shared.counts(kpi), F.struct(
            F.lit(name).alias("kpi"),
            F.col(f"key_{keys.index(kpi['calculation']['column'])}").alias("key")))
        for name, kpi in kpis.items()
    ]
    dims = list(shared.columns)
    members = _exploded(rows, options, [*by, "time", *dims])
    first = earliest_per_key(members, [*by, "kpi", "key"], "time", dims, shared.values)
    cells = [
        (F.col("kpi") == name, F.struct(F.lit(dim).alias("dim"), shared.member(spec).alias("member")))
        for name, kpi in kpis.items() for dim, spec in _used_dimensions(kpi, config).items()
    ]
    long = _exploded(first.withColumn("time", truncate(F.col("time"), unit)), cells, [*by, "kpi", "time"])
    return long.groupBy(*by, "kpi", "dim", "member", "time").agg(F.count("*").alias("n"))


def first_occurrence(events: DataFrame, kpi: dict, by=()) -> tuple[DataFrame, str]:
    """Filtered events reduced to one row per group key, and the name of its time column."""
    spec = kpi["calculation"]["first_occurrence"]
    condition = kpi_filter(kpi)
    rows = events if condition is None else events.where(condition)
    named = [(a["column"], a["agg"], a.get("alias") or a["column"]) for a in spec["aggregations"]]
    lows = [(c, out) for c, kind, out in named if kind == "min"]
    firsts = [(c, out) for c, kind, out in named if kind == "first"]
    if not lows:
        raise ValueError("first_occurrence needs a min aggregation for its time")
    source, time = lows[0]
    key = [*by, spec["group_by"]]
    further = {f"low_{i}_of_rows": out for i, (_, out) in enumerate(lows[1:])}
    picked = rows.select(
        *key, F.col(source).alias(time), *[F.col(c).alias(out) for c, out in firsts],
        *[F.col(c).alias(name) for (c, _), name in zip(lows[1:], further)])
    out = earliest_per_key(picked, key, time, [o for _, o in firsts], least=further)
    return (out.na.drop("any") if spec.get("drop_nulls") else out), time


def _first(events: DataFrame, name: str, kpi: dict, config: dict, by, unit: str) -> DataFrame:
    rows, time = first_occurrence(events, kpi, by)
    options = [
        (F.lit(True), _cell(name, dim, dimension_column(spec, config)))
        for dim, spec in _used_dimensions(kpi, config).items()
    ]
    long = _exploded(rows.withColumn("bucket", truncate(F.col(time), unit)), options, [*by, "bucket"])
    return long.groupBy(*by, "kpi", "dim", "member", F.col("bucket").alias("time")).agg(
        F.count("*").alias("n"))


def kpi_long(events: DataFrame, config: dict, by=()) -> DataFrame:
    """All configured KPI tables in long form: ``by, kpi, dim, member, time, n``."""
    validate(config)
    time = config["common_configs"].get("time_column", "event_timestamp")
    unit = config["common_configs"]["time_truncate_unit"]
    timed = events.where(F.col(time).isNotNull())
    kinds: dict[str, dict] = {"count": {}, "unique_count": {}, "first": {}}
    for name, kpi in config["kpis"].items():
        calculation = kpi["calculation"]
        kinds["first" if calculation.get("first_occurrence") else calculation["method"]][name] = kpi
    parts = [_first(timed, n, k, config, by, unit) for n, k in kinds["first"].items()]
    if kinds["count"]:
        parts.append(_counted(timed, kinds["count"], config, by, time, unit))
    if kinds["unique_count"]:
        parts.append(_unique(timed, kinds["unique_count"], config, by, time, unit))
    if not parts:
        raise ValueError("config has no KPI")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kpi_wide(long: DataFrame, kpi: str, dim: str, config: dict, by=(), fill: int | None = 0) -> DataFrame:
    """One configured table: pivoted members, ``Total``, renamed and ordered columns.

    A row for each bucket of the pivot's ``index``: ``time_truncated``, ``time_hour`` (the hour of day of all
    days) or both.  Members come from the config; for a dimension that copies its source, from the data,
    and more than ``MOST_MEMBERS`` of them raise.  Rows of
    no member have a column ``null`` where the config can leave them without one, and ``Total``
    counts every row, also those of members that are not listed.
    """
    spec, pivot = config["kpis"][kpi]["dimensions"][dim], config["pivot_configs"][dim]
    times = {"time_truncated": F.col("time"), "time_hour": F.hour("time")}
    index = [times[name].alias(name) for name in pivot.get("index", PIVOT_INDEX)]
    rows = long.where((F.col("kpi") == kpi) & (F.col("dim") == dim))
    members = pivot.get("members") or dimension_members(spec, config)
    if members is None:
        found = rows.select("member").distinct().limit(MOST_MEMBERS + 1).collect()
        if len(found) > MOST_MEMBERS:
            raise ValueError(f"{kpi}.{dim} has more than {MOST_MEMBERS} members: list those to pivot, or use the long form")
        members = sorted((r.member for r in found), key=lambda m: (m is not None, m))
    elif can_be_null(spec, config) and None not in members:
        members = [*members, None]
    names = ["null" if m is None else m for m in members]
    columns = [F.sum(F.when(F.col("member").eqNullSafe(F.lit(m)), F.col("n"))).alias(name) for m, name in zip(members, names)]
    wide = rows.groupBy(*by, *index).agg(*columns, F.sum("n").alias("Total"))
    if fill is not None:
        wide = wide.na.fill(fill, subset=[f"`{n}`" for n in names])
    return final_order(wide.withColumnsRenamed(pivot.get("rename_columns", {})),
                       pivot.get("final_column_order"), names, by)


def final_order(df: DataFrame, order: list[str] | None, members: list[str], by=()) -> DataFrame:
    """Listed columns that exist, then the members that were not listed."""
    if not order:
        return df
    listed = [c for c in order if c in df.columns]
    return df.select(*by, *[F.col(f"`{c}`") for c in listed + [m for m in members if m not in listed]])


def kpi_tables(events: DataFrame, config: dict, by=(), fill: int | None = 0,
               work: WorkTables | None = None) -> dict[tuple[str, str], DataFrame]:
    """Every configured table by ``(kpi, dimension)``.

    With ``work`` the long form is written there first, so that the tables do not each start from
    the raw events.
    """
    long = kpi_long(events, config, by)
    if work is not None:
        long = work.keep(long, "kpis")
    return {
        (name, dim): kpi_wide(long, name, dim, config, by, fill)
        for name, kpi in config["kpis"].items() for dim in _used_dimensions(kpi, config)
    }


def run(spark: SparkSession, path: str, by=()) -> dict[tuple[str, str], str]:
    """Read a configuration, its events, and write one CSV folder per configured table."""
    config = load_config(path, spark)
    events = without_zone(spark.read.parquet(config["data"]["input_file"]))
    with WorkTables(spark) as work:
        return write_kpi_tables(kpi_tables(events, config, by, work=work), config["data"]["output_directory"])
