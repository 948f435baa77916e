"""KPI configuration: JSON file, required keys, and the checks made before any job runs."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidemark.functions.timeparts import known_unit
from tidemark.operators.select import COMPARISONS

# The sections that a configuration must have.
REQUIRED = ("data", "kpis", "mappings", "pivot_configs", "common_configs")
METHODS = ("count", "unique_count")
FIRST_AGGREGATIONS = ("min", "first")


def load_config(path: str, spark: SparkSession | None = None) -> dict:
    """Read and check a configuration, from any storage that Spark reads; without ``spark``, from a local file."""
    if spark is not None:
        found = spark.read.text(path, wholetext=True).limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{path} has {'no' if not found else 'more than one'} configuration")
        return parse_config(found[0][0])
    with open(path, encoding="utf-8") as source:
        return parse_config(source.read())


def parse_config(text: str) -> dict:
    return validate(json.loads(text))


#: Columns that a pivot's index may have; without one it has both.
PIVOT_INDEX = ("time_truncated", "time_hour")
# Aggregations of a pivot's cell.  A cell has one count, so they all give that count.
PIVOT_AGGREGATIONS = ("sum", "first", "last", "min", "max", "mean", "median")


def validate(config: dict) -> dict:
    """Return the config; raise ``ValueError`` naming the missing or unknown value.

    Display fields (``type``, ``accent``, ``description``, ``display_name``, ``columns``,
    ``total_columns``, ``unique_subset_column``, ``event_name_filter``) are accepted and ignored, and so is the
    name in a pivot's ``values``.
    """
    for key in REQUIRED:
        if key not in config:
            raise ValueError(f"missing key in config: {key}")
    unit = config["common_configs"].get("time_truncate_unit")
    if not known_unit(unit):
        raise ValueError(f"unknown time_truncate_unit {unit!r}")
    for name, kpi in config["kpis"].items():
        _check_kpi(name, kpi, config)
    for dim, pivot in config["pivot_configs"].items():
        index = pivot.get("index", list(PIVOT_INDEX))
        if not index or isinstance(index, str) or len(set(index)) != len(index) or set(index) - set(PIVOT_INDEX):
            raise ValueError(f"pivot_configs.{dim}: index {index!r} is not supported, only {PIVOT_INDEX} or one of them")
        kind = pivot.get("aggregate_function", "sum")
        if kind not in PIVOT_AGGREGATIONS:
            raise ValueError(f"pivot_configs.{dim}: unknown aggregate_function {kind!r}, expected one of {PIVOT_AGGREGATIONS}")
    return config


def _check_kpi(name: str, kpi: dict, config: dict) -> None:
    calculation = kpi.get("calculation") or {}
    if calculation.get("method") not in METHODS:
        raise ValueError(f"{name}: unknown method {calculation.get('method')!r}, expected one of {METHODS}")
    condition = calculation.get("filter")
    if condition and condition.get("operator") not in COMPARISONS:
        raise ValueError(f"{name}: unknown operator {condition.get('operator')!r}")
    first = calculation.get("first_occurrence")
    if first:
        kinds = [a["agg"] for a in first["aggregations"]]
        unknown = sorted(set(kinds) - set(FIRST_AGGREGATIONS))
        if unknown:
            raise ValueError(f"{name}: unknown aggregation {unknown[0]!r}")
        if "min" not in kinds:
            raise ValueError(f"{name}: first_occurrence needs a min aggregation for its time")
    for dim, spec in kpi.get("dimensions", {}).items():
        if "source_column" not in spec:
            raise ValueError(f"{name}.{dim}: missing source_column")
        for step in spec.get("transformations", []):
            if step.get("type") != "when_then":
                raise ValueError(f"{name}.{dim}: unknown transformation {step.get('type')!r}")
            for key in ("conditions", "default"):
                if key not in step:
                    raise ValueError(f"{name}.{dim}: when_then without {key}")
        mapping = spec.get("mapping")
        if mapping and mapping not in config["mappings"]:
            raise ValueError(f"{name}.{dim}: unknown mapping {mapping!r}")
