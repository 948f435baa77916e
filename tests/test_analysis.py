"""Window, work tables, written reports and scans of the composed run."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from catalog import event_queries as E
from catalog import tables as T
from catalog.sql import BROWSER
from tidemark.functions.timeparts import truncate
from tidemark.plans.analysis import Analysis
from tidemark.sources.work import WorkTables

SF_DIR = "/root/testdata/sf0.001"


def test_window_bounds_events_and_spine(spark, tmp_path):
    events = T.browser_events(spark, SF_DIR)
    late = events.limit(1).withColumn("event_timestamp", F.lit("2099-01-01").cast("timestamp_ntz"))
    bounds = dict(start="2024-01-03", end="2024-01-06 05:30:00")
    run = Analysis(events.unionByName(late), BROWSER, WorkTables(spark, str(tmp_path)), **bounds)
    got = run.hours.groupBy("tenant").agg(F.min("hour"), F.max("hour"), F.count("*")).collect()
    first, last = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 6, 5)
    assert {tuple(r)[1:] for r in got} == {(first, last, 78)} and len(got) == 4


def test_work_tables_are_removed(spark, tmp_path):
    with WorkTables(spark, str(tmp_path)) as work:
        assert work.keep(spark.range(3), "three").count() == 3
        assert os.listdir(tmp_path)
    assert not os.listdir(tmp_path)


def test_written_reports_have_member_columns(spark, tmp_path):
    with Analysis(T.browser_events(spark, SF_DIR), BROWSER, WorkTables(spark, str(tmp_path / "work"))) as run:
        wanted = {f"{r['metric']}_{r['dim']}_{r['member']}_percent_diff" for r in run.member_rows if r["dim"] != "total"}
        assert wanted <= set(run.wide_report.columns) and wanted <= set(run.wide_group_report.columns)
        assert run.wide_group_report.count() == run.group_report.count()
    assert not os.listdir(tmp_path / "work")


@pytest.mark.parametrize("unit, want", [("15m", (13, 45)), ("30m", (13, 30)), ("6h", (12, 0)), ("1h", (13, 0))])
def test_truncate_units(spark, unit, want):
    row = spark.sql("SELECT timestamp_ntz'2024-01-02 13:47:59.5' AS t").select(truncate(F.col("t"), unit)).first()
    assert row[0] == dt.datetime(2024, 1, 2, *want)


@pytest.mark.parametrize("unit", ["7m", "5h", "0m", "x", None])
def test_unknown_units(unit):
    with pytest.raises(ValueError):
        truncate(F.lit(None), unit)


@pytest.mark.parametrize("name", ["event_filter", "buyers_unique", "pivot_geo"])
def test_event_type_is_pushed_to_the_scan(spark, name):
    plan = getattr(E, name)(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "event_type" in plan.split("PushedFilters:")[1].split("]")[0]


@pytest.mark.parametrize("name", ["kpi_cube", "member_totals", "members_present"])
def test_raw_events_are_scanned_once(spark, name):
    """The raw scan is in the written activity; what is planned after it reads that alone."""
    plan = getattr(E, name)(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan
