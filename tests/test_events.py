"""Sources, configuration, sessions and hourly tables."""

import copy
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.sql import BROWSER, SECOND
from tidemark.functions import dimensions as D
from tidemark.functions.arrays import clean_names
from tidemark.functions.timeparts import parse_time, truncate, utc_ntz
from tidemark.operators import cube as Q
from tidemark.operators import dedup as U
from tidemark.operators import select as S
from tidemark.plans import kpi_engine as E
from tidemark.plans.analysis import Analysis
from tidemark.plans.default_config import default_config
from tidemark.sources import events as V
from tidemark.sources import sinks
from tidemark.sources.config import load_config, validate
from tidemark.sources.work import WorkTables, shared_folder

SF_DIR = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 0, 30)
HOUR = dt.timedelta(hours=1)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_schema_check(spark, tmp_path):
    path = str(tmp_path / "events")
    T.browser_events(spark, SF_DIR).write.parquet(path)
    assert V.read_events(spark, path).count() == 1000
    with pytest.raises(ValueError, match="screen_width"):
        V.read_events(spark, path, ["screen_width"])
    wrong = T.browser_events(spark, SF_DIR).withColumn("shop", F.lit(1))
    with pytest.raises(ValueError, match="shop is int"):
        V.check_columns(wrong, V.EVENT_SCHEMA, ["shop"])
    with pytest.raises(ValueError, match="os_name"):
        V.from_second_tracker(T.second_tracker_events(spark, SF_DIR).drop("os_name"))


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    T.browser_events(spark, SF_DIR).write.parquet(path)
    rows = S.only_event(V.read_events(spark, path), "checkout_completed").select("event_timestamp", "price_amount")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_name,checkout_completed)" in plan
    assert "ReadSchema: struct<event_name:string,event_timestamp:timestamp_ntz,price_amount:double>" in plan


def test_zoned_time_becomes_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT timestamp'2024-03-10T07:30:00.123456Z' AS t")
        got = df.select(utc_ntz(F.col("t")).cast("string"), truncate(utc_ntz(F.col("t"))).cast("string")).first()
        assert tuple(got) == ("2024-03-10 07:30:00.123456", "2024-03-10 07:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("text,want", [
    ("2024-01-02T03:04:05.123456Z", "2024-01-02 03:00:00"), ("2024-01-02 03:04:05", "2024-01-02 03:00:00"),
    ("2024-01-02 03:04", "2024-01-02 03:00:00"), ("2024-01-02", "2024-01-02 00:00:00"), ("soon", None)])
def test_mixed_time_text(spark, text, want):
    assert one(spark, truncate(parse_time(F.col("t"))).cast("string"), t=text) == want


def test_units(spark):
    t = F.lit("2024-02-29 13:59:59").cast("timestamp_ntz")
    row = spark.range(1).select(*[truncate(t, u).cast("string") for u in ("1h", "1d", "1w", "1mo")]).first()
    assert tuple(row) == ("2024-02-29 13:00:00", "2024-02-29 00:00:00", "2024-02-26 00:00:00", "2024-02-01 00:00:00")
    with pytest.raises(ValueError):
        truncate(t, "7m")


def test_dimension_rules(spark):
    assert one(spark, D.device_from_agent(F.col("a")), a="iPhone; like Mac OS X") == "iOS"
    assert one(spark, D.device_from_agent(F.col("a")), a=None) == "Other"
    assert one(spark, D.geo_by_country(F.col("c")), c=None) == "Unknown Location"
    assert one(spark, D.geo_by_country(F.col("c")), c="Peru") == "Other"
    assert one(spark, D.utm_source_group(F.col("s")), s="hs_email") == "Email"
    assert one(spark, D.mapped(F.col("x"), {"a": "A"}), x="b") == "b"
    assert one(spark, D.mapped(F.col("x"), {"a": "A"}, "rest"), x="b") == "rest"
    assert one(spark, D.mapped(F.col("x"), {"a": "A"}), x="a") == "A"
    assert spark.range(1).select(clean_names(F.array(*[F.lit(x) for x in (
        "percent_diff iOS", " US ", "iOS", "", None)]))).first()[0] == ["US", "iOS"]


def test_visitor_counts_once_in_the_earliest_hour(spark):
    rows = [("v", T0 + HOUR, "b"), ("v", T0, "z"), ("v", T0, "a"), (None, T0, "n"), (None, T0 + HOUR, "n"), ("w", None, "x")]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, d string")
    got = sorted((r.k or "", r.t, r.d) for r in U.earliest_per_key(df, ["k"], "t", ["d"]).collect())
    assert got == [("", T0, "n"), ("v", T0, "a")]


def test_cube_totals_equal_populations(spark):
    events = T.browser_events(spark, SF_DIR)
    totals = {r.metric: r.n for r in Q.kpi_cube(Q.activity(events, BROWSER), BROWSER)
              .where("dim = 'total'").groupBy("metric").agg(F.sum("y").alias("n")).collect()}
    assert totals["visitors"] == events.select("client_id", "event_details_clientid").distinct().count()
    orders = S.only_event(events, "checkout_completed")
    assert totals["orders"] == orders.count()
    assert totals["buyers"] == orders.select("client_id", "event_details_clientid").distinct().count()


def test_activity_of_days_can_be_put_together(spark):
    events = T.browser_events(spark, SF_DIR)
    early = F.col("event_timestamp") < "2024-01-15"
    parts = Q.activity(events.where(early), BROWSER).unionByName(Q.activity(events.where(~early), BROWSER))
    whole = Q.kpi_cube(Q.activity(events, BROWSER), BROWSER)
    assert Q.kpi_cube(parts, BROWSER).exceptAll(whole).count() == 0
    assert whole.exceptAll(Q.kpi_cube(parts, BROWSER)).count() == 0


def test_one_key_with_a_third_of_the_rows(spark):
    """A hot visitor, and a hot shop, leave each map task as a handful of rows."""
    events = T.browser_events(spark, SF_DIR)
    hot = spark.range(0, 200_000, 1, 8).select(
        F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("event_timestamp"),
        F.lit("page_viewed").alias("event_name"), F.lit("bot").alias("event_details_clientid"),
        F.lit("bot").alias("session_id"), F.lit("tenant_0").alias("client_id"), F.lit("x").alias("shop"),
        F.lit("Windows").alias("user_agent"), F.lit("google").alias("utm_source"), F.lit("cpc").alias("utm_medium"))
    act = Q.activity(events.select(*hot.columns).unionByName(hot), BROWSER)
    assert act.where("visitor = 'bot'").count() == 56
    assert act.where("visitor = 'bot'").agg(F.sum("n")).first()[0] == 200_000
    cube = Q.kpi_cube(act, BROWSER).where("tenant = 'tenant_0' AND metric = 'visitors' AND dim = 'total'")
    plain = Q.kpi_cube(Q.activity(events, BROWSER), BROWSER).where(
        "tenant = 'tenant_0' AND metric = 'visitors' AND dim = 'total'")
    assert cube.agg(F.sum("y")).first()[0] == plain.agg(F.sum("y")).first()[0] + 1


def test_dense_series_fills_members_not_hours(spark):
    rows = [("t", "orders", "geo", "US", T0, 3), ("t", "orders", "geo", "Mars", T0 + HOUR, 1)]
    cube = spark.createDataFrame(rows, "tenant string, metric string, dim string, member string, ds timestamp_ntz, y bigint")
    got = {(r.member, r.ds): r.y for r in Q.dense_series(cube, BROWSER).collect()}
    assert got == {("US", T0): 3, ("Global", T0): 0, ("US", T0 + HOUR): 0, ("Global", T0 + HOUR): 0}


# --- configuration ---------------------------------------------------------------------------

def changed(path, value):
    config = copy.deepcopy(default_config(T.GLOBAL_SHOP))
    *way, last = path
    node = config
    for key in way:
        node = node[key]
    node[last] = value
    return config


@pytest.mark.parametrize("path,value,message", [
    (("common_configs", "time_truncate_unit"), "7m", "time_truncate_unit"),
    (("kpis", "orders", "calculation", "method"), "median", "median"),
    (("kpis", "orders", "calculation", "filter", "operator"), "~", "operator"),
    (("kpis", "orders", "dimensions", "device", "mapping"), "nope", "mapping"),
    (("kpis", "landing_page_viewers", "calculation", "first_occurrence", "aggregations"),
     [{"column": "shop", "agg": "last"}], "last"),
])
def test_config_errors(path, value, message):
    with pytest.raises(ValueError, match=message):
        validate(changed(path, value))


def test_missing_section_is_named(tmp_path):
    config = default_config(T.GLOBAL_SHOP)
    del config["pivot_configs"]
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config))
    with pytest.raises(ValueError, match="pivot_configs"):
        load_config(str(path))


def test_sixteen_tables(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    T.browser_events(spark, SF_DIR).write.parquet(source)
    path = tmp_path / "config.json"
    path.write_text(json.dumps(default_config(T.GLOBAL_SHOP, source, out)))
    written = E.run(spark, str(path))
    assert len(written) == 16
    table = spark.read.csv(written["visitors", "device"], header=True, inferSchema=True)
    assert table.columns == ["time_hour", "time", "Total", "Mobile", "Desktop", "Other"]
    assert table.where("Total <> Mobile + Desktop + Other").count() == 0


def test_copied_dimension_takes_members_from_the_data(spark):
    config = changed(("kpis", "orders", "dimensions", "device"), {"name": "device", "source_column": "utm_medium"})
    config["kpis"] = {"orders": config["kpis"]["orders"]}
    events = T.browser_events(spark, SF_DIR)
    wide = E.kpi_tables(events, config, fill=None)["orders", "device"]
    assert {"cpc", "email", "null"} <= set(wide.columns)
    assert wide.agg(F.sum("Total")).first()[0] == S.only_event(events, "checkout_completed").count()


# --- whole runs ------------------------------------------------------------------------------

def test_reports_are_written(spark, tmp_path):
    Analysis(V.from_second_tracker(T.second_tracker_events(spark, SF_DIR)), SECOND, T.work(spark)).write(str(tmp_path))
    groups = spark.read.csv(str(tmp_path / "anomaly_group_report"), header=True)
    assert groups.count() > 0 and "login_contributors" in groups.columns
    assert spark.read.json(str(tmp_path / "anomaly_classifications")).where("size(reasoning) >= 4").count() > 0
    cube = spark.read.parquet(str(tmp_path / "kpi_cube"))
    assert {"metric", "dim"} <= set(cube.columns)


def test_report_has_every_hour_of_every_shop(spark):
    a = Analysis(T.browser_events(spark, SF_DIR), BROWSER, T.work(spark))
    bounds = a.scored.groupBy("tenant").agg(F.min("ds").alias("a"), F.max("ds").alias("b")).collect()
    hours = sum(int((r.b - r.a) / HOUR) + 1 for r in bounds)
    assert a.hour_report.count() == hours * len(a.metric_names)


def test_no_pairwise_joins(spark):
    a = Analysis(T.browser_events(spark, SF_DIR), BROWSER, T.work(spark))
    for df in (a.classified, a.group_report, a.history(), a.summary_lines, a.member_report):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_csv_and_bounds(spark, tmp_path):
    df = spark.createDataFrame([(T0, ["a", "b"], {"k": 1})], "time timestamp_ntz, names array<string>, m map<string,int>")
    sinks.write_report_csv(df, str(tmp_path / "r"))
    row = spark.read.csv(str(tmp_path / "r"), header=True).first()
    assert (row.time, row.names, row.m) == ("2024-01-01 00:30:00", "a|b", '{"k":1}')
    days = S.between_days(spark.createDataFrame([(T0,), (T0 + 24 * HOUR,), (T0 + 48 * HOUR,)], "t timestamp_ntz"),
                          "t", "2024-01-01", "2024-01-02")
    assert days.count() == 2
    assert S.pad_columns(df, ["names", "x"]).columns == ["time", "names", "m", "x"]


def test_work_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            WorkTables(spark)
    assert WorkTables(spark, "/x/").folder.startswith("/x/tidemark-")


@pytest.mark.parametrize("pivot", [{}, {"members": ["Mobile"]}])
def test_total_counts_rows_without_a_listed_member(spark, pivot):
    from tidemark.plans.kpi_engine import can_be_null, kpi_wide

    long = spark.createDataFrame(
        [("orders", "device", m, "2025-02-24 01:00:00", n) for m, n in (("Mobile", 2), ("Other", 3), (None, 4))],
        "kpi string, dim string, member string, time string, n long").withColumn("time", F.col("time").cast("timestamp_ntz"))
    step = {"type": "when_then", "conditions": [{"condition": "eq('m')", "value": "Mobile"}], "default": None}
    spec = {"name": "device", "source_column": "x", "transformations": [step]}
    config = {"kpis": {"orders": {"dimensions": {"device": spec}}}, "pivot_configs": {"device": pivot}, "mappings": {}}
    row = kpi_wide(long, "orders", "device", config).first()
    assert (row["Mobile"], row["null"], row["Total"]) == (2, 4, 9) and can_be_null(spec, config)


def test_only_the_word_device_keeps_the_value(spark):
    from tidemark.plans.kpi_engine import dimension_column

    step = {"type": "when_then", "conditions": [{"condition": "eq('a')", "value": "A"}], "default": "Other"}
    spec = {"name": "Other", "source_column": "x", "transformations": [step]}
    data = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r[0] for r in data.select(dimension_column(spec, {"mappings": {}})).collect()] == ["A", "Other", "Other"]
