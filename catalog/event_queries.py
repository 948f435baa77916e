"""Queries over the raw events: scans, dimensions, sessions and hourly tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.registry import query
from catalog.sql import BROWSER, SECOND, earliest, first_match, text
from tidemark.functions import dimensions as D
from tidemark.functions.timeparts import TRUNCATE_UNITS, parse_time, truncate
from tidemark.operators import bitmaps as M
from tidemark.operators import cube as Q
from tidemark.operators import dedup as U
from tidemark.operators import select as S
from tidemark.plans import kpi_engine as E
from tidemark.plans.analysis import Analysis
from tidemark.plans.default_config import AGENT_RULES, DEVICE_MAPPING, default_config
from tidemark.plans.profiles import SECOND_REGISTRY, member_table
from tidemark.sources.config import parse_config
from tidemark.sources.daily import DailyActivity
from tidemark.sources.events import CORE_COLUMNS, EVENT_SCHEMA, check_columns, from_second_tracker
from tidemark.sources.sinks import read_kpi_csv, write_kpi_tables, write_report_csv
from tidemark.streaming import hourly as H
from tidemark.streaming import keys as K

SESSION_COLUMNS = {
    "event_type": "first_event_type", "event_name": "first_event_name", "shop": "shop",
    "device_type": "device_type", "browser": "browser", "os": "os", "utm_source": "utm_source",
    "utm_medium": "utm_medium", "utm_campaign": "utm_campaign",
}
SESSION_OUT = ", ".join(f"{a} AS {b}" for a, b in SESSION_COLUMNS.items())
SESSION_KEEP = ", ".join(SESSION_COLUMNS)
SESSION_SQL = earliest("ev_b", "session_id", SESSION_KEEP)


def browser(spark, sf_dir, only: str | None = None) -> DataFrame:
    """Events with tenant, visitor, session, geography and device."""
    return T.browser_events(spark, sf_dir, only).withColumns({
        "tenant": F.col(BROWSER.tenant), "visitor": F.col(BROWSER.visitor),
        "session": F.col(BROWSER.session), "geo": BROWSER.geo(), "device": BROWSER.device()})


ORDER = "checkout_completed"


def orders(spark, sf_dir) -> DataFrame:
    return S.only_event(browser(spark, sf_dir, ORDER), ORDER)


def second(spark, sf_dir) -> DataFrame:
    events = from_second_tracker(T.second_tracker_events(spark, sf_dir))
    return events.withColumns({
        "tenant": F.col("client_id"), "session": F.col("session_id"),
        "geo": SECOND.geo(), "device": SECOND.device()})


# --- scans, projections, filters -------------------------------------------------------------

SCAN = ("event_details_id", "event_type", "event_name", "event_timestamp", "shop", "session_id",
        "client_id", "user_agent", "price_amount", "utm_source", "utm_medium")


@query("scan_events", f"SELECT {', '.join(SCAN)} FROM view_b")
def scan_events(spark, sf_dir):
    return check_columns(T.browser_events(spark, sf_dir), EVENT_SCHEMA, CORE_COLUMNS).select(*SCAN)


@query("core_columns_nonnull", f"""
SELECT {', '.join(CORE_COLUMNS)} FROM view_b
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CORE_COLUMNS)}""")
def core_columns_nonnull(spark, sf_dir):
    return S.complete_rows(T.browser_events(spark, sf_dir).select(*CORE_COLUMNS))


@query("event_filter", """
SELECT event_details_id, event_timestamp, price_amount FROM view_b WHERE event_name = 'checkout_completed'""")
def event_filter(spark, sf_dir):
    return S.only_event(T.browser_events(spark, sf_dir, ORDER), ORDER).select(
        "event_details_id", "event_timestamp", "price_amount")


COMPARED = (("==", "event_name", "page_viewed"), ("!=", "event_name", "page_viewed"),
            (">", "price_amount", 20), (">=", "price_amount", 6.55),
            ("<", "price_amount", 6.55), ("<=", "price_amount", 20))


@query("config_predicates", "SELECT client_id, " + ", ".join(
    f"count(*) FILTER (WHERE {c} {'=' if o == '==' else o} {text(v) if isinstance(v, str) else v}) AS rule_{i}"
    for i, (o, c, v) in enumerate(COMPARED)) + " FROM view_b GROUP BY client_id")
def config_predicates(spark, sf_dir):
    return T.browser_events(spark, sf_dir).groupBy("client_id").agg(*[
        F.count_if(S.predicate(c, o, v)).alias(f"rule_{i}") for i, (o, c, v) in enumerate(COMPARED)])


@query("utm_whitelist", f"""
SELECT client_id, utm_source, count(*) AS n FROM view_b
WHERE utm_source IN ({', '.join(text(m) for m in BROWSER.members['source'])}) GROUP BY ALL""")
def utm_whitelist(spark, sf_dir):
    events = S.members_in(T.browser_events(spark, sf_dir), "utm_source", BROWSER.members["source"])
    return events.groupBy("client_id", "utm_source").agg(F.count("*").alias("n"))


@query("null_profile", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in (*CORE_COLUMNS, "utm_source", "utm_medium"))
    + " FROM view_b")
def null_profile(spark, sf_dir):
    return S.null_profile(T.browser_events(spark, sf_dir).select(*CORE_COLUMNS, "utm_source", "utm_medium"))


@query("distinct_members", "SELECT DISTINCT os_name FROM view_s ORDER BY 1")
def distinct_members(spark, sf_dir):
    return S.distinct_values(T.second_tracker_events(spark, sf_dir), "os_name")


@query("time_bounds", """
SELECT client_id, min(event_datetime) AS first_time, max(event_datetime) AS last_time
FROM view_s GROUP BY client_id""")
def time_bounds(spark, sf_dir):
    return S.time_bounds(T.second_tracker_events(spark, sf_dir), "event_datetime", ["client_id"])


@query("country_counts", "SELECT country_name, count(*) AS n FROM view_s GROUP BY country_name")
def country_counts(spark, sf_dir):
    return S.value_counts(T.second_tracker_events(spark, sf_dir), "country_name")


@query("country_total", "SELECT count(*) AS countries FROM (SELECT DISTINCT country_name FROM view_s)")
def country_total(spark, sf_dir):
    return T.second_tracker_events(spark, sf_dir).select("country_name").distinct().agg(
        F.count("*").alias("countries"))


# --- dimensions ------------------------------------------------------------------------------

@query("geo2", "SELECT tenant, geo, count(*) AS n FROM ev_b GROUP BY ALL")
def geo2(spark, sf_dir):
    return browser(spark, sf_dir).groupBy("tenant", "geo").agg(F.count("*").alias("n"))


@query("geo7", "SELECT tenant, geo, count(*) AS n FROM ev_s GROUP BY ALL")
def geo7(spark, sf_dir):
    return second(spark, sf_dir).groupBy("tenant", "geo").agg(F.count("*").alias("n"))


@query("device_os", "SELECT user_agent, device, count(*) AS n FROM ev_b GROUP BY ALL")
def device_os(spark, sf_dir):
    return browser(spark, sf_dir).groupBy("user_agent", "device").agg(F.count("*").alias("n"))


CONFIG_DEVICE = first_match("user_agent", AGENT_RULES)


@query("dim_when_then", f"""
SELECT shop, user_agent, geo AS location, {CONFIG_DEVICE} AS device, count(*) AS n
FROM (SELECT shop, user_agent, geo FROM ev_b) GROUP BY ALL""")
def dim_when_then(spark, sf_dir):
    config = default_config(T.GLOBAL_SHOP)
    dims = config["kpis"]["visitors"]["dimensions"]
    plain = {k: v for k, v in dims["device"].items() if k != "mapping"}
    return T.browser_events(spark, sf_dir).groupBy(
        "shop", "user_agent",
        E.dimension_column(dims["location"], config).alias("location"),
        E.dimension_column(plain, config).alias("device")).agg(F.count("*").alias("n"))


MAPPED_DEVICE = f"CASE {CONFIG_DEVICE} " + " ".join(
    f"WHEN {text(a)} THEN {text(b)}" for a, b in DEVICE_MAPPING.items()) + " END"


@query("dim_mapping", f"SELECT user_agent, {MAPPED_DEVICE} AS device, count(*) AS n FROM view_b GROUP BY ALL")
def dim_mapping(spark, sf_dir):
    config = default_config(T.GLOBAL_SHOP)
    device = E.dimension_column(config["kpis"]["visitors"]["dimensions"]["device"], config)
    return T.browser_events(spark, sf_dir).groupBy("user_agent", device.alias("device")).agg(
        F.count("*").alias("n"))


SOURCE_GROUP, MEDIUM_GROUP = (first_match("utm_source", D.UTM_SOURCE_RULES),
                              first_match("utm_medium", D.UTM_MEDIUM_RULES))


@query("utm_grouped", f"""
SELECT utm_source, utm_medium, {SOURCE_GROUP} AS source_group, {MEDIUM_GROUP} AS medium_group, count(*) AS n
FROM view_b GROUP BY ALL""")
def utm_grouped(spark, sf_dir):
    return T.browser_events(spark, sf_dir).groupBy(
        "utm_source", "utm_medium",
        D.utm_source_group(F.col("utm_source")).alias("source_group"),
        D.utm_medium_group(F.col("utm_medium")).alias("medium_group")).agg(F.count("*").alias("n"))


@query("time_truncate", """
SELECT date_trunc('hour', event_timestamp) AS t_1h, CAST(date_trunc('day', event_timestamp) AS TIMESTAMP) AS t_1d,
  CAST(date_trunc('week', event_timestamp) AS TIMESTAMP) AS t_1w,
  CAST(date_trunc('month', event_timestamp) AS TIMESTAMP) AS t_1mo,
  time_bucket(INTERVAL 15 MINUTE, event_timestamp) AS t_15m, time_bucket(INTERVAL 6 HOUR, event_timestamp) AS t_6h,
  hour(event_timestamp) AS time_hour, count(*) AS n FROM view_b GROUP BY ALL""")
def time_truncate(spark, sf_dir):
    events = T.browser_events(spark, sf_dir)
    return events.groupBy(
        *[truncate(F.col("event_timestamp"), u).alias(f"t_{u}") for u in (*TRUNCATE_UNITS, "15m", "6h")],
        F.hour("event_timestamp").alias("time_hour")).agg(F.count("*").alias("n"))


@query("parse_floor_time", """
SELECT date_trunc('hour', event_timestamp) AS processed_hour, count(*) AS n FROM view_b GROUP BY ALL""")
def parse_floor_time(spark, sf_dir):
    hour = truncate(parse_time(F.col("processed_timestamp")), "1h")
    return T.browser_events(spark, sf_dir).groupBy(hour.alias("processed_hour")).agg(F.count("*").alias("n"))


# --- one row per key -------------------------------------------------------------------------

@query("visitors_unique", "SELECT tenant, visitor, event_timestamp, geo, device FROM ("
       + earliest("ev_b", "tenant, visitor", "geo, device") + ")")
def visitors_unique(spark, sf_dir):
    return U.earliest_per_key(
        browser(spark, sf_dir), ["tenant", "visitor"], "event_timestamp", ["geo", "device"], BROWSER.values)


@query("buyers_unique", "SELECT tenant, visitor, event_timestamp, geo, device FROM ("
       + earliest("ev_b", "tenant, visitor", "geo, device", "event_name = 'checkout_completed'") + ")")
def buyers_unique(spark, sf_dir):
    return U.earliest_per_key(orders(spark, sf_dir),
                              ["tenant", "visitor"], "event_timestamp", ["geo", "device"], BROWSER.values)


@query("session_rollup", f"""
SELECT session_id, event_timestamp AS session_start, {SESSION_OUT} FROM ({SESSION_SQL})""")
def session_rollup(spark, sf_dir):
    return U.session_rollup(T.browser_events(spark, sf_dir), SESSION_COLUMNS)


@query("sessions_complete", f"""
SELECT session_id, event_timestamp AS session_start, {SESSION_OUT} FROM ({SESSION_SQL})
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SESSION_COLUMNS)}""")
def sessions_complete(spark, sf_dir):
    return U.session_rollup(T.browser_events(spark, sf_dir), SESSION_COLUMNS, complete=True)


@query("session_source", "SELECT session_id, event_timestamp AS session_start, utm_source FROM ("
       + earliest("ev_b", "session_id", "utm_source") + ")")
def session_source(spark, sf_dir):
    return U.session_rollup(T.browser_events(spark, sf_dir), {"utm_source": "utm_source"})


def _top(column: str) -> str:
    return f"""SELECT {column}, count(*) AS n FROM ({SESSION_SQL})
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SESSION_COLUMNS)}
    GROUP BY {column} ORDER BY n DESC, {column} LIMIT 10"""


@query("top_sources", _top("utm_source"))
def top_sources(spark, sf_dir):
    return S.value_counts(sessions_complete(spark, sf_dir), "utm_source", top=10)


@query("top_mediums", _top("utm_medium"))
def top_mediums(spark, sf_dir):
    return S.value_counts(sessions_complete(spark, sf_dir), "utm_medium", top=10)


@query("metric_registry", " UNION ALL ".join(
    f"SELECT tenant, {text(m)} AS metric, {'count(DISTINCT session)' if unique else 'count(*)'} AS n "
    f"FROM ev_s WHERE event_name = {text(event)} GROUP BY tenant"
    for m, (event, unique) in SECOND_REGISTRY.items()))
def metric_registry(spark, sf_dir):
    return Q.registry_totals(second(spark, sf_dir), SECOND_REGISTRY)


FIRST_KEEP = "event_name, shop, user_agent, utm_source, utm_medium"
FIRST_SQL = earliest("view_b", "session_id", FIRST_KEEP, "event_name = 'page_viewed'")
FIRST_WHERE = " AND ".join(f"{c.strip()} IS NOT NULL" for c in FIRST_KEEP.split(","))


@query("first_occurrence", f"""
SELECT session_id, event_timestamp AS session_start, {FIRST_KEEP} FROM ({FIRST_SQL}) WHERE {FIRST_WHERE}""")
def first_occurrence(spark, sf_dir):
    kpi = default_config(T.GLOBAL_SHOP)["kpis"]["landing_page_viewers"]
    return E.first_occurrence(T.browser_events(spark, sf_dir), kpi)[0]


#: Folders that the streamed events come in, and how many a batch takes.
ARRIVALS, ARRIVALS_AT_ONCE = 6, 2


def _streamed_visitors(spark, sf_dir):
    """Changes of the earliest row per visitor, from events that arrive in files of mixed times."""
    work = T.work(spark)
    events = browser(spark, sf_dir).select("tenant", "visitor", "event_timestamp", "geo", "device", "event_details_id")
    events.repartition(ARRIVALS, "event_details_id").write.parquet(work.path("arrivals"))
    arriving = H.event_stream(spark, events.schema, work.path("arrivals"), maxFilesPerTrigger=ARRIVALS_AT_ONCE)
    return K.drain(K.earliest_keys(arriving, ["tenant", "visitor"], ["geo", "device"]), work.path("stream"))


@query("visitors_unique_stream", "SELECT tenant, visitor, event_timestamp, geo, device FROM ("
       + earliest("ev_b", "tenant, visitor", "geo, device") + ")")
def visitors_unique_stream(spark, sf_dir):
    return K.settled(_streamed_visitors(spark, sf_dir))


@query("hourly_visitors_stream", f"""
SELECT tenant, date_trunc('hour', event_timestamp) AS time, device AS member, count(*) AS n,
  hour(event_timestamp) AS time_hour FROM ({earliest("ev_b", "tenant, visitor", "geo, device")}) GROUP BY ALL""")
def hourly_visitors_stream(spark, sf_dir):
    """Visitors per hour and device, added up from the changes."""
    return K.hourly_changes(_streamed_visitors(spark, sf_dir), "device", by=["tenant"])


@query("first_occurrence_two_lows", f"""
SELECT f.*, l.lowest_price, l.first_page FROM (
  SELECT session_id, event_timestamp AS session_start, utm_source FROM ({earliest("view_b", "session_id", "utm_source", "event_name = 'page_viewed'")})) f
JOIN (SELECT session_id, min(price_amount) AS lowest_price, min(page_url) AS first_page FROM view_b
  WHERE event_name = 'page_viewed' GROUP BY session_id) l ON l.session_id = f.session_id""")
def first_occurrence_two_lows(spark, sf_dir):
    """A first occurrence with further minima, in the same aggregate."""
    kpi = {"calculation": {
        "method": "count", "filter": {"column": "event_name", "operator": "==", "value": "page_viewed"}, "column": "session_id",
        "first_occurrence": {"group_by": "session_id", "aggregations": [
            {"column": "event_timestamp", "agg": "min", "alias": "session_start"}, {"column": "utm_source", "agg": "first"},
            {"column": "price_amount", "agg": "min", "alias": "lowest_price"}, {"column": "page_url", "agg": "min", "alias": "first_page"}]}}}
    return E.first_occurrence(T.browser_events(spark, sf_dir), kpi)[0]


@query("dim_copy_source", "SELECT utm_medium, utm_medium AS member, count(*) AS n FROM view_b GROUP BY utm_medium")
def dim_copy_source(spark, sf_dir):
    """A dimension with neither transformations nor a mapping is its source column."""
    member = E.dimension_column({"name": "medium", "source_column": "utm_medium"}, {"mappings": {}})
    return T.browser_events(spark, sf_dir).groupBy("utm_medium", member.alias("member")).agg(F.count("*").alias("n"))


@query("dim_second_pass", f"""
SELECT user_agent, CASE WHEN device IN ('iOS', 'macOS') THEN 'Apple' ELSE device END AS device, count(*) AS n
FROM (SELECT user_agent, device FROM ev_b) GROUP BY ALL""")
def dim_second_pass(spark, sf_dir):
    """A second transformation rewrites some members of the first and keeps the others."""
    spec = {"name": "device", "source_column": "user_agent", "transformations": [
        {"type": "when_then", "default": "Other", "conditions": [
            {"condition": f"str.contains({pattern!r})", "value": member} for pattern, member in D.DEVICE_RULES]},
        {"type": "when_then", "default": "device", "conditions": [{"condition": "is_in(['iOS', 'macOS'])", "value": "Apple"}]}]}
    device = E.dimension_column(spec, {"mappings": {}})
    return T.browser_events(spark, sf_dir).groupBy("user_agent", device.alias("device")).agg(F.count("*").alias("n"))


# --- hourly tables ---------------------------------------------------------------------------

def _hourly(member: str, source: str = "ev_b", where: str = "event_name = 'checkout_completed'") -> str:
    return f"""SELECT tenant, date_trunc('hour', event_timestamp) AS time, {member} AS member, count(*) AS n,
      hour(event_timestamp) AS time_hour FROM {source} WHERE {where} GROUP BY ALL"""


@query("hourly_by_geo", _hourly("geo"))
def hourly_by_geo(spark, sf_dir):
    return Q.hourly_counts(orders(spark, sf_dir), "geo", by=["tenant"])


@query("hourly_by_device", _hourly("device"))
def hourly_by_device(spark, sf_dir):
    return Q.hourly_counts(orders(spark, sf_dir), "device", by=["tenant"])


def _wide(member: str, source: str, members, total=None) -> str:
    columns = ", ".join(f'count(*) FILTER (WHERE {member} = {text(m)}) AS "{m}"' for m in members)
    listed = ", ".join(text(m) for m in total or ())
    counted = f"count(*) FILTER (WHERE {member} IN ({listed}))" if total else "count(*)"
    return f"""SELECT tenant, hour(event_timestamp) AS time_hour, date_trunc('hour', event_timestamp) AS time,
      {columns}, {counted} AS "Total" FROM {source} GROUP BY ALL"""


@query("hourly_counts_stream", """
SELECT tenant, date_trunc('hour', event_timestamp) AS time, geo AS member, count(*) AS n FROM ev_b GROUP BY ALL""")
def hourly_counts_stream(spark, sf_dir):
    """Events per hour and location, from events that arrive by time; the last hours are closed by one far row."""
    work = T.work(spark)
    events = browser(spark, sf_dir).select("tenant", "event_timestamp", "geo")
    closing = spark.createDataFrame([(None, "2999-01-01 00:00:00", None)], "tenant string, event_timestamp string, geo string")
    ordered = events.repartitionByRange(ARRIVALS, "event_timestamp").sortWithinPartitions("event_timestamp")
    ordered.write.parquet(work.path("arrivals"))
    closing.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz")).write.mode("append").parquet(work.path("arrivals"))
    # In one batch: the watermark follows it.
    arriving = H.event_stream(spark, events.schema, work.path("arrivals"))
    return K.drain(H.hourly_counts(arriving, "geo", by=["tenant"]), work.path("stream"))


@query("pivot_geo", _wide("geo", "(SELECT * FROM ev_b WHERE event_name = 'checkout_completed')",
                          BROWSER.members["geo"], BROWSER.members["geo"]))
def pivot_geo(spark, sf_dir):
    members = BROWSER.members["geo"]
    return Q.pivot_members(hourly_by_geo(spark, sf_dir), members, ["tenant"], total=members)


@query("pivot_device", _wide("device", f"({earliest('ev_b', 'tenant, visitor', 'geo, device')})",
                             BROWSER.members["device"]))
def pivot_device(spark, sf_dir):
    counts = Q.hourly_counts(visitors_unique(spark, sf_dir), "device", by=["tenant"])
    return Q.pivot_members(counts, BROWSER.members["device"], ["tenant"])


@query("geo7_hourly_padded", f"""
SELECT tenant, time_hour, time, {', '.join(f'"{m}"' for m in SECOND.members['geo'])}, "Total"
FROM ({_wide('geo', f"({earliest('ev_s', 'tenant, session', 'geo')})", SECOND.members['geo'],
             SECOND.members['geo'])})""")
def geo7_hourly_padded(spark, sf_dir):
    members = SECOND.members["geo"]
    first = U.earliest_per_key(second(spark, sf_dir), ["tenant", "session"], "event_timestamp", ["geo"], SECOND.values)
    counts = Q.hourly_counts(first, "geo", by=["tenant"])
    return Q.pivot_members(counts, members, ["tenant"], total=members)


@query("kpi_grouping_sets", """
SELECT tenant, date_trunc('hour', event_timestamp) AS ds, geo, device, count(*) AS n,
  CASE WHEN grouping(geo) = 0 THEN 'geo' WHEN grouping(device) = 0 THEN 'device' ELSE 'total' END AS dim
FROM ev_b WHERE event_name = 'checkout_completed'
GROUP BY GROUPING SETS ((tenant, ds), (tenant, ds, geo), (tenant, ds, device))""")
def kpi_grouping_sets(spark, sf_dir):
    return Q.grouping_sets_cube(orders(spark, sf_dir))


LEVELS = (("tenant", "ds"), ("tenant", "ds", "geo"), ("tenant", "ds", "device"), ("tenant", "day"),
          ("tenant", "day", "geo"), ("tenant", "device"), ("tenant",))
LEVEL_COLUMNS = ("tenant", "day", "ds", "geo", "device")


@query("visitors_grouping_sets", " UNION ALL ".join(
    f"SELECT {', '.join(c if c in level else f'NULL AS {c}' for c in LEVEL_COLUMNS)}, {i} AS level, count(DISTINCT visitor) AS n "
    f"FROM hours_b GROUP BY {', '.join(level)}" for i, level in enumerate(LEVELS)), hours_b="""
SELECT *, CAST(event_timestamp AS DATE) AS day, date_trunc('hour', event_timestamp) AS ds FROM ev_b""")
def visitors_grouping_sets(spark, sf_dir):
    """Unique visitors by hour, day, member and altogether, from one set of bitmaps."""
    hours = browser(spark, sf_dir).withColumns({
        "ds": truncate(F.col("event_timestamp")), "day": F.col("event_timestamp").cast("date")})
    return M.unique_levels(hours, "visitor", LEVEL_COLUMNS, LEVELS)


# --- second tracker and members --------------------------------------------------------------

@query("members_present", "SELECT c.* FROM cube_s c SEMI JOIN reg_s r USING (metric, dim, member)")
def members_present(spark, sf_dir):
    cube = Q.kpi_cube(Analysis(second_events(spark, sf_dir), SECOND, T.work(spark)).activity, SECOND)
    return S.registered_members(cube, member_table(spark, SECOND), ("metric", "dim", "member"))


def second_events(spark, sf_dir):
    return from_second_tracker(T.second_tracker_events(spark, sf_dir))


@query("kpi_cube", "SELECT * FROM cube_b")
def kpi_cube(spark, sf_dir):
    return Q.kpi_cube(Analysis(T.browser_events(spark, sf_dir), BROWSER, T.work(spark)).activity, BROWSER)


@query("kpi_cube_incremental", "SELECT * FROM cube_b")
def kpi_cube_incremental(spark, sf_dir):
    """The cube of days kept from three uneven loads, of which one is late and one comes twice."""
    events, day = T.browser_events(spark, sf_dir), F.to_date("event_timestamp")
    kept = DailyActivity(spark, T.work(spark).path("days"), BROWSER)
    late = (F.dayofmonth(day) % 10 == 4) & (F.hour("event_timestamp") >= 9)
    early = F.dayofmonth(day) <= 11
    kept.add(events.where(early & ~late), "first")
    kept.add(events.where(~early & ~late), "second")
    kept.add(events.where(~early & ~late), "second")
    kept.add(events.where(late), "late")
    return Q.kpi_cube(kept.read(), BROWSER)


@query("member_totals", """
SELECT metric, dim, member, CAST(sum(y) AS BIGINT) AS n FROM cube_b GROUP BY ALL""")
def member_totals(spark, sf_dir):
    return kpi_cube(spark, sf_dir).groupBy("metric", "dim", "member").agg(F.sum("y").alias("n"))


# --- configured KPIs -------------------------------------------------------------------------

def _kpi_part(name: str, kpi: dict) -> str:
    calculation = kpi["calculation"]
    event = (calculation.get("filter") or {}).get("value")
    where = f"event_name = {text(event)}" if event else "TRUE"
    if calculation.get("first_occurrence"):
        source = f"SELECT * FROM ({earliest('view_b', 'client_id, session_id', FIRST_KEEP, where)}) WHERE {FIRST_WHERE}"
    elif calculation["method"] == "unique_count":
        source = earliest("dim_b", "client_id, event_details_clientid", "location, device", where)
    else:
        source = f"SELECT * FROM view_b WHERE {where}"
    exprs = {"location": f"CASE WHEN shop = {text(T.GLOBAL_SHOP)} THEN 'Global' ELSE 'US' END",
             "device": MAPPED_DEVICE, "utm_source": SOURCE_GROUP, "utm_medium": MEDIUM_GROUP}
    return " UNION ALL ".join(
        f"SELECT client_id, {text(name)} AS kpi, {text(dim)} AS dim, {exprs[dim]} AS member, "
        f"date_trunc('hour', event_timestamp) AS time, count(*) AS n FROM ({source}) GROUP BY ALL"
        for dim in kpi["dimensions"])


KPI_CONFIG = default_config(T.GLOBAL_SHOP)
DIM_VIEW = (f"SELECT *, CASE WHEN shop = {text(T.GLOBAL_SHOP)} THEN 'Global' ELSE 'US' END AS location, "
            f"{MAPPED_DEVICE} AS device FROM view_b")


@query("kpi_engine", " UNION ALL ".join(_kpi_part(n, k) for n, k in KPI_CONFIG["kpis"].items()), dim_b=DIM_VIEW)
def kpi_engine(spark, sf_dir):
    return E.kpi_long(T.browser_events(spark, sf_dir), KPI_CONFIG, by=["client_id"])


SOURCE_MEMBERS = [m for _, m in D.UTM_SOURCE_RULES] + ["Other"]


@query("pivot_final_order", f"""
SELECT hour(event_timestamp) AS time_hour, date_trunc('hour', event_timestamp) AS time,
  {', '.join(f"count(*) FILTER (WHERE {SOURCE_GROUP} = {text(m)}) AS " + chr(34) + m + chr(34) for m in SOURCE_MEMBERS)},
  count(*) AS "Total" FROM ({FIRST_SQL}) WHERE {FIRST_WHERE} GROUP BY ALL""")
def pivot_final_order(spark, sf_dir):
    long = E.kpi_long(T.browser_events(spark, sf_dir), KPI_CONFIG)
    return E.kpi_wide(long, "landing_page_viewers", "utm_source", KPI_CONFIG)


def _hour_config() -> dict:
    """The default configuration with every table by hour of day."""
    config = default_config(T.GLOBAL_SHOP)
    for pivot in config["pivot_configs"].values():
        pivot["index"] = ["time_hour"]
        pivot.pop("final_column_order", None)
    return config


@query("kpi_hour_of_day", f"""
SELECT client_id, hour(event_timestamp) AS time_hour, count(*) FILTER (WHERE geo = 'Global') AS "Global",
  count(*) FILTER (WHERE geo = 'US') AS "US", count(*) AS "Total"
FROM ev_b WHERE event_name = {text(ORDER)} GROUP BY ALL""")
def kpi_hour_of_day(spark, sf_dir):
    """Orders by hour of day and location, of a configuration whose index is the hour alone."""
    config = _hour_config()
    long = E.kpi_long(T.browser_events(spark, sf_dir, ORDER), config, by=["client_id"])
    return E.kpi_wide(long, "orders", "location", config, by=["client_id"])


CONDITIONS = (
    ("str.starts_with('Mozilla') & str.contains('iPhone|iPad')", "starts_with(user_agent, 'Mozilla') AND regexp_matches(user_agent, 'iPhone|iPad')", "Phone"),
    ("is_null() | pl.col('utm_source').is_in(['google', 'bing'])", "user_agent IS NULL OR utm_source IN ('google', 'bing')", "Searched"),
    ("str.ends_with('Win64)') & ~(pl.col('price_amount') >= 20)", "ends_with(user_agent, 'Win64)') AND NOT (price_amount >= 20)", "Small basket"),
)


@query("dim_conditions", f"""
SELECT user_agent, CASE {' '.join(f"WHEN {s} THEN {text(m)}" for _, s, m in CONDITIONS)} END AS device, count(*) AS n
FROM view_b GROUP BY ALL""")
def dim_conditions(spark, sf_dir):
    """A dimension of joined conditions on several columns."""
    spec = {"source_column": "user_agent", "transformations": [{"type": "when_then", "default": None, "conditions": [
        {"condition": c, "value": m} for c, _, m in CONDITIONS]}]}
    device = E.dimension_column(spec, {"mappings": {}})
    return T.browser_events(spark, sf_dir).groupBy("user_agent", device.alias("device")).agg(F.count("*").alias("n"))


@query("kpi_wide_null_member", f"""
SELECT client_id, date_trunc('hour', event_timestamp) AS time_truncated, hour(event_timestamp) AS time_hour,
  count(*) FILTER (WHERE shop = {text(T.GLOBAL_SHOP)}) AS "Global", count(*) FILTER (WHERE shop <> {text(T.GLOBAL_SHOP)}) AS "null",
  count(*) AS "Total" FROM view_b WHERE event_name = {text(ORDER)} GROUP BY ALL""")
def kpi_wide_null_member(spark, sf_dir):
    """Orders by location where the configuration leaves every shop but one without a member."""
    config = default_config(T.GLOBAL_SHOP)
    for kpi in config["kpis"].values():
        kpi["dimensions"]["location"] = {"name": "location", "source_column": "shop", "transformations": [{
            "type": "when_then", "default": None, "conditions": [{"condition": f"eq('{T.GLOBAL_SHOP}')", "value": "Global"}]}]}
    config["pivot_configs"]["location"] = {}
    long = E.kpi_long(T.browser_events(spark, sf_dir, ORDER), config, by=["client_id"])
    return E.kpi_wide(long, "orders", "location", config, by=["client_id"])


@query("kpi_config", " UNION ALL ".join(
    f"SELECT {text(n)} AS kpi, count(*) AS n FROM view_b WHERE "
    + (f"event_name = {text(k['calculation']['filter']['value'])}" if k["calculation"]["filter"] else "TRUE")
    for n, k in KPI_CONFIG["kpis"].items()))
def kpi_config(spark, sf_dir):
    """Events that each KPI of a configuration, parsed and checked from JSON, selects."""
    config = parse_config(json.dumps(KPI_CONFIG))
    events = T.browser_events(spark, sf_dir)
    flags = {n: E.kpi_filter(k) for n, k in config["kpis"].items()}
    counts = events.agg(*[F.count_if(F.lit(True) if c is None else c).alias(n) for n, c in flags.items()])
    return counts.unpivot([], list(flags), "kpi", "n")


@query("kpi_csv_tables", f"""
SELECT hour(event_timestamp) AS time_hour, date_trunc('hour', event_timestamp) AS time,
  {', '.join(f"count(*) FILTER (WHERE {MAPPED_DEVICE} = {text(m)}) AS " + chr(34) + m + chr(34) for m in ('Mobile', 'Desktop', 'Other'))}, count(*) AS "Total"
FROM view_b WHERE event_name = {text(ORDER)} GROUP BY ALL""")
def kpi_csv_tables(spark, sf_dir):
    """Configured tables of orders written as CSV, one of them read back."""
    config = default_config(T.GLOBAL_SHOP)
    config["kpis"] = {"orders": config["kpis"]["orders"]}
    work = T.work(spark)
    tables = E.kpi_tables(T.browser_events(spark, sf_dir, ORDER), config, work=work)
    paths = write_kpi_tables(tables, work.path("csv"))
    return read_kpi_csv(spark, paths["orders", "device"], tables["orders", "device"].schema)


@query("csv_roundtrip", _wide("geo", "(SELECT * FROM ev_b WHERE event_name = 'checkout_completed')",
                              BROWSER.members["geo"], BROWSER.members["geo"]))
def csv_roundtrip(spark, sf_dir):
    wide = pivot_geo(spark, sf_dir)
    path = T.work(spark).path("orders_geo")
    write_report_csv(wide, path)
    return read_kpi_csv(spark, path, wide.schema)
