"""Queries over the scored series, contributors, groups and their classification."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.event_queries import second_events
from catalog.registry import joined, query
from catalog.sql import BROWSER, KEYED, SECOND, mean, text
from tidemark.functions.arrays import clean_name_lists
from tidemark.functions.timeparts import truncate
from tidemark.operators import baseline as B
from tidemark.operators import classify as K
from tidemark.operators import contributors as C
from tidemark.operators import groups as G
from tidemark.operators import history as H
from tidemark.operators import patterns as P
from tidemark.operators import report as R
from tidemark.operators import scenarios as S
from tidemark.operators.intervals import interval_join
from tidemark.operators.select import any_flag, between_days
from tidemark.operators.trend import break_segments
from tidemark.operators.forecast import per_series
from tidemark.plans.analysis import Analysis
from tidemark.sources.sinks import write_report_csv
from tidemark.streaming.hourly import anomaly_groups as stream_groups
from tidemark.streaming.hourly import event_stream
from tidemark.streaming.keys import drain

FORECAST = "tenant, metric, dim, member, ds, y, yhat, yhat_lower, yhat_upper"
SCORED = FORECAST + ", is_anomaly, diff, percent_diff"
B_METRICS = [m.name for m in BROWSER.modelled]
S_METRICS = [m.name for m in SECOND.modelled]


def browser(spark, sf_dir) -> Analysis:
    return Analysis(T.browser_events(spark, sf_dir), BROWSER, T.work(spark))


def second(spark, sf_dir) -> Analysis:
    return Analysis(second_events(spark, sf_dir), SECOND, T.work(spark))


def on_second(counterpart: str) -> str:
    """The SQL of a first-tracker query over the tables of the second one."""
    return re.sub(r"_b\b", "_s", counterpart)


# --- series ----------------------------------------------------------------------------------

@query("seasonal_baseline", f"SELECT {FORECAST} FROM forecast_b")
def seasonal_baseline(spark, sf_dir):
    return B.seasonal_baseline(browser(spark, sf_dir).series)


@query("baseline_breaks", f"SELECT {FORECAST} FROM bforecast_b")
def baseline_breaks(spark, sf_dir):
    """The baseline whose trend may break in two rounds."""
    return B.seasonal_baseline(browser(spark, sf_dir).series, break_rounds=2)


@query("trend_segments", """
SELECT tenant, metric, dim, member, min(day) AS first_day, max(day) AS last_day, count(*) AS days
FROM seg2_b GROUP BY tenant, metric, dim, member, segment""")
def trend_segments(spark, sf_dir):
    keys = list(B.SERIES)
    days = break_segments(browser(spark, sf_dir).series, keys, 2)
    return days.groupBy(*keys, "segment").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("segment")


@query("anomaly_score", f"SELECT {SCORED} FROM scored_b")
def anomaly_score(spark, sf_dir):
    return B.score(B.seasonal_baseline(browser(spark, sf_dir).series))


def _mean_of_hour(frame):
    """A forecaster of one series: the mean of each hour of day, give or take 10."""
    mean = frame.groupby(frame["ds"].dt.hour)["y"].transform("mean").round(6)
    return frame.assign(yhat=mean, yhat_lower=mean - 10, yhat_upper=mean + 10)


@query("own_forecaster", """
SELECT tenant, metric, dim, member, ds, y, yhat, CASE WHEN abs(y - yhat) <= 10 THEN 0 ELSE 1 END AS is_anomaly
FROM (SELECT *, round(avg(y) OVER (PARTITION BY tenant, metric, dim, member, hour(ds)), 6) AS yhat FROM series_b)""")
def own_forecaster(spark, sf_dir):
    """Series scored by a forecaster of one's own."""
    a = Analysis(T.browser_events(spark, sf_dir), BROWSER, T.work(spark), forecaster=per_series(_mean_of_hour))
    return a.scored.select("tenant", "metric", "dim", "member", "ds", "y", "yhat", "is_anomaly")


@query("second_tracker_score", f"SELECT {SCORED} FROM scored_s")
def second_tracker_score(spark, sf_dir):
    return B.score(B.seasonal_baseline(second(spark, sf_dir).series))


@query("anomaly_weight", f"""
SELECT s.tenant, s.metric, s.dim, s.member, s.ds, s.is_anomaly,
  CASE WHEN s.is_anomaly = 1 THEN round(min(least(abs(n.yhat_lower - s.y), abs(n.yhat_upper - s.y))), 6)
    ELSE 0 END AS anomaly_weight
FROM scored_b s JOIN scored_b n ON n.tenant = s.tenant AND n.metric = s.metric AND n.dim = s.dim
  AND n.member = s.member AND n.ds BETWEEN s.ds - INTERVAL 8 HOUR AND s.ds + INTERVAL 8 HOUR
GROUP BY s.tenant, s.metric, s.dim, s.member, s.ds, s.is_anomaly""")
def anomaly_weight(spark, sf_dir):
    return B.anomaly_weight(browser(spark, sf_dir).scored).select(
        "tenant", "metric", "dim", "member", "ds", "is_anomaly", "anomaly_weight")


@query("contribution_share", """
SELECT m.*, t.is_anomaly, t.yhat AS top_yhat, t.percent_diff AS top_percent_diff FROM (
  SELECT tenant, metric, ds, member, yhat AS pred, diff, percent_diff, round(sum(yhat) OVER w, 6) AS pred_added,
    round(sum(diff) OVER w, 6) AS diff_added, 0 AS diff_sign_added,
    round(diff / nullif(round(sum(diff) OVER w, 6), 0), 6) AS share
  FROM scored_b WHERE dim = 'device' WINDOW w AS (PARTITION BY tenant, metric, ds)) m
JOIN top_b t ON t.tenant = m.tenant AND t.metric = m.metric AND t.ds = m.ds""")
def contribution_share(spark, sf_dir):
    return B.contribution_share(browser(spark, sf_dir).scored, "device")


@query("member_percent_diff", """
SELECT m.tenant, m.metric, m.ds, m.dim, m.member, m.percent_diff, t.is_anomaly
FROM scored_b m JOIN top_b t ON t.tenant = m.tenant AND t.metric = m.metric AND t.ds = m.ds
WHERE m.dim IN ('geo', 'source', 'medium')""")
def member_percent_diff(spark, sf_dir):
    return B.member_percent_diff(browser(spark, sf_dir).scored, ["geo", "source", "medium"])


@query("percent_diff_at", """
SELECT g.tenant, g.metric, g.start_hour AS ds, t.percent_diff
FROM (SELECT s.tenant, s.start_hour, m.metric FROM sspan_b s CROSS JOIN mreg_b m) g
LEFT JOIN top_b t ON t.tenant = g.tenant AND t.metric = g.metric AND t.ds = g.start_hour""")
def percent_diff_at(spark, sf_dir):
    a = browser(spark, sf_dir)
    names = F.explode(F.array(*[F.lit(m) for m in a.metric_names]))
    points = G.summary_spans(a.summary_rows).select("tenant", names.alias("metric"), F.col("start_hour").alias("ds"))
    return R.percent_diff_at(points, a.scored)


RANGE_VIEW = """
SELECT t.tenant, t.ds, t.y, h.event_names FROM top_b t JOIN (
  SELECT tenant, ds, string_agg(CASE WHEN anomaly = 1 THEN metric END, ',' ORDER BY metric_ord) AS event_names
  FROM hr_b GROUP BY ALL) h ON h.tenant = t.tenant AND h.ds = t.ds
WHERE t.metric = 'visitors' AND t.ds >= TIMESTAMP '2024-01-05' AND t.ds < TIMESTAMP '2024-01-09'"""


def _range_view(a: Analysis) -> DataFrame:
    visitors = B.top_level(a.scored).where(F.col("metric") == "visitors").select("tenant", "ds", "y")
    hours = a.hours.withColumnRenamed("hour", "ds").withColumn("event_names", joined("event_names"))
    rows = between_days(visitors, "ds", "2024-01-05", "2024-01-08")
    return rows.join(hours, ["tenant", "ds"])


@query("date_range_view", RANGE_VIEW)
def date_range_view(spark, sf_dir):
    return _range_view(browser(spark, sf_dir))


@query("second_tracker_range_view", on_second(RANGE_VIEW))
def second_tracker_range_view(spark, sf_dir):
    return _range_view(second(spark, sf_dir))


# --- contributors ----------------------------------------------------------------------------

@query("nn_distance", "SELECT tenant, metric, dim, ds, distance FROM nn_b")
def nn_distance(spark, sf_dir):
    return browser(spark, sf_dir).distances


@query("knee_eps", "SELECT tenant, metric, dim, eps FROM eps_b")
def knee_eps(spark, sf_dir):
    return browser(spark, sf_dir).eps


@query("knee_eps_local", "SELECT tenant, metric, dim, eps FROM leps_b")
def knee_eps_local(spark, sf_dir):
    return C.knee_eps(browser(spark, sf_dir).distances, "local")


@query("max_contributors", "SELECT tenant, metric, dim, ds, contributors FROM bydim_b")
def max_contributors(spark, sf_dir):
    return browser(spark, sf_dir).by_dim.withColumn("contributors", joined("contributors"))


@query("second_tracker_contributors", "SELECT tenant, metric, dim, ds, contributors FROM bydim_s")
def second_tracker_contributors(spark, sf_dir):
    return second(spark, sf_dir).by_dim.withColumn("contributors", joined("contributors"))


@query("contributors_combined", "SELECT tenant, metric, ds, contributors FROM combined_b")
def contributors_combined(spark, sf_dir):
    return browser(spark, sf_dir).contributors.withColumn("contributors", joined("contributors"))


@query("clean_contributors", "SELECT tenant, ds, string_agg(DISTINCT member, ',' ORDER BY member) AS names "
       "FROM name_b GROUP BY tenant, ds")
def clean_contributors(spark, sf_dir):
    """Names of an hour over all metrics, from prefixed column names."""
    raw = F.transform("contributors", lambda n: F.concat(F.lit("percent_diff "), n))
    rows = browser(spark, sf_dir).by_dim.groupBy("tenant", "ds").agg(
        clean_name_lists(F.collect_list(raw)).alias("names"))
    return rows.select("tenant", "ds", joined("names").alias("names")).where(F.col("names").isNotNull())


def _side(dim: str) -> str:
    return (f"SELECT tenant, contributors, string_agg(strftime(ds, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY ds) AS hours, "
            f"count(*) AS n FROM bydim_b WHERE metric = 'visitors' AND dim = {text(dim)} GROUP BY tenant, contributors")


@query("contributors_outer", f"""
SELECT coalesce(x.tenant, y.tenant) AS tenant, coalesce(x.contributors, y.contributors) AS contributors,
  x.hours AS hours_x, y.hours AS hours_y, coalesce(x.n, 0) * coalesce(y.n, 0) AS matches
FROM ({_side('device')}) x FULL JOIN ({_side('geo')}) y
ON x.tenant = y.tenant AND coalesce(x.contributors, '') = coalesce(y.contributors, '')""")
def contributors_outer(spark, sf_dir):
    rows = browser(spark, sf_dir).by_dim.where(F.col("metric") == "visitors")
    both = C.contributors_outer(rows.where(F.col("dim") == "device"), rows.where(F.col("dim") == "geo"))

    def stamps(column: str):
        return joined(F.transform(column, lambda t: F.substring(t.cast("string"), 1, 19)))

    return both.select("tenant", joined("contributors").alias("contributors"),
                       stamps("hours_x").alias("hours_x"), stamps("hours_y").alias("hours_y"), "matches")


# --- hour report -----------------------------------------------------------------------------

@query("hour_events", """
SELECT tenant, ds AS hour, string_agg(CASE WHEN anomaly = 1 THEN metric END, ',' ORDER BY metric_ord) AS event_names
FROM hr_b GROUP BY ALL""")
def hour_events(spark, sf_dir):
    return browser(spark, sf_dir).hours.withColumn("event_names", joined("event_names"))


def _report_columns(metrics) -> str:
    return ", ".join(
        f"max(CASE WHEN metric = {text(m)} THEN {c} END) AS {m}_{out}"
        for m in metrics
        for c, out in (("anomaly", "anomaly"), ("percent_diff", "percent_diff"), ("contributors", "contributors")))


def _flat_contributors(df: DataFrame, metrics) -> DataFrame:
    return df.withColumns({f"{m}_contributors": joined(f"{m}_contributors") for m in metrics})


REPORT = f"""SELECT tenant, ds AS hour, {_report_columns(B_METRICS)}, max(anomaly) AS has_anomaly
FROM hr_b GROUP BY ALL"""


@query("anomaly_report", REPORT)
def anomaly_report(spark, sf_dir):
    return _flat_contributors(R.wide_report(browser(spark, sf_dir).hour_report, B_METRICS), B_METRICS)


WINDOW = ("2024-01-08 00:00:00", "2024-01-22 00:00:00")


@query("anomaly_report_window", REPORT, keyed=KEYED.rstrip() + f"""
WHERE ts >= TIMESTAMP {text(WINDOW[0])} AND ts < TIMESTAMP {text(WINDOW[1])}""", spine_b=f"""
SELECT tenant, unnest(generate_series(TIMESTAMP {text(WINDOW[0])}, TIMESTAMP {text(WINDOW[1])} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ds
FROM scored_b GROUP BY tenant""")
def anomaly_report_window(spark, sf_dir):
    """The hour report of two weeks, as if there were no other events."""
    a = Analysis(T.browser_events(spark, sf_dir), BROWSER, T.work(spark), start=WINDOW[0], end=WINDOW[1])
    return _flat_contributors(R.wide_report(a.hour_report, B_METRICS), B_METRICS)


@query("any_metric_anomaly", f"""
SELECT * FROM ({REPORT}) WHERE visitors_anomaly = 1 OR orders_anomaly = 1 OR buyers_anomaly = 1""")
def any_metric_anomaly(spark, sf_dir):
    return any_flag(anomaly_report(spark, sf_dir), ["visitors_anomaly", "orders_anomaly", "buyers_anomaly"])


@query("second_tracker_report", f"""
SELECT tenant, ds AS hour, {_report_columns(S_METRICS)}, max(anomaly) AS has_anomaly FROM hr_s GROUP BY ALL""")
def second_tracker_report(spark, sf_dir):
    return _flat_contributors(R.wide_report(second(spark, sf_dir).hour_report, S_METRICS), S_METRICS)


MEMBER_COLUMNS = ", ".join(
    f"max(CASE WHEN metric = {text(r['metric'])} AND dim = {text(r['dim'])} AND member = {text(r['member'])} "
    f"THEN percent_diff END) AS \"{r['metric']}_{r['dim']}_{r['member']}_percent_diff\""
    for r in BROWSER.member_rows(totals=False))


@query("anomaly_report_dims", f"SELECT tenant, ds AS hour, {MEMBER_COLUMNS} FROM mr_b GROUP BY ALL")
def anomaly_report_dims(spark, sf_dir):
    a = browser(spark, sf_dir)
    return R.wide_member_report(a.member_report, a.member_rows)


@query("anomaly_sign", "SELECT tenant, ds, sign FROM signed_b")
def anomaly_sign(spark, sf_dir):
    return browser(spark, sf_dir).signed


@query("top_event_per_hour", "SELECT * FROM topevent_b")
def top_event_per_hour(spark, sf_dir):
    return browser(spark, sf_dir).top.withColumn("contributors", joined("contributors"))


METRIC_SUMMARY = """
SELECT c.tenant, c.metric, c.anomalies, n.member AS top_contributor, n.n AS occurrences
FROM (SELECT tenant, metric, CAST(sum(anomaly) AS BIGINT) AS anomalies FROM hr_b WHERE anomaly = 1 GROUP BY ALL) c
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY tenant, metric ORDER BY n DESC, member) AS rn
  FROM (SELECT tenant, metric, member, count(*) AS n FROM cname_b GROUP BY ALL)) n
ON n.tenant = c.tenant AND n.metric = c.metric AND n.rn = 1"""


@query("metric_summary", METRIC_SUMMARY)
def metric_summary(spark, sf_dir):
    a = browser(spark, sf_dir)
    return R.metric_summary(a.hours, a.contributors, a.metric_names)


@query("second_tracker_metric_summary", on_second(METRIC_SUMMARY))
def second_tracker_metric_summary(spark, sf_dir):
    a = second(spark, sf_dir)
    return R.metric_summary(a.hours, a.contributors, a.metric_names)


def _merged(metric: str, profile=BROWSER) -> str:
    here = f"metric = {text(metric)}"
    columns = [f"max(CASE WHEN {here} AND dim = 'total' THEN {c} END) AS {metric}_{o}"
               for c, o in (("is_anomaly", "anomaly"), ("y", "value"), ("percent_diff", "percent_diff"))]
    columns += [f"max(CASE WHEN {here} AND dim = {text(r['dim'])} AND member = {text(r['member'])} "
                f"THEN percent_diff END) AS \"{metric}_{r['dim']}_{r['member']}_contribution\""
                for r in profile.member_rows(totals=False) if r["metric"] == metric]
    return ", ".join(columns)


MERGED = ("visitors", "orders", "buyers")


def _merged_sql(t: str, profile) -> str:
    return f"""
SELECT *, hour(ds) AS time_hour FROM (
  SELECT tenant, ds, {', '.join(_merged(m, profile) for m in MERGED)},
    string_agg(CASE WHEN dim = 'total' AND is_anomaly = 1 THEN metric || ' %diff: ' || coalesce(
      printf('%.1f%%', round(percent_diff * 100, 1)), 'n/a') END, ', '
      ORDER BY CASE metric WHEN 'visitors' THEN 0 WHEN 'orders' THEN 1 ELSE 2 END) AS anomalous_metrics
  FROM scored_{t} WHERE metric IN ('visitors', 'orders', 'buyers') GROUP BY tenant, ds)
WHERE visitors_anomaly IS NOT NULL"""


def _merged_wide(a: Analysis) -> DataFrame:
    wide = R.merged_wide(a.scored, a.member_rows, MERGED)
    return wide.withColumn("anomalous_metrics", joined("anomalous_metrics", ", "))


@query("merged_wide", _merged_sql("b", BROWSER))
def merged_wide(spark, sf_dir):
    return _merged_wide(browser(spark, sf_dir))


@query("second_tracker_merged", _merged_sql("s", SECOND))
def second_tracker_merged(spark, sf_dir):
    return _merged_wide(second(spark, sf_dir))


@query("hour_annotations", """
SELECT v.tenant, v.ds AS hour, t.metric, t.percent_diff AS change,
  CASE WHEN t.metric IS NOT NULL THEN CASE WHEN t.percent_diff > 0 THEN 'green' ELSE 'red' END END AS colour,
  'Time: ' || strftime(v.ds, '%Y-%m-%d %H:%M:%S') || ' | Visitors: ' || coalesce(CAST(v.y AS VARCHAR), 'N/A') ||
  CASE WHEN t.metric IS NULL THEN '' ELSE ' | Anomaly: ' || t.metric || ' (Overall Change: ' ||
    coalesce(printf('%+.1f%%', round(t.percent_diff * 100, 1)), 'N/A') || ') (Contributors: ' ||
    coalesce(n.names, 'N/A') || ')' END AS text
FROM (SELECT * FROM hr_b WHERE metric = 'visitors') v
LEFT JOIN topevent_b t ON t.tenant = v.tenant AND t.ds = v.ds
LEFT JOIN (SELECT tenant, metric, ds, string_agg(entry, ', ' ORDER BY entry) AS names FROM (
    SELECT tenant, metric, ds, member || ' (' || printf('%+.1f%%', round(v * 100, 1)) || ')' AS entry FROM name_b)
  GROUP BY ALL) n ON n.tenant = t.tenant AND n.metric = t.metric AND n.ds = t.ds""")
def hour_annotations(spark, sf_dir):
    a = browser(spark, sf_dir)
    return R.hour_annotations(a.hour_report, a.by_dim, a.scored)


# --- groups ----------------------------------------------------------------------------------

@query("anomaly_groups", "SELECT tenant, group_id, sign, ds FROM grouped_b")
def anomaly_groups(spark, sf_dir):
    return browser(spark, sf_dir).grouped


@query("group_duration", """
SELECT *, CAST(date_diff('hour', start_hour, end_hour) AS DOUBLE) AS duration_hours FROM gspan_b""")
def group_duration(spark, sf_dir):
    return G.group_duration(browser(spark, sf_dir).spans)


@query("anomaly_groups_stream", "SELECT tenant, sign, start_hour, end_hour, hours FROM gspan_b")
def anomaly_groups_stream(spark, sf_dir):
    """The groups of signed hours that arrive by time, as session windows; one far row closes the last ones."""
    a = browser(spark, sf_dir)
    signed = a.signed.select("tenant", "ds", "sign")
    closing = spark.createDataFrame([(None, "2999-01-01 00:00:00", 0)], "tenant string, ds string, sign int")
    work = T.work(spark)
    signed.withColumn("sign", F.col("sign").cast("int")).write.parquet(work.path("signed"))
    closing.withColumn("ds", F.col("ds").cast("timestamp_ntz")).write.mode("append").parquet(work.path("signed"))
    arriving = event_stream(spark, spark.read.parquet(work.path("signed")).schema, work.path("signed"))
    return drain(stream_groups(arriving), work.path("stream"))


@query("group_labels", """
SELECT *, strftime(start_hour, '%b %d %Y %H:%M') || ' - ' || strftime(end_hour, '%b %d %Y %H:%M') AS period
FROM sspan_b""")
def group_labels(spark, sf_dir):
    return G.group_labels(G.summary_spans(browser(spark, sf_dir).summary_rows))


@query("long_groups", "SELECT * FROM long_b")
def long_groups(spark, sf_dir):
    return G.long_groups(G.summary_spans(browser(spark, sf_dir).summary_rows))


@query("summary_groups", """
SELECT tenant, CAST(group_id AS BIGINT) AS group_id, positive, ds, metric, percent_diff, contributors FROM srow_b""")
def summary_groups(spark, sf_dir):
    return browser(spark, sf_dir).summary_rows.withColumn("contributors", joined("contributors"))


@query("root_cause", "SELECT * FROM cause_b")
def root_cause(spark, sf_dir):
    return G.root_cause(browser(spark, sf_dir).group_metrics)


def _group_report(t: str, metrics) -> str:
    columns = ", ".join(
        f"max(CASE WHEN m.metric = {text(m)} THEN {c} END) AS {m}_{out}" for m in metrics
        for c, out in (("m.anomalies", "anomaly"), ("m.percent_diff", "percent_diff"),
                       ("n.contributors", "contributors")))
    return f"""
SELECT g.tenant, g.group_id, g.sign, g.start_hour, g.end_hour, g.hours, c.root_cause, {columns}
FROM gspan_{t} g JOIN cause_{t} c ON c.tenant = g.tenant AND c.group_id = g.group_id
JOIN gmetric_{t} m ON m.tenant = g.tenant AND m.group_id = g.group_id
LEFT JOIN gname_{t} n ON n.tenant = m.tenant AND n.group_id = m.group_id AND n.metric = m.metric
GROUP BY g.tenant, g.group_id, g.sign, g.start_hour, g.end_hour, g.hours, c.root_cause"""


@query("group_report", _group_report("b", B_METRICS))
def group_report(spark, sf_dir):
    return _flat_contributors(browser(spark, sf_dir).group_report, B_METRICS)


@query("group_report_csv", f"""SELECT tenant, group_id, sign, start_hour, end_hour, root_cause, visitors_percent_diff,
  replace(visitors_contributors, ',', '|') AS visitors_contributors FROM ({_group_report("b", B_METRICS)})""")
def group_report_csv(spark, sf_dir):
    """The group report written as CSV and read back."""
    report = browser(spark, sf_dir).group_report.select(
        "tenant", "group_id", "sign", "start_hour", "end_hour", "root_cause", "visitors_percent_diff", "visitors_contributors")
    path = T.work(spark).path("group_report")
    write_report_csv(report, path)
    kinds = ", ".join(f"{n} {'string' if k.startswith('array') else k}" for n, k in report.dtypes)
    back = spark.read.schema(kinds).option("header", True).csv(path)
    return back.withColumn("visitors_contributors", F.when(F.col("visitors_contributors") != "", F.col("visitors_contributors")))


@query("second_tracker_groups", _group_report("s", S_METRICS))
def second_tracker_groups(spark, sf_dir):
    return _flat_contributors(second(spark, sf_dir).group_report, S_METRICS)


QUARTERS = """
SELECT tenant, time_bucket(INTERVAL 15 MINUTE, event_timestamp) AS time, count(*) AS n FROM ev_b GROUP BY ALL"""


def _quarters(spark, sf_dir) -> DataFrame:
    """Events per shop and quarter of an hour."""
    events = T.browser_events(spark, sf_dir).select(F.col(BROWSER.tenant).alias("tenant"), "event_timestamp")
    return events.groupBy("tenant", truncate(F.col("event_timestamp"), "15m").alias("time")).agg(F.count("*").alias("n"))


def _quarter_spans(a: Analysis) -> DataFrame:
    return a.spans.select("tenant", "group_id", F.col("start_hour").alias("first"), (F.col("end_hour") + F.expr("interval 45 minutes")).alias("last"))


@query("group_quarters", """
SELECT g.tenant, g.group_id, q.time, q.n FROM gspan_b g JOIN quarters_b q ON q.tenant = g.tenant
  AND q.time BETWEEN g.start_hour AND g.end_hour + INTERVAL 45 MINUTE""", quarters_b=QUARTERS)
def group_quarters(spark, sf_dir):
    """Quarters of an hour inside each group's span."""
    found = interval_join(_quarters(spark, sf_dir), _quarter_spans(browser(spark, sf_dir)), ["tenant"], "time", "first", "last")
    return found.select("tenant", "group_id", "time", "n")


@query("group_quarter_history", """
SELECT g.tenant, g.group_id, w.back, CAST(sum(q.n) AS BIGINT) AS events, count(*) AS quarters
FROM gspan_b g CROSS JOIN (VALUES (0), (1), (7)) AS w(back) JOIN quarters_b q ON q.tenant = g.tenant
  AND q.time BETWEEN g.start_hour - to_days(w.back) AND g.end_hour + INTERVAL 45 MINUTE - to_days(w.back)
GROUP BY ALL""", quarters_b=QUARTERS)
def group_quarter_history(spark, sf_dir):
    """Events of each group's span and of the same span a day and a week before, from quarters of an hour."""
    back = F.explode(F.array(*[F.lit(d) for d in (0, 1, 7)]))
    spans = _quarter_spans(browser(spark, sf_dir)).withColumn("back", back)
    shift = F.make_dt_interval(days=F.col("back"))
    spans = spans.withColumns({"first": F.col("first") - shift, "last": F.col("last") - shift})
    found = interval_join(_quarters(spark, sf_dir), spans, ["tenant"], "time", "first", "last")
    return found.groupBy("tenant", "group_id", "back").agg(F.sum("n").alias("events"), F.count("*").alias("quarters"))


GROUP_MEMBERS = f"""
SELECT g.tenant, g.group_id, r.metric, r.dim, r.member, coalesce({mean("r.percent_diff")}, 0) AS percent_diff
FROM grouped_b g JOIN mr_b r ON r.tenant = g.tenant AND r.ds = g.ds GROUP BY ALL"""


@query("group_report_dims", GROUP_MEMBERS)
def group_report_dims(spark, sf_dir):
    a = browser(spark, sf_dir)
    return G.group_members(a.grouped, a.member_report)


@query("group_report_wide", f"""
SELECT r.*, w.* EXCLUDE (tenant, group_id) FROM ({_group_report("b", B_METRICS)}) r
JOIN (SELECT tenant, group_id, {MEMBER_COLUMNS} FROM ({GROUP_MEMBERS}) GROUP BY ALL) w
ON w.tenant = r.tenant AND w.group_id = r.group_id""")
def group_report_wide(spark, sf_dir):
    return _flat_contributors(browser(spark, sf_dir).wide_group_report, B_METRICS)


@query("group_hours", "SELECT * FROM ghour_b")
def group_hours(spark, sf_dir):
    return browser(spark, sf_dir).group_hours.withColumn("contributors", joined("contributors"))


# --- scenarios, history, classification ------------------------------------------------------

@query("consistent_contributors", "SELECT * FROM consistent_b")
def consistent_contributors(spark, sf_dir):
    return S.consistent_contributors(browser(spark, sf_dir).group_hours)


@query("shared_contributors", "SELECT * FROM shared_b")
def shared_contributors(spark, sf_dir):
    return S.shared_contributors(S.consistent_contributors(browser(spark, sf_dir).group_hours))


def _cases(t: str) -> str:
    return f"""
SELECT tenant, group_id, scenario, start_hour, end_hour, sign, metrics,
  CASE WHEN scenario = 'A' THEN shared END AS shared_contributors,
  CASE WHEN scenario IN ('A', 'B') THEN by_metric END AS metric_contributors,
  CASE WHEN scenario = 'D' THEN first_names END AS contributors,
  CASE WHEN scenario = 'D' THEN single_hour END AS is_single_hour FROM case_{t}"""


def _flat_cases(cases: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("metric_contributors"), lambda e: F.concat(
        e["key"], F.lit(":"), F.array_join(e["value"], ",")))
    return cases.withColumns({
        "metrics": joined("metrics"),
        "shared_contributors": joined("shared_contributors"),
        "metric_contributors": joined(F.array_sort(entries), ";"),
        "contributors": joined("contributors"),
    })


@query("scenarios", _cases("b"))
def scenarios(spark, sf_dir):
    return _flat_cases(browser(spark, sf_dir).scenarios)


@query("second_tracker_scenarios", _cases("s"))
def second_tracker_scenarios(spark, sf_dir):
    return _flat_cases(second(spark, sf_dir).scenarios)


@query("scenarios_json", """
SELECT tenant, group_id, scenario, '{"start_hour":"' || strftime(start_hour, '%Y-%m-%dT%H:%M:%S') ||
  '","end_hour":"' || strftime(end_hour, '%Y-%m-%dT%H:%M:%S') || '","sign":"' || sign || '","metrics":["' ||
  replace(metrics, ',', '","') || '"]' ||
  CASE WHEN scenario = 'A' THEN ',"shared_contributors":["' || replace(shared, ',', '","') || '"]' ELSE '' END ||
  CASE WHEN scenario IN ('A', 'B') THEN ',"metric_contributors":{"' ||
    replace(replace(replace(by_metric, ',', '","'), ':', '":["'), ';', '"],"') || '"]}' ELSE '' END ||
  CASE WHEN scenario = 'D' THEN ',"contributors":[' ||
    coalesce('"' || replace(first_names, ',', '","') || '"', '') || '],"is_single_hour":' ||
    CASE WHEN single_hour THEN 'true' ELSE 'false' END ELSE '' END || '}' AS body
FROM case_b""")
def scenarios_json(spark, sf_dir):
    return S.scenarios_json(browser(spark, sf_dir).scenarios)


HISTORY = ("tenant, group_id, start_hour, end_hour, metric, dim, member, current_value, prev_day_value, "
           "prev_week_value, vs_prev_day, vs_prev_week, prev_day_change_pct, prev_week_change_pct")


@query("history_top_level", f"SELECT {HISTORY} FROM history_b WHERE dim = 'total'")
def history_top_level(spark, sf_dir):
    return browser(spark, sf_dir).history(top_level_only=True)


@query("history_dims", f"SELECT {HISTORY} FROM history_b WHERE dim <> 'total'")
def history_dims(spark, sf_dir):
    a = browser(spark, sf_dir)
    members = [r for r in a.member_rows if r["dim"] != "total"]
    return H.historical_changes(a.spans, B.below_top(a.scored), members)


@query("history_from_json", f"SELECT {HISTORY} FROM history_b")
def history_from_json(spark, sf_dir):
    return H.history_from_json(H.history_json(browser(spark, sf_dir).history()))


CLASSIFIED = ("tenant, group_id, start_hour, end_hour, classification, confidence_score, scenario_type, metrics, "
              "duration_hours")


@query("classification", f"SELECT {CLASSIFIED} FROM class_b")
def classification(spark, sf_dir):
    rows = browser(spark, sf_dir).classified.withColumn("metrics", joined("metrics"))
    return rows.select(*CLASSIFIED.split(", "))


def two(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(18,6)), 2) AS VARCHAR)"


@query("classification_reasons", f"""
SELECT tenant, group_id, 'Base score (Scenario ' || scenario_type || '): ' || {two('base_score')} ||
  CASE WHEN history_share IS NULL THEN '' ELSE '; Historical consistency: ' || {two('history_share')}
    || ' (contributes ' || {two('history_part')} || ')' END ||
  '; Metric count bonus: ' || {two('metrics_part')} ||
  '; Duration bonus: ' || {two('duration_part')} ||
  '; Total confidence score: ' || {two('confidence_score')} AS reasoning FROM class_b""")
def classification_reasons(spark, sf_dir):
    return K.reasons(browser(spark, sf_dir).classified).select(
        "tenant", "group_id", joined("reasoning", "; ").alias("reasoning"))


@query("classification_summary", f"""
SELECT count(*) AS total_anomalies, count(*) FILTER (WHERE classification = 'TP') AS tp_count,
  count(*) FILTER (WHERE classification = 'FP') AS fp_count,
  round(coalesce(count(*) FILTER (WHERE classification = 'TP') / nullif(count(*), 0), 0), 6) AS tp_share,
  coalesce({mean("CASE WHEN classification = 'TP' THEN confidence_score END")}, 0) AS tp_avg_confidence,
  coalesce({mean("CASE WHEN classification = 'FP' THEN confidence_score END")}, 0) AS fp_avg_confidence
FROM class_b""")
def classification_summary(spark, sf_dir):
    return K.classification_summary(browser(spark, sf_dir).classified)


@query("scenario_breakdown", """
SELECT tenant, scenario_type, count(*) FILTER (WHERE classification = 'TP') AS "TP",
  count(*) FILTER (WHERE classification = 'FP') AS "FP" FROM class_b GROUP BY ALL""")
def scenario_breakdown(spark, sf_dir):
    return K.scenario_breakdown(browser(spark, sf_dir).classified, by=["tenant"])


# --- summaries and patterns ------------------------------------------------------------------

SUMMARY_LINES = """
SELECT s.tenant, s.group_id, s.start_hour, s.end_hour, strftime(s.start_hour, '%b %d %Y %H:%M') || ' - ' ||
  strftime(s.end_hour, '%b %d %Y %H:%M') || ': ' || CASE WHEN s.positive THEN 'Positive ' ELSE 'Negative ' END ||
  p.parts AS line
FROM sspan_b s JOIN (
  SELECT c.tenant, c.group_id, string_agg(c.metric || ' (' || c.n || ')' || CASE WHEN k.contributors IS NULL THEN ''
      ELSE ': ' || replace(k.contributors, ',', ', ') END, '; ' ORDER BY m.priority, m.metric_ord) AS parts
  FROM (SELECT r.tenant, CAST(r.group_id AS BIGINT) AS group_id, r.metric, count(*) AS n, min(r.ds) AS first
    FROM srow_b r GROUP BY ALL) c
  JOIN sspan_b s ON s.tenant = c.tenant AND s.group_id = c.group_id
  JOIN mreg_b m ON m.metric = c.metric
  LEFT JOIN combined_b k ON k.tenant = c.tenant AND k.metric = c.metric AND k.ds = s.start_hour
  GROUP BY c.tenant, c.group_id) p ON p.tenant = s.tenant AND p.group_id = s.group_id"""


@query("summary_lines", SUMMARY_LINES)
def summary_lines(spark, sf_dir):
    return browser(spark, sf_dir).summary_lines


@query("second_tracker_summary", on_second(SUMMARY_LINES))
def second_tracker_summary(spark, sf_dir):
    return second(spark, sf_dir).summary_lines


@query("funnel_pattern", """
SELECT tenant, group_id, start_hour, end_hour, traffic_change, orders_change,
  CASE WHEN abs(traffic_change) < 0.1 AND abs(orders_change) > 0.1 THEN 'orders changed, traffic stable'
    WHEN traffic_change > 0.1 AND orders_change <= 0 THEN 'traffic up, orders flat or down'
    WHEN traffic_change > 0.1 AND orders_change > 0.1 THEN 'traffic and orders up'
    ELSE 'no intuitive pattern' END AS pattern
FROM (SELECT l.tenant, l.group_id, l.start_hour, l.end_hour, v.percent_diff AS traffic_change,
    o.percent_diff AS orders_change
  FROM long_b l
  LEFT JOIN top_b v ON v.tenant = l.tenant AND v.ds = l.start_hour AND v.metric = 'visitors'
  LEFT JOIN top_b o ON o.tenant = l.tenant AND o.ds = l.start_hour AND o.metric = 'orders'
  WHERE EXISTS (SELECT 1 FROM srow_b r WHERE r.tenant = l.tenant AND r.group_id = l.group_id AND r.metric = 'visitors')
    AND EXISTS (SELECT 1 FROM srow_b r WHERE r.tenant = l.tenant AND r.group_id = l.group_id AND r.metric = 'orders'))""")
def funnel_pattern(spark, sf_dir):
    a = browser(spark, sf_dir)
    return P.funnel_pattern(a.summary_rows, a.scored)


HIERARCHY = """
SELECT w.tenant, w.group_id, w.metric, w.start_hour, t.percent_diff AS top_change, c.moved_dims,
  CASE WHEN abs(t.percent_diff) > 0.1 AND c.any_moved THEN 'top level and members'
    WHEN abs(t.percent_diff) > 0.1 AND NOT c.any_moved THEN 'top level only'
    WHEN abs(t.percent_diff) <= 0.1 AND c.any_moved THEN 'members only' END AS pattern
FROM (SELECT DISTINCT l.tenant, l.group_id, l.start_hour, r.metric
  FROM long_b l JOIN srow_b r ON r.tenant = l.tenant AND r.group_id = l.group_id) w
LEFT JOIN top_b t ON t.tenant = w.tenant AND t.metric = w.metric AND t.ds = w.start_hour
LEFT JOIN (SELECT tenant, metric, ds, bool_or(abs(v) > 0.1) AS any_moved,
    string_agg(DISTINCT CASE WHEN abs(v) > 0.1 THEN dim END, ',' ORDER BY CASE WHEN abs(v) > 0.1 THEN dim END) AS moved_dims
  FROM name_b GROUP BY tenant, metric, ds) c
ON c.tenant = w.tenant AND c.metric = w.metric AND c.ds = w.start_hour"""


def _hierarchy(a: Analysis) -> DataFrame:
    return P.hierarchy_pattern(a.summary_rows, a.scored, a.by_dim).withColumn("moved_dims", joined("moved_dims"))


@query("hierarchy_pattern", HIERARCHY)
def hierarchy_pattern(spark, sf_dir):
    return _hierarchy(browser(spark, sf_dir))


@query("second_tracker_patterns", on_second(HIERARCHY))
def second_tracker_patterns(spark, sf_dir):
    return _hierarchy(second(spark, sf_dir))
