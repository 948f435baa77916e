"""Common table expressions of the SQL counterparts, one set per tracker.

``sql(text)`` puts in front of ``text`` exactly the expressions that it names, directly or
through others.
"""

from __future__ import annotations

import re

from catalog import tables as T
from tidemark.functions import dimensions as D
from tidemark.plans.profiles import Profile, browser_profile, second_tracker_profile

BROWSER = browser_profile(T.GLOBAL_SHOP)
SECOND = second_tracker_profile()


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def pick(number: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {cases} END"


def mean(value: str, times: int = 1) -> str:
    """Mean of values with six places, times a factor, to six places: exact up to the division."""
    return f"round(sum(CAST(round(({value}) * 1e6) AS BIGINT)) * {times} / nullif(count({value}), 0)) / 1e6"


def first_match(column: str, rules, default: str = "Other") -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, {text(p)}) THEN {text(m)}" for p, m in rules)
    return f"CASE {cases} ELSE {text(default)} END"


KEYED = """
SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
  CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS visitor_day,
  user_id // 4 AS agent
FROM events"""

EVENT_NAME = "CASE event_type " + " ".join(
    f"WHEN {text(a)} THEN {text(b)}" for a, b in T.EVENT_NAMES.items()) + " END"

BROWSER_VIEW = f"""
SELECT 'customer_event' AS event_type, {EVENT_NAME} AS event_name, ts AS event_timestamp,
  CASE WHEN k < 50 THEN {text(T.GLOBAL_SHOP)} ELSE 'us.shop.example' END AS shop,
  'https://shop.example/p/' || k AS page_url,
  {pick('agent', T.AGENTS)} AS user_agent,
  visitor_day AS session_id, 'tenant_' || (user_id % 4) AS client_id,
  CAST(event_id AS VARCHAR) AS event_details_id, visitor_day AS event_details_clientid,
  CASE k % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
    WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+00:00' END AS processed_timestamp,
  value AS price_amount, 'GBP' AS price_currency,
  CASE WHEN agent % 6 < 2 THEN 'mobile' ELSE 'desktop' END AS device_type,
  CASE WHEN agent % 6 = 0 THEN 'Safari' ELSE 'Chrome' END AS browser,
  {pick('agent', T.SYSTEMS)} AS os,
  {pick('k', T.SOURCES)} AS utm_source, {pick('k', T.MEDIUMS)} AS utm_medium,
  'campaign_' || (k % 3) AS utm_campaign
FROM keyed"""

BROWSER_EVENTS = f"""
SELECT *, client_id AS tenant, event_details_clientid AS visitor, session_id AS session,
  CASE WHEN shop = {text(T.GLOBAL_SHOP)} THEN 'Global' ELSE 'US' END AS geo,
  {first_match('user_agent', D.DEVICE_RULES)} AS device
FROM view_b"""

SECOND_VIEW = f"""
SELECT 'tenant_' || (user_id % 4) AS client_id, visitor_day AS session_id, ts AS event_datetime,
  CASE WHEN event_type = 'click' AND k % 10 = 0 THEN 'Login'
    WHEN event_type = 'click' AND k % 10 = 1 THEN 'Search'
    WHEN event_type = 'click' AND k % 10 = 2 THEN 'emailSubscribe'
    WHEN event_type = 'click' THEN 'PageView'
    WHEN event_type = 'view' THEN 'ViewContent'
    WHEN event_type = 'signup' THEN 'AddToCart'
    WHEN event_type = 'error' THEN 'InitiateCheckout' ELSE 'Purchase' END AS event_name,
  CASE WHEN agent % 6 < 2 THEN 'mobile' ELSE 'desktop' END AS device_platform,
  CASE WHEN agent % 6 = 0 THEN 'Safari' ELSE 'Chrome' END AS browser_name,
  {pick('agent', T.SYSTEMS)} AS os_name, {pick('k', T.COUNTRIES)} AS country_name,
  {pick('k', T.SOURCES)} AS search_utm_source, {pick('k', T.MEDIUMS)} AS search_utm_medium,
  'content_' || (k % 2) AS search_utm_content, 'term_' || (k % 4) AS search_utm_term
FROM keyed"""

_COUNTRY = " ".join(f"WHEN country_name = {text(c)} THEN {text(m)}" for c, m in D.COUNTRY_MEMBERS.items())
SECOND_EVENTS = f"""
SELECT *, client_id AS tenant, session_id AS visitor, session_id AS session,
  event_datetime AS event_timestamp, search_utm_source AS utm_source, search_utm_medium AS utm_medium,
  CASE {_COUNTRY} WHEN country_name IS NOT NULL THEN 'Other' ELSE 'Unknown Location' END AS geo,
  os_name AS device
FROM view_s"""

CTES: dict[str, str] = {
    "keyed": KEYED,
    "view_b": BROWSER_VIEW,
    "view_s": SECOND_VIEW,
    "ev_b": BROWSER_EVENTS,
    "ev_s": SECOND_EVENTS,
}


def earliest(source: str, keys: str, keep: str, where: str = "TRUE") -> str:
    order = ", ".join(f"{c.strip()} NULLS FIRST" for c in keep.split(","))
    return f"""SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY {keys} ORDER BY event_timestamp, {order}) AS rn FROM {source} WHERE {where}) WHERE rn = 1"""


def population(profile: Profile, t: str) -> str:
    parts = []
    for m in profile.metrics:
        where = "TRUE" if m.event is None else f"event_name = {text(m.event)}"
        source = f"(SELECT * FROM ev_{t} WHERE {where})" if m.unique_by is None else \
            f"({earliest(f'ev_{t}', f'tenant, {m.unique_by}', 'geo, device', where)})"
        parts.append(f"SELECT tenant, {text(m.name)} AS metric, "
                     f"date_trunc('hour', event_timestamp) AS ds, geo, device FROM {source}")
    return " UNION ALL ".join(parts)


def values(rows: list[dict], columns) -> str:
    body = ", ".join("(" + ", ".join(
        text(r[c]) if isinstance(r[c], str) else ("CAST(NULL AS INTEGER)" if r[c] is None else str(r[c]))
        for c in columns) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def add_tracker(t: str, profile: Profile) -> None:
    landing = next(m for m in profile.metrics if m.session_dims)
    source_list = ", ".join(text(m) for m in profile.members["source"])
    medium_list = ", ".join(text(m) for m in profile.members["medium"])
    s = "PARTITION BY tenant, metric, dim, member"
    panel = "tenant, metric, dim"
    CTES.update({
        f"pop_{t}": population(profile, t),
        f"session_{t}": earliest(f"ev_{t}", "tenant, session", "utm_source, utm_medium"),
        f"utm_{t}": f"""
SELECT tenant, {text(landing.name)} AS metric, 'source' AS dim, utm_source AS member,
  date_trunc('hour', event_timestamp) AS ds FROM session_{t} WHERE utm_source IN ({source_list})
UNION ALL
SELECT tenant, {text(landing.name)}, 'medium', utm_medium,
  date_trunc('hour', event_timestamp) FROM session_{t} WHERE utm_medium IN ({medium_list})""",
        f"cube_{t}": f"""
SELECT tenant, metric, dim, member, ds, CAST(count(*) AS BIGINT) AS y FROM (
  SELECT tenant, metric, 'geo' AS dim, geo AS member, ds FROM pop_{t}
  UNION ALL SELECT tenant, metric, 'device', device, ds FROM pop_{t}
  UNION ALL SELECT tenant, metric, 'total', 'Total', ds FROM pop_{t} WHERE metric <> {text(landing.name)}
  UNION ALL SELECT tenant, metric, dim, member, ds FROM utm_{t}
  UNION ALL SELECT tenant, metric, 'total', 'Total', ds FROM utm_{t} WHERE dim = {text(landing.top_level_from)})
GROUP BY ALL""",
        f"reg_{t}": values(profile.member_rows(), ["metric", "dim", "member", "ord"]),
        f"mreg_{t}": values(profile.metric_rows(), ["metric", "metric_ord", "priority", "funnel_rank"]),
        f"series_{t}": f"""
SELECT p.tenant, p.metric, p.dim, r.member, r.ord, p.ds, coalesce(c.y, 0) AS y
FROM (SELECT DISTINCT tenant, metric, dim, ds FROM cube_{t}) p
JOIN reg_{t} r USING (metric, dim)
LEFT JOIN cube_{t} c ON c.tenant = p.tenant AND c.metric = p.metric AND c.dim = p.dim
  AND c.member = r.member AND c.ds = p.ds""",
        f"span_{t}": f"""
SELECT *, date_diff('hour', min(ds) OVER s, ds) AS x FROM series_{t} WINDOW s AS ({s})""",
        f"trend_{t}": f"""
SELECT *, coalesce(regr_slope(y, x) OVER s * x + regr_intercept(y, x) OVER s, avg(y) OVER s) AS trend
FROM span_{t} WINDOW s AS ({s})""",
        f"hod_{t}": f"SELECT *, avg(y - trend) OVER ({s}, hour(ds)) AS by_hour FROM trend_{t}",
        f"dow_{t}": f"""
SELECT *, trend + by_hour + avg(y - trend - by_hour) OVER ({s}, dayofweek(ds)) AS expected FROM hod_{t}""",
        f"spread_{t}": f"""
SELECT *, 1.28155 * coalesce(stddev_samp(y - expected) OVER ({s}), 0) AS spread FROM dow_{t}""",
        f"forecast_{t}": f"""
SELECT tenant, metric, dim, member, ord, ds, y, round(expected, 6) AS yhat,
  round(expected - spread, 6) AS yhat_lower, round(expected + spread, 6) AS yhat_upper FROM spread_{t}""",
        f"scored_{t}": f"""
SELECT *, CASE WHEN y >= yhat_lower AND y <= yhat_upper THEN 0 ELSE 1 END AS is_anomaly,
  round(abs(yhat - y), 6) AS diff, round((y * 1000000 - CAST(round(yhat * 1e6) AS BIGINT)) / nullif(y, 0)) / 1e6 AS percent_diff
FROM forecast_{t}""",
        f"top_{t}": f"SELECT * FROM scored_{t} WHERE dim = 'total'",
        f"vec_{t}": f"""
SELECT a.tenant, a.metric, r.dim, r.member, r.ord, a.ds, coalesce(m.percent_diff, 0) AS v
FROM top_{t} a JOIN reg_{t} r ON r.metric = a.metric AND r.dim <> 'total'
LEFT JOIN scored_{t} m ON m.tenant = a.tenant AND m.metric = a.metric AND m.dim = r.dim
  AND m.member = r.member AND m.ds = a.ds
WHERE a.is_anomaly = 1""",
        f"nn_{t}": f"""
SELECT p.tenant, p.metric, p.dim, p.ds, round(min(q.d), 6) AS distance
FROM (SELECT DISTINCT tenant, metric, dim, ds FROM vec_{t}) p
LEFT JOIN (
  SELECT a.tenant, a.metric, a.dim, a.ds, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d
  FROM vec_{t} a JOIN vec_{t} b ON a.tenant = b.tenant AND a.metric = b.metric AND a.dim = b.dim
    AND a.member = b.member AND a.ds <> b.ds
  GROUP BY a.tenant, a.metric, a.dim, a.ds, b.ds) q
ON p.tenant = q.tenant AND p.metric = q.metric AND p.dim = q.dim AND p.ds = q.ds
GROUP BY p.tenant, p.metric, p.dim, p.ds""",
        f"knee_{t}": f"""
SELECT *, round(CAST(i AS DOUBLE) / nullif(n - 1, 0) - (distance - low) / nullif(high - low, 0), 9) AS below
FROM (SELECT *, row_number() OVER (PARTITION BY {panel} ORDER BY distance, ds) - 1 AS i,
    count(*) OVER w AS n, min(distance) OVER w AS low, max(distance) OVER w AS high
  FROM nn_{t} WHERE distance IS NOT NULL WINDOW w AS (PARTITION BY {panel}))""",
        f"eps_{t}": f"""
SELECT {panel}, max(CASE WHEN rn = 1 AND high > low THEN distance END) AS eps
FROM (SELECT *, row_number() OVER (PARTITION BY {panel} ORDER BY below DESC, i) AS rn FROM knee_{t})
GROUP BY {panel}""",
        f"walk_{t}": f"""
SELECT *, CASE WHEN below <= coalesce(before, below) AND below <= coalesce(after, below) THEN 0.0::DOUBLE
    WHEN below >= coalesce(before, below) AND below >= coalesce(after, below)
      THEN round(below - 1.0::DOUBLE / (n - 1), 9) END AS mark,
  CASE WHEN below >= coalesce(before, below) AND below >= coalesce(after, below) THEN distance END AS peak
FROM (SELECT *, lag(below) OVER w AS before, lead(below) OVER w AS after FROM knee_{t} WHERE high > low
  WINDOW w AS (PARTITION BY {panel} ORDER BY i DESC))""",
        f"leps_{t}": f"""
SELECT p.tenant, p.metric, p.dim, k.eps FROM (SELECT DISTINCT {panel} FROM knee_{t}) p
LEFT JOIN (SELECT {panel}, arg_max(peak, i) AS eps FROM (
    SELECT {panel}, i, after, last_value(mark IGNORE NULLS) OVER w AS mark, last_value(peak IGNORE NULLS) OVER w AS peak
    FROM walk_{t} WINDOW w AS (PARTITION BY {panel} ORDER BY i DESC ROWS UNBOUNDED PRECEDING))
  WHERE peak IS NOT NULL AND after < mark GROUP BY {panel}) k
ON k.tenant = p.tenant AND k.metric = p.metric AND k.dim = p.dim""",
        f"cluster_{t}": f"""
SELECT *, sum(CASE WHEN round(size - before, 6) > eps * 0.5 THEN 1 ELSE 0 END) OVER (
  PARTITION BY {panel}, ds ORDER BY size, member ROWS UNBOUNDED PRECEDING) AS cluster
FROM (SELECT v.*, e.eps, abs(v) AS size,
    lag(abs(v)) OVER (PARTITION BY v.tenant, v.metric, v.dim, v.ds ORDER BY abs(v), v.member) AS before
  FROM vec_{t} v LEFT JOIN eps_{t} e ON e.tenant = v.tenant AND e.metric = v.metric AND e.dim = v.dim)""",
        f"name_{t}": f"""
SELECT {panel}, ds, member, v FROM (
  SELECT *, max(cluster) OVER (PARTITION BY {panel}, ds) AS topmost FROM cluster_{t})
WHERE topmost > 0 AND cluster = topmost""",
        f"bydim_{t}": f"""
SELECT p.tenant, p.metric, p.dim, p.ds, string_agg(n.member, ',' ORDER BY n.member) AS contributors
FROM (SELECT DISTINCT tenant, metric, dim, ds FROM vec_{t}) p
LEFT JOIN name_{t} n ON n.tenant = p.tenant AND n.metric = p.metric AND n.dim = p.dim AND n.ds = p.ds
GROUP BY p.tenant, p.metric, p.dim, p.ds""",
        f"cname_{t}": f"SELECT DISTINCT tenant, metric, ds, member FROM name_{t}",
        f"combined_{t}": f"""
SELECT p.tenant, p.metric, p.ds, string_agg(n.member, ',' ORDER BY n.member) AS contributors
FROM (SELECT DISTINCT tenant, metric, ds FROM vec_{t}) p
LEFT JOIN cname_{t} n ON n.tenant = p.tenant AND n.metric = p.metric AND n.ds = p.ds
GROUP BY p.tenant, p.metric, p.ds""",
        f"spine_{t}": f"""
SELECT tenant, unnest(generate_series(min(ds), max(ds), INTERVAL 1 HOUR)) AS ds
FROM scored_{t} GROUP BY tenant""",
        f"hr_{t}": f"""
SELECT s.tenant, s.ds, m.metric, m.metric_ord, m.priority, m.funnel_rank, o.y,
  coalesce(o.is_anomaly, 0) AS anomaly,
  CASE WHEN o.is_anomaly IS NULL THEN 0 ELSE o.percent_diff END AS percent_diff,
  CASE WHEN o.is_anomaly = 1 THEN c.contributors END AS contributors
FROM spine_{t} s CROSS JOIN mreg_{t} m
LEFT JOIN top_{t} o ON o.tenant = s.tenant AND o.metric = m.metric AND o.ds = s.ds
LEFT JOIN combined_{t} c ON c.tenant = s.tenant AND c.metric = m.metric AND c.ds = s.ds""",
        f"mr_{t}": f"""
SELECT s.tenant, s.ds, r.metric, r.dim, r.member, r.ord,
  CASE WHEN o.yhat IS NULL THEN 0 ELSE o.percent_diff END AS percent_diff
FROM spine_{t} s CROSS JOIN (SELECT * FROM reg_{t} WHERE dim <> 'total') r
LEFT JOIN scored_{t} o ON o.tenant = s.tenant AND o.metric = r.metric AND o.dim = r.dim
  AND o.member = r.member AND o.ds = s.ds""",
        f"topevent_{t}": f"""
SELECT tenant, ds, metric, percent_diff, contributors FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant, ds ORDER BY priority, metric_ord) AS rn
  FROM hr_{t} WHERE anomaly = 1) WHERE rn = 1""",
        f"signed_{t}": f"""
SELECT h.tenant, h.ds, f.sign FROM (SELECT DISTINCT tenant, ds FROM hr_{t} WHERE anomaly = 1) h
JOIN (SELECT tenant, ds, CAST(sign(percent_diff) AS INTEGER) AS sign, row_number() OVER (
    PARTITION BY tenant, ds ORDER BY ord) AS rn FROM scored_{t} WHERE percent_diff <> 0) f
ON f.tenant = h.tenant AND f.ds = h.ds AND f.rn = 1""",
        f"grouped_{t}": f"""
SELECT tenant, dense_rank() OVER (PARTITION BY tenant ORDER BY start_hour) AS group_id, sign, ds
FROM (SELECT *, min(ds) OVER (PARTITION BY tenant, sign, island) AS start_hour
  FROM (SELECT *, sum(apart) OVER (PARTITION BY tenant, sign ORDER BY ds ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT *, CASE WHEN date_diff('hour', lag(ds) OVER (PARTITION BY tenant, sign ORDER BY ds), ds) > 3
      THEN 1 ELSE 0 END AS apart FROM signed_{t})))""",
        f"gspan_{t}": f"""
SELECT tenant, group_id, min(sign) AS sign, min(ds) AS start_hour, max(ds) AS end_hour,
  count(*) AS hours FROM grouped_{t} GROUP BY tenant, group_id""",
        f"gmetric_{t}": f"""
SELECT g.tenant, g.group_id, h.metric, h.metric_ord, h.priority, h.funnel_rank,
  CAST(sum(h.anomaly) AS BIGINT) AS anomalies, coalesce({mean("h.percent_diff")}, 0) AS percent_diff
FROM grouped_{t} g JOIN hr_{t} h ON h.tenant = g.tenant AND h.ds = g.ds GROUP BY ALL""",
        f"gname_{t}": f"""
SELECT tenant, group_id, metric, string_agg(member, ', ' ORDER BY member) AS names,
  string_agg(member, ',' ORDER BY member) AS contributors
FROM (SELECT DISTINCT g.tenant, g.group_id, n.metric, n.member
  FROM grouped_{t} g JOIN cname_{t} n ON n.tenant = g.tenant AND n.ds = g.ds)
GROUP BY tenant, group_id, metric""",
        f"main_{t}": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant, group_id
  ORDER BY anomalies DESC, priority, metric_ord) AS rn FROM gmetric_{t}) WHERE rn = 1""",
        f"origin_{t}": f"""
SELECT tenant, group_id, metric, above FROM (
  SELECT g.tenant, g.group_id, g.metric, row_number() OVER (PARTITION BY g.tenant, g.group_id
      ORDER BY g.anomalies DESC, g.funnel_rank) AS rn,
    sum(g.anomalies) OVER (PARTITION BY g.tenant, g.group_id) AS above
  FROM gmetric_{t} g JOIN main_{t} m ON m.tenant = g.tenant AND m.group_id = g.group_id
    AND g.funnel_rank < m.funnel_rank) WHERE rn = 1""",
        f"cause_{t}": f"""
SELECT c.tenant, c.group_id, c.main_metric,
  CASE WHEN c.funnel THEN 'Funnel effect from ' ELSE 'Direct anomaly in ' END || c.metric ||
  CASE WHEN n.names IS NULL THEN '' ELSE ' (' || n.names || ')' END AS root_cause
FROM (SELECT m.tenant, m.group_id, m.metric AS main_metric,
    coalesce(o.above >= m.anomalies * 0.5, FALSE) AS funnel,
    CASE WHEN coalesce(o.above >= m.anomalies * 0.5, FALSE) THEN o.metric ELSE m.metric END AS metric
  FROM main_{t} m LEFT JOIN origin_{t} o ON o.tenant = m.tenant AND o.group_id = m.group_id) c
LEFT JOIN gname_{t} n ON n.tenant = c.tenant AND n.group_id = c.group_id AND n.metric = c.metric""",
        f"ghour_{t}": f"""
SELECT g.tenant, g.group_id, e.ds, e.metric, e.contributors
FROM gspan_{t} g JOIN topevent_{t} e ON e.tenant = g.tenant AND e.ds BETWEEN g.start_hour AND g.end_hour""",
        f"consistent_{t}": f"""
SELECT c.tenant, c.group_id, c.metric, c.contributor, c.n, h.hours
FROM (SELECT g.tenant, g.group_id, g.metric, n.member AS contributor, count(*) AS n
  FROM ghour_{t} g JOIN cname_{t} n ON n.tenant = g.tenant AND n.metric = g.metric AND n.ds = g.ds
  GROUP BY ALL) c
JOIN (SELECT tenant, group_id, metric, count(*) AS hours FROM ghour_{t}
  WHERE contributors IS NOT NULL GROUP BY ALL) h
ON h.tenant = c.tenant AND h.group_id = c.group_id AND h.metric = c.metric
WHERE c.n >= h.hours * 0.5""",
        f"shared_{t}": f"""
SELECT tenant, group_id, contributor, count(metric) AS metrics FROM consistent_{t}
GROUP BY ALL HAVING count(metric) >= 2""",
        f"case_{t}": f"""
SELECT b.tenant, b.group_id,
  CASE WHEN single_hour OR n_metrics = 1 THEN 'D' WHEN NOT coalesce(has_names, FALSE) THEN 'C'
    WHEN shared IS NOT NULL THEN 'A' ELSE 'B' END AS scenario,
  b.start_hour, b.end_hour, CASE WHEN b.sign > 0 THEN 'Positive' ELSE 'Negative' END AS sign,
  b.metrics, b.n_metrics, s.shared, c.by_metric, f.first_names, b.single_hour
FROM (SELECT g.tenant, g.group_id, g.sign, g.start_hour, g.end_hour, g.start_hour = g.end_hour AS single_hour,
    m.metrics, m.n_metrics
  FROM gspan_{t} g JOIN (
    SELECT tenant, group_id, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics,
      count(DISTINCT metric) AS n_metrics FROM ghour_{t} GROUP BY ALL) m
  ON m.tenant = g.tenant AND m.group_id = g.group_id) b
LEFT JOIN (SELECT tenant, group_id, string_agg(contributor, ',' ORDER BY contributor) AS shared
  FROM shared_{t} GROUP BY ALL) s ON s.tenant = b.tenant AND s.group_id = b.group_id
LEFT JOIN (SELECT h.tenant, h.group_id, bool_or(n.names IS NOT NULL) AS has_names,
    string_agg(h.metric || ':' || coalesce(n.names, ''), ';' ORDER BY h.metric) AS by_metric
  FROM (SELECT DISTINCT tenant, group_id, metric FROM ghour_{t} WHERE contributors IS NOT NULL) h
  LEFT JOIN (SELECT tenant, group_id, metric, string_agg(contributor, ',' ORDER BY contributor) AS names
    FROM consistent_{t} GROUP BY ALL) n
  ON n.tenant = h.tenant AND n.group_id = h.group_id AND n.metric = h.metric GROUP BY h.tenant, h.group_id) c
ON c.tenant = b.tenant AND c.group_id = b.group_id
LEFT JOIN (SELECT tenant, group_id, contributors AS first_names FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant, group_id ORDER BY ds) AS rn
    FROM ghour_{t} WHERE contributors IS NOT NULL) WHERE rn = 1) f
ON f.tenant = b.tenant AND f.group_id = b.group_id""",
        f"past_{t}": f"""
SELECT g.tenant, g.group_id, r.metric, r.dim, r.member,
  {mean("CASE WHEN w.back = 0 THEN o.percent_diff END", 100)} AS current_value,
  {mean("CASE WHEN w.back = 1 THEN o.percent_diff END", 100)} AS prev_day_value,
  {mean("CASE WHEN w.back = 7 THEN o.percent_diff END", 100)} AS prev_week_value,
  count(CASE WHEN w.back = 0 THEN o.yhat END) AS current_rows,
  count(CASE WHEN w.back = 1 THEN o.yhat END) AS prev_day_rows,
  count(CASE WHEN w.back = 7 THEN o.yhat END) AS prev_week_rows,
  min(g.start_hour) AS start_hour, min(g.end_hour) AS end_hour
FROM gspan_{t} g CROSS JOIN reg_{t} r CROSS JOIN (VALUES (0), (1), (7)) AS w(back)
LEFT JOIN scored_{t} o ON o.tenant = g.tenant AND o.metric = r.metric AND o.dim = r.dim
  AND o.member = r.member AND o.ds >= g.start_hour - to_days(w.back) AND o.ds <= g.end_hour - to_days(w.back)
GROUP BY g.tenant, g.group_id, r.metric, r.dim, r.member""",
        f"change_{t}": f"""
SELECT *, round(current_value - prev_day_value, 6) AS prev_day_change_pct,
  round(current_value - prev_week_value, 6) AS prev_week_change_pct FROM past_{t}""",
        f"history_{t}": f"""
SELECT tenant, group_id, start_hour, end_hour, metric, dim, member, current_value, prev_day_value,
  prev_week_value, prev_day_change_pct, prev_week_change_pct,
  CASE WHEN prev_day_rows = 0 OR current_rows = 0 THEN 'No data'
    WHEN abs(prev_day_change_pct) > 10 THEN 'Significant' ELSE 'Similar' END AS vs_prev_day,
  CASE WHEN prev_week_rows = 0 OR current_rows = 0 THEN 'No data'
    WHEN abs(prev_week_change_pct) > 10 THEN 'Significant' ELSE 'Similar' END AS vs_prev_week
FROM change_{t}""",
        f"label_{t}": f"""
SELECT tenant, start_hour, count(*) * 2 AS comparisons,
  CAST(sum((vs_prev_day = 'Significant')::INTEGER + (vs_prev_week = 'Significant')::INTEGER) AS BIGINT) AS significant
FROM history_{t} WHERE dim = 'total' GROUP BY tenant, start_hour""",
        f"part_{t}": f"""
SELECT c.tenant, c.group_id, c.start_hour, c.end_hour, c.scenario AS scenario_type, c.metrics,
  CAST(date_diff('hour', c.start_hour, c.end_hour) AS DOUBLE) AS duration_hours,
  CASE c.scenario WHEN 'A' THEN 0.8::DOUBLE WHEN 'B' THEN 0.6::DOUBLE WHEN 'C' THEN 0.4::DOUBLE
    ELSE 0.3::DOUBLE END AS base_score,
  CAST(l.significant AS DOUBLE) / nullif(l.comparisons, 0) AS history_share,
  coalesce(CAST(l.significant AS DOUBLE) / nullif(l.comparisons, 0) * 0.4::DOUBLE, 0) AS history_part,
  least(CAST(c.n_metrics AS DOUBLE) / 5, 1) * 0.2::DOUBLE AS metrics_part,
  least(CAST(date_diff('hour', c.start_hour, c.end_hour) AS DOUBLE) / 24, 1) * 0.2::DOUBLE AS duration_part
FROM case_{t} c LEFT JOIN label_{t} l ON l.tenant = c.tenant AND l.start_hour = c.start_hour""",
        f"class_{t}": f"""
SELECT *, CASE WHEN confidence_score >= 0.5 THEN 'TP' ELSE 'FP' END AS classification
FROM (SELECT *, round(base_score + history_part + metrics_part + duration_part, 6) AS confidence_score
  FROM part_{t})""",
        f"srow_{t}": f"""
SELECT tenant, 1 + sum(breaks) OVER (PARTITION BY tenant ORDER BY ds ROWS UNBOUNDED PRECEDING) AS group_id,
  positive, ds, metric, percent_diff, contributors
FROM (SELECT *, CASE WHEN date_diff('hour', lag(ds) OVER w, ds) > 3 OR lag(positive) OVER w <> positive
    THEN 1 ELSE 0 END AS breaks
  FROM (SELECT *, coalesce(percent_diff > 0, FALSE) AS positive FROM topevent_{t})
  WINDOW w AS (PARTITION BY tenant ORDER BY ds))""",
        f"sspan_{t}": f"""
SELECT tenant, CAST(group_id AS BIGINT) AS group_id, bool_or(positive) AS positive, min(ds) AS start_hour,
  max(ds) AS end_hour, count(*) AS hours FROM srow_{t} GROUP BY tenant, group_id""",
        f"long_{t}": f"SELECT * FROM sspan_{t} WHERE date_diff('hour', start_hour, end_hour) > 1",
    })


def _line_error(n: str, *sums: str) -> str:
    """Squared distances to the best line, from exact sums of x, y, xx, xy and yy."""
    x, y, xx, xy, yy = sums

    def whole(value: str) -> str:
        return f"CAST({value} AS DOUBLE)"

    across, both = whole(f"{n} * {xx} - {x} * {x}"), whole(f"{n} * {xy} - {x} * {y}")
    down = whole(f"{n} * {yy} - {y} * {y}")
    return f"(({down} - coalesce({both} * {both} / nullif({across}, 0), 0)) / {whole(n)})"


def add_breaks(t: str, rounds: int) -> None:
    """The baseline whose trend breaks, in ``rounds`` rounds: every candidate of every segment is priced."""
    s = "tenant, metric, dim, member"
    sums = {"n": "1", "x": "x", "y": "total", "xx": "x * x", "xy": "x * total", "yy": "total * total"}
    left, every = [f"l_{k}" for k in sums], [f"a_{k}" for k in sums]
    rest = [f"({a} - {b})" for a, b in zip(every, left)]
    CTES[f"seg0_{t}"] = f"""
SELECT *, date_diff('day', min(day) OVER w, day) AS x, count(*) OVER w AS days, 0 AS segment
FROM (SELECT {s}, CAST(ds AS DATE) AS day, sum(y) AS total FROM series_{t} GROUP BY ALL) WINDOW w AS (PARTITION BY {s})"""
    for i in range(rounds):
        CTES[f"runs{i}_{t}"] = f"""
SELECT *, {', '.join(f"CAST(sum({v}) OVER r AS HUGEINT) AS l_{k}, CAST(sum({v}) OVER g AS HUGEINT) AS a_{k}" for k, v in sums.items())}
FROM seg{i}_{t} WINDOW r AS (PARTITION BY {s}, segment ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY {s}, segment)"""
        CTES[f"cost{i}_{t}"] = f"""
SELECT *, CASE WHEN l_n >= 3 AND a_n - l_n >= 3 THEN {_line_error(*left)} + {_line_error(*rest)} END AS after,
  {_line_error(*every)} AS before FROM runs{i}_{t}"""
        CTES[f"least{i}_{t}"] = f"SELECT *, min(after) OVER (PARTITION BY {s}, segment) AS best FROM cost{i}_{t}"
        CTES[f"seg{i + 1}_{t}"] = f"""
SELECT {s}, day, total, x, days, segment * 2 + CASE WHEN x > place
  AND before > best * pow(CAST(days AS DOUBLE), 3.0::DOUBLE / CAST(a_n AS DOUBLE)) THEN 1 ELSE 0 END AS segment
FROM (SELECT *, min(CASE WHEN after = best THEN x END) OVER (PARTITION BY {s}, segment) AS place FROM least{i}_{t})"""
    CTES.update({
        f"btrend_{t}": f"""
SELECT p.*, coalesce(regr_slope(p.y, p.x) OVER g * p.x + regr_intercept(p.y, p.x) OVER g, avg(p.y) OVER g) AS trend
FROM span_{t} p JOIN seg{rounds}_{t} d ON d.tenant = p.tenant AND d.metric = p.metric AND d.dim = p.dim
  AND d.member = p.member AND d.day = CAST(p.ds AS DATE)
WINDOW g AS (PARTITION BY p.tenant, p.metric, p.dim, p.member, d.segment)""",
        f"bhod_{t}": f"SELECT *, avg(y - trend) OVER (PARTITION BY {s}, hour(ds)) AS by_hour FROM btrend_{t}",
        f"bdow_{t}": f"""
SELECT *, trend + by_hour + avg(y - trend - by_hour) OVER (PARTITION BY {s}, dayofweek(ds)) AS expected FROM bhod_{t}""",
        f"bspread_{t}": f"""
SELECT *, 1.28155 * coalesce(stddev_samp(y - expected) OVER (PARTITION BY {s}), 0) AS spread FROM bdow_{t}""",
        f"bforecast_{t}": f"""
SELECT tenant, metric, dim, member, ds, y, round(expected, 6) AS yhat,
  round(expected - spread, 6) AS yhat_lower, round(expected + spread, 6) AS yhat_upper FROM bspread_{t}""",
    })


add_tracker("b", BROWSER)
add_tracker("s", SECOND)
add_breaks("b", 2)


def sql(body: str, **more: str) -> str:
    """``WITH`` every expression that ``body`` needs."""
    known = {**CTES, **more}
    name = re.compile(r"\b(?:" + "|".join(sorted(known, key=len, reverse=True)) + r")\b")
    ordered: list[str] = []

    def need(fragment: str) -> None:
        for found in dict.fromkeys(name.findall(fragment)):
            if found not in ordered:
                need(known[found])
                if found not in ordered:
                    ordered.append(found)

    need(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in ordered)
    return f"WITH {ctes}\n{body.strip()}"
