"""Groups, root causes, scenarios, history and classes on worked cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify as K
from tidemark.operators import groups as G
from tidemark.operators import history as H
from tidemark.operators import patterns as P
from tidemark.operators import report as R
from tidemark.operators import scenarios as S
from tidemark.plans.profiles import BROWSER_METRICS

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 8)
INFO = {m.name: (i, m.priority, m.funnel_rank) for i, m in enumerate(m for m in BROWSER_METRICS if m.modelled)}


def at(hour):
    return START + hour * HOUR


def signed(spark, *hours):
    return spark.createDataFrame([("t", at(h), s) for h, s in hours], "tenant string, ds timestamp_ntz, sign int")


def group_sets(spark, *hours):
    rows = G.anomaly_groups(signed(spark, *hours)).collect()
    out = {}
    for r in rows:
        out.setdefault(r.group_id, []).append(int((r.ds - START) / HOUR))
    return [sorted(v) for _, v in sorted(out.items())]


def test_gap_border(spark):
    assert group_sets(spark, (0, 1), (3, 1), (7, 1)) == [[0, 3], [7]]


def test_signs_interleave(spark):
    assert group_sets(spark, (0, 1), (1, -1), (2, 1)) == [[0, 2], [1]]


def test_groups_partition_the_hours(spark):
    rng = random.Random(5)
    hours = [(h, rng.choice([-1, 1])) for h in sorted(rng.sample(range(400), 150))]
    groups = group_sets(spark, *hours)
    assert sorted(h for g in groups for h in g) == [h for h, _ in hours]
    sign = dict(hours)
    for g in groups:
        assert len({sign[h] for h in g}) == 1
        assert all(b - a <= 3 for a, b in zip(g, g[1:]))
    for s in (-1, 1):
        mine = sorted((g for g in groups if sign[g[0]] == s), key=lambda g: g[0])
        assert all(b[0] - a[-1] > 3 for a, b in zip(mine, mine[1:]))


def top_rows(spark, *rows):
    schema = "tenant string, ds timestamp_ntz, metric string, percent_diff double, contributors array<string>"
    return spark.createDataFrame([("t", at(h), m, p, c) for h, m, p, c in rows], schema)


def test_chronological_groups_break_on_direction(spark):
    top = top_rows(spark, (0, "visitors", .5, None), (1, "visitors", -.5, None), (2, "visitors", .5, None))
    assert G.summary_groups(top).select("group_id").distinct().count() == 3


def hour_report(spark, *rows):
    schema = ("tenant string, ds timestamp_ntz, metric string, metric_ord int, priority int, funnel_rank int, "
              "y bigint, anomaly int, percent_diff double, contributors array<string>")
    return spark.createDataFrame(
        [("t", at(h), m, *INFO[m], 1, flag, p, c) for h, m, flag, p, c in rows], schema)


def test_no_sign_means_no_group(spark):
    report = hour_report(spark, (0, "orders", 1, None, None), (1, "orders", 1, .2, None))
    scored = spark.createDataFrame(
        [("t", "orders", "total", "Total", at(0), None), ("t", "orders", "geo", "US", at(0), 0.0),
         ("t", "orders", "total", "Total", at(1), .2)],
        "tenant string, metric string, dim string, member string, ds timestamp_ntz, percent_diff double")
    members = spark.createDataFrame(
        [("orders", "total", "Total", 0), ("orders", "geo", "US", 1)], "metric string, dim string, member string, ord int")
    rows = R.hour_sign(scored, report, members).collect()
    assert [(r.ds, r.sign) for r in rows] == [(at(1), 1)]
    rows = R.hour_sign(scored, report, members, "top_metric").collect()
    assert [(r.ds, r.sign) for r in rows] == [(at(1), 1)]
    with pytest.raises(ValueError):
        R.hour_sign(scored, report, members, "loudest")


def cause(spark, **counts):
    schema = ("tenant string, group_id int, metric string, metric_ord int, priority int, funnel_rank int, "
              "anomalies bigint, percent_diff double, contributors array<string>")
    rows = [("t", 1, m, *INFO[m], n, 0.0, []) for m, n in counts.items()]
    return G.root_cause(spark.createDataFrame(rows, schema)).first()


def test_root_cause(spark):
    assert cause(spark, visitors=2, orders=2).main_metric == "visitors"
    assert cause(spark, orders=4, visitors=2).root_cause == "Funnel effect from visitors"
    assert cause(spark, orders=5, visitors=2).root_cause == "Direct anomaly in orders"
    assert cause(spark, product_viewers=3, visitors=3).root_cause == "Direct anomaly in visitors"
    assert cause(spark, product_viewers=4, visitors=3).root_cause == "Direct anomaly in product_viewers"


def scenario(spark, *rows):
    hours = [h for h, *_ in rows]
    spans = spark.createDataFrame(
        [("t", 1, 1, at(min(hours)), at(max(hours)))],
        "tenant string, group_id int, sign int, start_hour timestamp_ntz, end_hour timestamp_ntz")
    top = top_rows(spark, *[(h, m, .5, c) for h, m, c in rows])
    return S.scenarios(spans, S.group_hours(spans, top)).first()


def test_scenarios(spark):
    a = scenario(spark, (0, "visitors", ["iOS"]), (1, "orders", ["iOS", "US"]))
    assert (a.scenario, a.shared_contributors) == ("A", ["iOS"])
    b = scenario(spark, (0, "visitors", ["iOS"]), (1, "orders", ["Android"]))
    assert (b.scenario, b.metric_contributors) == ("B", {"visitors": ["iOS"], "orders": ["Android"]})
    assert scenario(spark, (0, "visitors", None), (1, "orders", None)).scenario == "C"
    d = scenario(spark, (0, "visitors", None), (1, "visitors", ["US"]), (2, "visitors", ["iOS"]))
    assert (d.scenario, d.contributors, d.is_single_hour) == ("D", ["US"], False)
    assert scenario(spark, (0, "visitors", ["iOS"])).is_single_hour is True


def test_consistency_counts_only_hours_with_contributors(spark):
    schema = "tenant string, group_id int, ds timestamp_ntz, metric string, contributors array<string>"
    rows = [("t", 1, at(i), "visitors", c) for i, c in enumerate([["a"], ["b"], None, None])]
    rows += [("t", 2, at(i), "visitors", c) for i, c in enumerate([["a"], ["b"], ["b"]])]
    got = S.consistent_contributors(spark.createDataFrame(rows, schema)).collect()
    assert {(r.group_id, r.contributor) for r in got} == {(1, "a"), (1, "b"), (2, "b")}


def classified(spark, scenario, metrics, hours, significant=None):
    cases = spark.createDataFrame(
        [("t", 1, scenario, at(0), at(hours), metrics)],
        "tenant string, group_id int, scenario string, start_hour timestamp_ntz, end_hour timestamp_ntz, "
        "metrics array<string>")
    labels = [] if significant is None else [
        ("t", at(0), "Significant" if i < significant else "Similar", "Similar") for i in range(7)]
    history = spark.createDataFrame(
        labels, "tenant string, start_hour timestamp_ntz, vs_prev_day string, vs_prev_week string")
    return K.reasons(K.classify(cases, history)).first()


def test_score_border(spark):
    row = classified(spark, "D", list("abcde"), 0, 0)
    assert (row.confidence_score, row.classification) == (0.5, "TP")


def test_score_without_history(spark):
    row = classified(spark, "C", ["a", "b"], 0)
    assert (row.confidence_score, row.classification) == (0.48, "FP")
    assert row.reasoning == ["Base score (Scenario C): 0.40", "Metric count bonus: 0.08",
                             "Duration bonus: 0.00", "Total confidence score: 0.48"]


def test_summary_counts(spark):
    rows = [("t", "TP", .9, "A"), ("t", "TP", .7, "D"), ("t", "FP", .3, "D")]
    df = spark.createDataFrame(rows, "tenant string, classification string, confidence_score double, scenario_type string")
    row = K.classification_summary(df).first()
    assert (row.total_anomalies, row.tp_count, row.tp_share, row.tp_avg_confidence) == (3, 2, 0.666667, 0.8)
    assert {r.scenario_type: (r.TP, r.FP) for r in K.scenario_breakdown(df).collect()} == {"A": (1, 0), "D": (1, 1)}
    empty = K.classification_summary(df.where("false")).first()
    assert (empty.total_anomalies, empty.tp_share) == (0, 0.0)


def changes(spark, values):
    spans = spark.createDataFrame(
        [("t", 1, at(0), at(1))], "tenant string, group_id int, start_hour timestamp_ntz, end_hour timestamp_ntz")
    scored = spark.createDataFrame(
        [("t", "m", "total", "Total", at(h), v) for h, v in values.items()],
        "tenant string, metric string, dim string, member string, ds timestamp_ntz, percent_diff double")
    row = {"metric": "m", "dim": "total", "member": "Total", "ord": 0}
    return H.historical_changes(spans, scored, [row]).first()


def test_history(spark):
    row = changes(spark, {0: .3, 1: .1, -24: .1, -23: .1})
    assert (row.current_value, row.prev_day_change_pct, row.vs_prev_day) == (20.0, 10.0, "Similar")
    assert (row.vs_prev_week, row.prev_week_value) == ("No data", None)
    row = changes(spark, {0: .3, -24: .1, -168: None})
    assert (row.vs_prev_day, row.vs_prev_week) == ("Significant", "Similar")
    assert changes(spark, {-24: .1}).vs_prev_day == "No data"


def test_history_survives_json(spark):
    flat = spark.createDataFrame(
        [("t", 1, at(0), at(1), "m", "total", "Total", 1.5, None, 2.0, "No data", "Similar", None, -.5)],
        "tenant string, group_id int, start_hour timestamp_ntz, end_hour timestamp_ntz, metric string, dim string, "
        "member string, current_value double, prev_day_value double, prev_week_value double, vs_prev_day string, "
        "vs_prev_week string, prev_day_change_pct double, prev_week_change_pct double")
    assert H.history_from_json(H.history_json(flat)).collect() == flat.collect()


def test_funnel_patterns(spark):
    top = top_rows(spark, (0, "visitors", .5, None), (1, "orders", .5, None), (2, "visitors", .5, None))
    rows = G.summary_groups(top)

    def pattern(traffic, orders):
        scored = spark.createDataFrame(
            [("t", "visitors", "total", "Total", at(0), traffic), ("t", "orders", "total", "Total", at(0), orders)],
            "tenant string, metric string, dim string, member string, ds timestamp_ntz, percent_diff double")
        return P.funnel_pattern(rows, scored).first().pattern

    assert pattern(.05, .2) == "orders changed, traffic stable"
    assert pattern(.3, -.2) == "traffic up, orders flat or down"
    assert pattern(.3, .2) == "traffic and orders up"
    assert pattern(None, .2) == "no intuitive pattern"


def test_metric_summary_breaks_ties_by_name(spark):
    hours = spark.createDataFrame([("t", at(0), ["visitors"]), ("t", at(1), ["visitors", "orders"])],
                                  "tenant string, hour timestamp_ntz, event_names array<string>")
    names = spark.createDataFrame([("t", "visitors", at(0), ["b"]), ("t", "visitors", at(1), ["a"])],
                                  "tenant string, metric string, ds timestamp_ntz, contributors array<string>")
    got = {r.metric: (r.anomalies, r.top_contributor, r.occurrences)
           for r in R.metric_summary(hours, names, ["visitors", "orders"]).collect()}
    assert got == {"visitors": (2, "a", 1), "orders": (1, None, None)}


def test_long_groups(spark):
    spans = spark.createDataFrame([(1, at(0), at(1)), (2, at(0), at(2))],
                                  "group_id int, start_hour timestamp_ntz, end_hour timestamp_ntz")
    assert [r.group_id for r in G.long_groups(spans).collect()] == [2]
    assert G.group_labels(spans).first().period == "Jan 08 2024 00:00 - Jan 08 2024 01:00"
    assert G.group_duration(spans.where(F.col("group_id") == 2)).first().duration_hours == 2.0
