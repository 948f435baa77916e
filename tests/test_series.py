"""Baseline, flags, weights, distances and clusters on worked cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.plans.profiles import second_tracker_profile
from tidemark.operators import contributors as C
from tidemark.operators.forecast import per_series

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 1)
SERIES = "tenant string, metric string, dim string, member string, ds timestamp_ntz, y bigint"
FORECAST = ("tenant string, metric string, dim string, member string, ds timestamp_ntz, y bigint, "
            "yhat double, yhat_lower double, yhat_upper double")


def scored_row(spark, y, yhat=4.0, low=3.0, high=5.0):
    df = spark.createDataFrame([("t", "m", "total", "Total", START, y, yhat, low, high)], FORECAST)
    return B.score(df).first()


def test_zero_count(spark):
    row = scored_row(spark, 0)
    assert (row.diff, row.percent_diff, row.is_anomaly) == (4.0, None, 1)


def test_missing_count_is_flagged(spark):
    assert scored_row(spark, None).is_anomaly == 1


def test_border_is_inside(spark):
    assert scored_row(spark, 5).is_anomaly == 0


def test_division_rounds_half_up_on_decimals(spark):
    assert scored_row(spark, 2, yhat=2.007269).percent_diff == -0.003635


def test_single_point_and_constant_series_have_no_flag(spark):
    rows = [("t", "m", "total", "one", START, 7)]
    rows += [("t", "m", "total", "flat", START + i * HOUR, 3) for i in range(50)]
    out = B.score(B.seasonal_baseline(spark.createDataFrame(rows, SERIES)))
    assert out.where("is_anomaly = 1").count() == 0


def test_weight_is_distance_to_nearest_bound_in_reach(spark):
    rows = [
        ("t", "m", "total", "Total", START, 20, 5.0, 4.0, 6.0),
        ("t", "m", "total", "Total", START + 8 * HOUR, 12, 10.0, 9.0, 15.0),
        ("t", "m", "total", "Total", START + 9 * HOUR, 18, 18.0, 17.0, 19.0),
    ]
    out = B.anomaly_weight(B.score(spark.createDataFrame(rows, FORECAST))).orderBy("ds").collect()
    assert [r.anomaly_weight for r in out] == [5.0, 0.0, 0.0]


def test_baseline_matches_numpy(spark):
    rng = random.Random(3)
    ys = [rng.randrange(20) for _ in range(24 * 16)]
    rows = [("t", "m", "total", "Total", START + i * HOUR, y) for i, y in enumerate(ys)]
    got = B.seasonal_baseline(spark.createDataFrame(rows, SERIES)).orderBy("ds").collect()
    y, x = np.array(ys, float), np.arange(len(ys))
    slope, intercept = np.polyfit(x, y, 1)
    rest = y - (slope * x + intercept)
    by_hour = np.array([rest[x % 24 == h].mean() for h in range(24)])[x % 24]
    day = (x // 24) % 7
    by_day = np.array([(rest - by_hour)[day == d].mean() for d in range(7)])[day]
    expected = slope * x + intercept + by_hour + by_day
    spread = 1.28155 * (y - expected).std(ddof=1)
    assert np.allclose([r.yhat for r in got], expected, atol=1e-5)
    assert np.allclose([r.yhat_upper for r in got], expected + spread, atol=1e-5)


def test_weekday_term_is_a_setting(spark):
    """It does not depend on the length of the series."""
    ys = [1, 5, 2, 8, 3, 9, 4, 7, 6, 2] * 6
    rows = [("t", "m", "total", "Total", START + i * HOUR, y) for i, y in enumerate(ys)]
    frame = spark.createDataFrame(rows, SERIES)
    with_term, without = ([r.yhat for r in B.seasonal_baseline(frame, weekday=w).orderBy("ds").collect()] for w in (True, False))
    y, x = np.array(ys, float), np.arange(len(ys))
    trend = np.polyval(np.polyfit(x, y, 1), x)
    plain = trend + np.array([(y - trend)[x % 24 == h].mean() for h in range(24)])[x % 24]
    day = np.array([(START + int(i) * HOUR).weekday() for i in x])
    term = np.array([(y - plain)[day == d].mean() if (day == d).any() else 0 for d in range(7)])[day]
    assert np.allclose(without, plain, atol=1e-5) and np.allclose(with_term, plain + term, atol=1e-5)


def test_orders_of_the_second_tracker_have_their_own_devices():
    rows = second_tracker_profile().member_rows()
    devices = {m: [r["member"] for r in rows if r["metric"] == m and r["dim"] == "device"] for m in ("orders", "buyers")}
    assert len(devices["orders"]) == 7 and set(devices["buyers"]) - set(devices["orders"]) == {"Chromecast", "Ubuntu"}


def test_shares_add_up(spark):
    rows = [("t", "m", "device", d, START, y, yhat, 0.0, 9.0) for d, y, yhat in (("a", 5, 3.0), ("b", 1, 2.0))]
    rows.append(("t", "m", "total", "Total", START, 6, 5.0, 0.0, 9.0))
    out = B.contribution_share(B.score(spark.createDataFrame(rows, FORECAST)), "device")
    assert out.agg(F.sum("share")).first()[0] == pytest.approx(1.0, abs=1e-5)


@pytest.mark.parametrize("count,width", [(1, 2), (2, 3), (60, 1), (200, 5)])
def test_nearest_against_all_pairs(count, width):
    points = np.random.default_rng(count).integers(0, 30, (count, width)) / 10
    got = C._nearest(points)
    for i, p in enumerate(points):
        others = np.delete(points, i, axis=0)
        want = np.sqrt(((others - p) ** 2).sum(axis=1)).min() if len(others) else np.inf
        assert got[i] == pytest.approx(want)


VECTORS = ("tenant string, metric string, dim string, ds timestamp_ntz, "
           "values array<struct<ord:int,member:string,value:double>>")


def contributors(spark, values, eps):
    row = ("t", "m", "d", START, [(i, m, float(v)) for i, (m, v) in enumerate(values.items())])
    vectors = spark.createDataFrame([row], VECTORS)
    knee = spark.createDataFrame([("t", "m", "d", eps)], "tenant string, metric string, dim string, eps double")
    return C.max_contributors(vectors, knee).first().contributors


@pytest.mark.parametrize("values,eps,want", [
    ({"a": .90, "b": .85, "c": .10, "d": 0}, .4, ["a", "b"]),
    ({"a": .10, "b": .12}, .4, None),
    ({"a": -.9, "b": .9, "c": 0, "d": 0}, .4, ["a", "b"]),
    ({"a": .9, "b": .1}, None, None),
    ({"a": .9}, .4, None),
])
def test_topmost_cluster(spark, values, eps, want):
    assert contributors(spark, values, eps) == want


def test_topmost_cluster_against_single_linkage(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(200):
        values = {f"m{j}": rng.choice([-1, 1]) * rng.randrange(12) / 10 for j in range(rng.randint(1, 7))}
        rows.append(("t", "m", "d", START + i * HOUR, [(j, m, v) for j, (m, v) in enumerate(values.items())]))
        ranked = sorted(values, key=lambda m: abs(values[m]))
        clusters = [[ranked[0]]]
        for a, b in zip(ranked, ranked[1:]):
            if round(abs(values[b]) - abs(values[a]), 6) > 0.25:
                clusters.append([])
            clusters[-1].append(b)
        want[START + i * HOUR] = sorted(clusters[-1]) if len(clusters) > 1 else None
    knee = spark.createDataFrame([("t", "m", "d", 0.5)], "tenant string, metric string, dim string, eps double")
    got = C.max_contributors(spark.createDataFrame(rows, VECTORS), knee).collect()
    assert {r.ds: r.contributors for r in got} == want


def test_knee(spark):
    schema = "tenant string, metric string, dim string, ds timestamp_ntz, distance double"

    def eps(values):
        rows = [("t", "m", "d", START + i * HOUR, float(v)) for i, v in enumerate(values)]
        found = C.knee_eps(spark.createDataFrame(rows, schema)).first()
        return found and found.eps

    assert eps([0.1, 0.1, 0.2, 0.2, 5.0]) == 0.2
    assert eps([1, 1, 1, 1]) is None


def test_own_forecaster_per_series(spark):
    rows = [("t", "m", "total", "Total", START + i * HOUR, i) for i in range(5)]

    def flat(frame):
        return frame.assign(yhat=2.0, yhat_lower=1.0, yhat_upper=3.0)

    out = B.score(per_series(flat)(spark.createDataFrame(rows, SERIES))).orderBy("ds").collect()
    assert [r.is_anomaly for r in out] == [1, 0, 0, 0, 1]


def test_folded_outer_match(spark):
    schema = "tenant string, ds timestamp_ntz, contributors array<string>"
    left = spark.createDataFrame([("t", START, None), ("t", START + HOUR, None), ("t", START, ["a"])], schema)
    right = spark.createDataFrame([("t", START, None), ("t", START, ["b"])], schema)
    got = {tuple(r.contributors or ()): (len(r.hours_x), len(r.hours_y), r.matches)
           for r in C.contributors_outer(left, right).collect()}
    assert got == {(): (2, 1, 2), ("a",): (1, 0, 0), ("b",): (0, 1, 0)}
