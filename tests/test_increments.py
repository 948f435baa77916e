"""Streams with corrections, days kept apart, bitmaps, intervals, breaks, conditions: worked cases."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import tables as T
from catalog.sql import BROWSER
from tidemark.functions.conditions import condition
from tidemark.operators import baseline as B
from tidemark.operators import bitmaps as M
from tidemark.operators import contributors as C
from tidemark.operators import cube as Q
from tidemark.operators import dedup as U
from tidemark.operators import report as R
from tidemark.operators import scenarios as S
from tidemark.operators.intervals import interval_join
from tidemark.operators.trend import break_segments
from tidemark.plans.kpi_engine import kpi_wide
from tidemark.sources.config import load_config, parse_config, validate
from tidemark.sources.daily import DailyActivity
from tidemark.plans.default_config import default_config
from tidemark.streaming import hourly as H
from tidemark.streaming import keys as K

SF_DIR = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
EVENT = "k string, t timestamp_ntz, d string"


def same(a, b):
    a = a.select(*b.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def arrive(spark, folder, batches, schema=EVENT):
    """Files of the batches, read one at a time in their order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")
    frame = spark.createDataFrame([], schema)
    return frame.schema


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_stream_corrects_itself_in_any_order(spark, tmp_path, order):
    parts = [[("v", T0 + HOUR, "b"), ("w", T0, None), ("w", None, "x")], [("v", T0, "z"), ("v", T0, "a"), (None, T0, "n")],
             [("v", T0 + 5 * HOUR, "c"), ("w", T0, "x"), (None, T0 + HOUR, "n")]]
    changes = None
    for i in order:  # each run takes up where the last one stopped
        spark.createDataFrame(parts[i], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = H.event_stream(spark, spark.createDataFrame([], EVENT).schema, f"{tmp_path}/in")
        changes = K.drain(K.earliest_keys(stream, ["k"], ["d"], "t"), str(tmp_path))
    rows = spark.createDataFrame(sum(parts, []), EVENT)
    assert same(K.settled(changes), U.earliest_per_key(rows, ["k"], "t", ["d"]))
    hours = {(r.time, r.member): r.n for r in K.hourly_changes(changes, "d", "t").collect()}
    assert hours == {(T0, "a"): 1, (T0, None): 1, (T0, "n"): 1}
    corrections = changes.where("change < 0").count()
    assert changes.where("change > 0").count() == 3 + corrections
    assert corrections > 0 or order[0] == 1  # the second part holds the earliest rows of two keys


def test_stream_calls_python_by_bucket(spark, tmp_path):
    """Many keys of several types, null among them, in as many calls as there are buckets, and numbers kept whole."""
    big = 2 ** 53 + 1
    schema = "a long, b double, t timestamp_ntz, n long, d string"
    one = [(big + i if i % 7 else None, i % 3 - 1.0 if i % 5 else None, T0 + i % 11 * HOUR, big + i, None if i % 4 else "x") for i in range(300)]
    two = [(a, 0.0 if b == -1.0 else -0.0 if b == 0.0 else b, t - HOUR, None if n % 2 else n, "y") for a, b, t, n, _ in one[::2]]
    for rows in (one, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = H.event_stream(spark, spark.createDataFrame([], schema).schema, f"{tmp_path}/in")
        found = K.earliest_keys(stream, ["a", "b"], ["n", "d"], "t", buckets=3)
        changes = K.drain(found, str(tmp_path))
    assert "bucket_of_key" in found._jdf.queryExecution().analyzed().toString()
    got, want = K.settled(changes), U.earliest_per_key(spark.createDataFrame(one + two, schema), ["a", "b"], "t", ["n", "d"])
    assert got.select("a").distinct().count() > 200 and same(got, want)


def test_timer_is_of_a_key_not_of_its_bucket(spark, tmp_path):
    """One bucket: a key that is seen again is held on, another of the bucket is forgotten, the rest stays."""
    for rows in ([("v", T0, "a"), ("w", T0, "a"), ("u", T0 + 5 * HOUR, "a")], [("w", T0 + 6 * HOUR, "b"), ("x", T0 + 8 * HOUR, "b")],
                 [("y", T0 + 13 * HOUR, "b")], [(k, T0 + 14 * HOUR, "c") for k in "vwu"]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = H.event_stream(spark, spark.createDataFrame([], EVENT).schema, f"{tmp_path}/in")
        changes = K.drain(K.earliest_keys(stream, ["k"], ["d"], "t", delay="1 hour", hold_hours=10, buckets=1), str(tmp_path))
    seen = sorted((r.k, r.d, r.change) for r in changes.collect())
    assert seen == [("u", "a", 1), ("v", "a", 1), ("v", "c", 1), ("w", "a", 1), ("x", "b", 1), ("y", "b", 1)]


def test_timer_forgets_a_key(spark, tmp_path):
    stream = None
    for rows in ([("v", T0, "a")], [("x", T0 + 100 * HOUR, "b")], [("y", T0 + 101 * HOUR, "b")], [("v", T0 + 102 * HOUR, "c")]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = H.event_stream(spark, spark.createDataFrame([], EVENT).schema, f"{tmp_path}/in")
        changes = K.drain(K.earliest_keys(stream, ["k"], ["d"], "t", delay="1 hour", hold_hours=10), str(tmp_path))
    assert sorted(r.d for r in changes.where("k = 'v' AND change = 1").collect()) == ["a", "c"]
    with pytest.raises(ValueError, match="delay"):
        K.earliest_keys(stream, ["k"], ["d"], "t", hold_hours=1)


def test_days_are_replaced_by_load(spark, tmp_path):
    events = T.browser_events(spark, SF_DIR)
    day = F.dayofmonth("event_timestamp")
    kept = DailyActivity(spark, str(tmp_path / "days"), BROWSER)
    kept.add(events.where(day <= 3), "a")
    kept.add(events.where((day == 3) | (day == 4)), "b")
    kept.add(events.where(day == 2), "a")  # the load comes again without two of its days
    want = Q.activity(events.where((day == 2) | (day == 3) | (day == 4)), BROWSER)
    assert same(kept.read(), want)
    assert same(kept.read("2024-01-03", "2024-01-03"), Q.activity(events.where(day == 3), BROWSER))
    plan = kept.read("2024-01-03", "2024-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    with pytest.raises(ValueError, match="load name"):
        kept.add(events, "a/b")


@pytest.mark.parametrize("bucket", [4, 1 << 30])
def test_bitmaps_count_exactly(spark, monkeypatch, bucket):
    """Small buckets, and one bucket of more keys than a bitmap has bits."""
    monkeypatch.setattr(M, "BUCKET_KEYS", bucket)
    n = 200 if bucket == 4 else 70_000
    rows = spark.range(n).select(
        F.lit("t").alias("tenant"), F.concat(F.lit("v"), F.col("id") % (n - 50)).alias("visitor"), (F.col("id") % 3).alias("geo"),
        (F.col("id") % 2).alias("device")).union(spark.createDataFrame([("t", None, 0, 0), ("u", "v1", None, 1)], "tenant string, visitor string, geo long, device long"))
    sets = [("tenant", "geo"), ("tenant",), ("tenant", "geo", "device")]
    got = M.unique_levels(rows, "visitor", ["tenant", "geo", "device"], sets)
    for level, keys in enumerate(sets):
        want = rows.where("visitor IS NOT NULL").groupBy(*keys).agg(F.countDistinct("visitor").alias("n"))
        assert same(got.where(F.col("level") == level).select(*keys, "n"), want)


def test_bitmaps_take_no_more_than_their_keys(spark):
    """A cell of few keys is a few numbers, not a block of a fixed 4 KB, and aggregates hash."""
    rows = spark.range(2000).select(F.lit("t").alias("tenant"), F.col("id").alias("visitor"), (F.col("id") % 500).alias("geo"))
    cells = ["tenant", "geo"]
    numbered = M.numbered_keys(M.key_cells(rows, "visitor", cells), "visitor")
    bitmaps = M.cell_bitmaps(numbered, cells)
    assert bitmaps.schema["bits"].dataType.simpleString() == "bigint" and bitmaps.count() <= 2000
    assert bitmaps.agg(F.sum(F.bit_count("bits"))).first()[0] == 2000
    plan = M.unique_levels(rows, "visitor", cells, [("tenant",), ("tenant", "geo")])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "REPARTITION_BY_NUM" in plan  # else small buckets of many levels meet in a few tasks


def test_intervals_of_any_length(spark):
    points = [("a", T0 + dt.timedelta(minutes=15 * i), i) for i in range(400)] + [("b", T0, 0), (None, T0, 0), ("a", None, 0)]
    spans = [("a", 1, 0, 0), ("a", 2, 10, 10), ("a", 3, 7, 300), ("a", 4, 20, 10), ("b", 5, -50, 50), ("a", 6, 13, 14), (None, 7, 0, 9), ("a", 8, -9, 399)]
    at = lambda i: T0 + dt.timedelta(minutes=15 * i)
    left = spark.createDataFrame(points, "k string, t timestamp_ntz, i int")
    right = spark.createDataFrame([(k, g, at(a), at(b)) for k, g, a, b in spans] + [("a", 9, T0, None)], "k string, g int, first timestamp_ntz, last timestamp_ntz")
    got = sorted((r.g, r.i) for r in interval_join(left, right, ["k"], "t", "first", "last").collect())
    want = sorted((g, i) for k, g, a, b in spans for kk, t, i in points if k and k == kk and t and at(a) <= t <= at(b))
    assert got == want
    assert interval_join(left, right.limit(0), ["k"], "t", "first", "last").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        interval_join(left, right.withColumnRenamed("g", "i"), ["k"], "t", "first", "last")


def hourly(spark, values, series="s"):
    rows = [(series, "m", "d", "x", T0 + i * HOUR, int(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tenant string, metric string, dim string, member string, ds timestamp_ntz, y long")


def test_level_shift_breaks_the_trend(spark):
    shift = [10 + i % 24 for i in range(24 * 10)] + [60 + i % 24 for i in range(24 * 10)]
    level, steady = hourly(spark, shift), hourly(spark, [5 + i % 24 for i in range(24 * 20)], "steady")
    segments = break_segments(level.union(steady), B.SERIES, 2)
    ends = {(r.tenant, r.segment): (r.first, r.last) for r in segments.groupBy("tenant", "segment").agg(
        F.min("day").alias("first"), F.max("day").alias("last")).collect()}
    day = lambda i: (T0 + i * 24 * HOUR).date()
    assert sorted(v for k, v in ends.items() if k[0] == "s") == [(day(0), day(9)), (day(10), day(19))]
    assert [v for k, v in ends.items() if k[0] == "steady"] == [(day(0), day(19))]
    plain, broken = (B.score(B.seasonal_baseline(level, break_rounds=r)) for r in (0, 2))
    assert broken.agg(F.max("diff")).first()[0] < 1 < 5 < plain.agg(F.max("diff")).first()[0]


def test_short_series_do_not_break(spark):
    assert {r.segment for r in break_segments(hourly(spark, [1, 5, 9] * 30), B.SERIES, 3).collect()} == {0}
    one = B.seasonal_baseline(hourly(spark, [4]), break_rounds=2).first()
    assert (one.yhat, one.yhat_lower, one.yhat_upper) == (4.0, 4.0, 4.0)


def walked_knee(distances, sensitivity=1.0):
    """The walk of the local rule, one place after the other."""
    d = sorted(distances)
    n, low, high = len(d), d[0], d[-1]
    if high == low:
        return None
    depth = [round(i / (n - 1) - (d[i] - low) / (high - low), 9) for i in range(n)][::-1]
    mark, peak = 0.0, None
    for i, here in enumerate(depth[:-1]):
        sides = [depth[j] for j in (i - 1, i + 1) if 0 <= j < n]
        if all(here >= s for s in sides):
            mark, peak = round(here - sensitivity / (n - 1), 9), d[n - 1 - i]
        if all(here <= s for s in sides):
            mark = 0.0
        if peak is not None and depth[i + 1] < mark:
            return peak
    return None


@pytest.mark.parametrize("seed", range(6))
def test_local_knee(spark, seed):
    rng = np.random.default_rng(seed)
    n = [2, 3, 12, 40, 40, 80][seed]
    d = np.round(np.sort(rng.exponential(1, n) ** (1 + seed % 3)), 3).tolist()
    rows = [("t", "m", "d", T0 + i * HOUR, v) for i, v in enumerate(d)]
    frame = spark.createDataFrame(rows, "tenant string, metric string, dim string, ds timestamp_ntz, distance double")
    assert C.knee_eps(frame, "local").first().eps == walked_knee(d)
    with pytest.raises(ValueError, match="knee rule"):
        C.knee_eps(frame, "other")


def test_nearest_distances_with_ties_in_the_widest_coordinate():
    rng = np.random.default_rng(0)
    for n, d in ((1, 2), (2, 3), (700, 3), (500, 1)):
        x = np.round(rng.standard_normal((n, d)), 1)
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(far, np.inf)
        assert np.allclose(C._nearest(x), far.min(1))
    x = rng.standard_normal((50_000, 2))
    x[:, 0] = np.where(np.arange(50_000) % 3 == 0, 100.0, -100.0)
    some = C._nearest(x)[:200]
    far = np.abs(x[:200, None, 1] - x[None, :, 1]) + np.where(x[:200, None, 0] == x[None, :, 0], 0, np.inf)
    far[np.arange(200), np.arange(200)] = np.inf
    assert np.allclose(some, far.min(1))


@pytest.mark.parametrize("sample", [1, 50])
def test_large_panels_are_divided(spark, monkeypatch, sample):
    """The same distances whether a panel is searched whole or in cells, with ties and copies."""
    rng = np.random.default_rng(8)
    rows = []
    for tenant, n, d in (("t", 400, 3), ("u", 30, 2), ("v", 300, 1), ("w", 120, 2)):
        x = np.round(rng.standard_normal((n, d)), 2)
        x[: n // 2, 0] = 7.0
        if tenant == "w":
            x[:] = 1.0
        rows += [(tenant, "m", "d", T0 + i * HOUR, [{"ord": j, "member": str(j), "value": float(c)} for j, c in enumerate(p)]) for i, p in enumerate(x)]
    frame = spark.createDataFrame(rows, "tenant string, metric string, dim string, ds timestamp_ntz, values array<struct<ord:int,member:string,value:double>>")
    whole = C.nn_distance(frame).persist()
    assert whole.count() == len(rows)
    monkeypatch.setattr(C, "PANEL_ROWS", 100)
    monkeypatch.setattr(C, "CELL_ROWS", 40)
    monkeypatch.setattr(C, "SAMPLE_ROWS", sample)
    assert same(C.nn_distance(frame), whole)


def test_metrics_without_a_consistent_contributor_have_an_empty_list(spark):
    spans = spark.createDataFrame([("t", 1, 1, T0, T0 + 4 * HOUR), ("t", 2, 1, T0 + 9 * HOUR, T0 + 12 * HOUR)],
                                  "tenant string, group_id int, sign int, start_hour timestamp_ntz, end_hour timestamp_ntz")
    hours = [(1, 0, "visitors", ["iOS"]), (1, 1, "orders", ["US"]), (1, 2, "orders", ["Android"]), (1, 3, "orders", ["Windows"]), (1, 4, "buyers", None),
             (2, 9, "orders", ["a"]), (2, 10, "orders", ["b"]), (2, 11, "orders", ["c"]), (2, 12, "buyers", None)]
    rows = spark.createDataFrame([("t", g, T0 + h * HOUR, m, c) for g, h, m, c in hours],
                                 "tenant string, group_id int, ds timestamp_ntz, metric string, contributors array<string>")
    got = {r.group_id: (r.scenario, r.metric_contributors) for r in S.scenarios(spans, rows).collect()}
    assert got == {1: ("B", {"orders": [], "visitors": ["iOS"]}), 2: ("C", None)}


def test_spine_is_bounded(spark):
    rows = [("t", T0), ("t", T0 + 30 * HOUR), ("u", T0 + 5 * HOUR)]
    series = spark.createDataFrame(rows, "tenant string, ds timestamp_ntz")
    got = sorted((r.tenant, r.ds) for r in R.hour_spine(series).collect())
    assert got == [("t", T0 + i * HOUR) for i in range(31)] + [("u", T0 + 5 * HOUR)]
    late = series.union(spark.createDataFrame([("far", T0), ("far", dt.datetime(2099, 1, 1))], series.schema))
    with pytest.raises(Exception, match="shop far span"):
        R.hour_spine(late).collect()
    bounded = R.hour_spine(late, F.lit(T0), F.lit(T0 + 2 * HOUR))
    assert bounded.groupBy("tenant").count().where("count <> 2").count() == 0


CASES = [("eq('a')", "a"), ("ne('a')", "bcd"), ("is_in(['a', 'c'])", "ac"), ("str.contains('[ab]')", "ab"), ("str.contains('[', literal=True)", ""),
         ("str.starts_with('a') | str.ends_with('d')", "ad"), ("~(eq('a') | eq('b'))", "cd"), ("ge('b') & (pl.col('n') < 3)", "b"),
         ("pl.col('n') == 4", "d"), ("is_between('b', 'c')", "bc"), ("col('n').is_in((1, 2))", "ab"), ("is_not_null() & ~is_null()", "abcd")]


@pytest.mark.parametrize("text, found", CASES)
def test_conditions(spark, text, found):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), (None, None)], "x string, n int")
    assert "".join(sorted(r.x for r in rows.where(condition(F.col("x"), text)).collect())) == found


@pytest.mark.parametrize("text", [
    "__import__('os')", "eq(open('x'))", "str.upper()", "eq('a') and eq('b')", "eq('a'", "", "is_in('a')", "eq('a', 'b')", "lambda: 1",
    "x.eq('a')", "pl.col('').eq('a')", "eq([1])", "1 < pl.col('n') < 3", "str.contains('a', strict=True)", "eq", "pl.lit(1)"])
def test_unknown_conditions_are_refused(spark, text):
    with pytest.raises(ValueError, match="condition"):
        condition(F.col("x"), text)


def test_configuration_is_read_through_spark(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(default_config(T.GLOBAL_SHOP)))
    assert load_config(f"file://{path}", spark) == load_config(str(path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        load_config(f"file://{tmp_path}/none.json", spark)


def test_missing_default_is_named():
    config = default_config(T.GLOBAL_SHOP)
    del config["kpis"]["orders"]["dimensions"]["location"]["transformations"][0]["default"]
    with pytest.raises(ValueError, match="location: when_then without default"):
        parse_config(json.dumps(config))


@pytest.mark.parametrize("key, value, message", [
    ("index", [], "index"), ("index", ["event_name"], "index"), ("index", "time_hour", "index"), ("index", ["time_hour"] * 2, "index"),
    ("aggregate_function", "len", "aggregate_function")])
def test_pivot_settings(key, value, message):
    config = default_config(T.GLOBAL_SHOP)
    config["pivot_configs"]["device"][key] = value
    with pytest.raises(ValueError, match=message):
        validate(config)


def test_members_of_a_pivot_are_bounded(spark, monkeypatch):
    from tidemark.plans import kpi_engine

    monkeypatch.setattr(kpi_engine, "MOST_MEMBERS", 3)
    long = spark.range(4).select(F.lit("orders").alias("kpi"), F.lit("device").alias("dim"), F.col("id").cast("string").alias("member"),
                                 F.lit("2024-01-01").cast("timestamp_ntz").alias("time"), F.lit(1).alias("n"))
    config = {"kpis": {"orders": {"dimensions": {"device": {"source_column": "x"}}}}, "pivot_configs": {"device": {}}, "mappings": {}}
    with pytest.raises(ValueError, match="more than 3 members"):
        kpi_wide(long, "orders", "device", config)
    assert kpi_wide(long.where("member < 3"), "orders", "device", config).columns == ["time_truncated", "time_hour", "0", "1", "2", "Total"]


def test_packed_first_rows_agree_with_plain_ones(spark):
    rng = np.random.default_rng(5)
    pick = lambda names: names[rng.integers(len(names))]
    rows = [(pick(["k", "l", None]), T0 + dt.timedelta(microseconds=int(m)), pick(["US", "Global", None]), pick(["iOS", "Ä", "a", None]))
            for m in rng.integers(0, 4, 300)]
    rows += [("old", dt.datetime(1700, 1, 1, 0, 0, 0, 1), "US", "a"), ("old", dt.datetime(2250, 1, 1), None, None), ("none", None, "US", "a")]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, g string, d string")
    lists = {"g": ("US", "Global"), "d": ("iOS", "a", "Ä")}
    plain, packed = U.earliest_per_key(df, ["k"], "t", ["g", "d"]), U.earliest_per_key(df, ["k"], "t", ["g", "d"], lists)
    assert same(packed, plain) and packed.dtypes == plain.dtypes
    with pytest.raises(Exception, match="d has a value that is not listed: a"):
        U.earliest_per_key(df, ["k"], "t", ["g", "d"], lists | {"d": ("iOS", "Ä")}).collect()


def test_first_rows_of_raw_events_are_not_sorted(spark):
    from catalog.event_queries import visitors_unique

    plan = visitors_unique(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort " not in plan
    cube = Q.activity(T.browser_events(spark, SF_DIR), BROWSER)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in cube and "SortAggregate" not in cube
