"""Which dimension members stand out in an anomalous hour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import clean_name_lists
from tidemark.functions.numbers import rounded
from tidemark.operators.baseline import top_level
from tidemark.plans.profiles import Profile

PANEL = ("tenant", "metric", "dim")

# Fixed value: share of the knee distance that links two members.
LINK_FACTOR = 0.5
#: Points of a panel that one task searches, of a cell of a larger one, and of the sample that shapes its cells.
PANEL_ROWS, CELL_ROWS, SAMPLE_ROWS = 50_000, 20_000, 4_096
#: Points of a leaf of a panel's spatial tree, and leaves compared at once.
LEAF_POINTS, LEAVES_AT_ONCE = 64, 32


def anomalous_hours(scored: DataFrame) -> DataFrame:
    return top_level(scored).where(F.col("is_anomaly") == 1).select("tenant", "metric", "ds")


def hour_vectors(scored: DataFrame, profile: Profile) -> DataFrame:
    """One row per anomalous hour and dimension with ``values``: an array, in report order,
    of ``(ord, member, value)`` with 0 for a missing percent difference.

    The array holds the registered members of the dimension, never more.
    """
    wanted = anomalous_hours(scored).select(
        "tenant", "metric", "ds", F.inline(profile.places_of(F.col("metric"))))
    values = scored.select("tenant", "metric", "dim", "member", "ds", "percent_diff")
    return (
        wanted.join(values, ["tenant", "metric", "dim", "member", "ds"], "left")
        .groupBy("tenant", "metric", "dim", "ds")
        .agg(F.array_sort(F.collect_list(F.struct(
            "ord", "member", F.coalesce("percent_diff", F.lit(0.0)).alias("value")))).alias("values"))
    )


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a spatial tree, halved by position along the widest coordinate,
    so that ties in it do not matter."""
    open_, done = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF_POINTS:
            done.append(rows)
            continue
        axis = int(np.argmax(np.ptp(points[rows], axis=0)))
        rows = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
        open_ += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
    return done


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, one coordinate at a time."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        delta = a[:, i, None] - b[None, :, i]
        out += delta * delta
    return out


def _nearest(points: np.ndarray) -> np.ndarray:
    """Distance of each point to its nearest other point.

    Equal points are taken together.  A leaf of the tree looks through the other leaves from the
    nearest box on, until the boxes are farther away than the best found of all its points.
    """
    points, where, count = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    best = np.full(len(points), np.inf)
    leaves = _leaves(points)
    low = np.array([points[rows].min(axis=0) for rows in leaves])
    high = np.array([points[rows].max(axis=0) for rows in leaves])
    for number, rows in enumerate(leaves):
        own = points[rows]
        near = _squares(own, own)
        np.fill_diagonal(near, np.inf)
        found = near.min(axis=1)
        gap = np.maximum(np.maximum(low - high[number], low[number] - high), 0)
        gap = (gap * gap).sum(axis=1)
        gap[number] = np.inf
        order = np.flatnonzero(gap < found.max())
        order = order[np.argsort(gap[order], kind="stable")]
        for at in range(0, len(order), LEAVES_AT_ONCE):
            some = order[at:at + LEAVES_AT_ONCE]
            if gap[some[0]] >= found.max():
                break
            # Of the leaf's points, those that a box is nearer to than their best so far.
            apart = np.zeros((len(own), len(some)))
            for i in range(points.shape[1]):
                side = np.maximum(np.maximum(low[some, i] - own[:, i, None], own[:, i, None] - high[some, i]), 0)
                apart += side * side
            looking = np.flatnonzero((apart < found[:, None]).any(axis=1))
            if len(looking):
                boxes = some[(apart[looking] < found[looking, None]).any(axis=0)]
                others = points[np.concatenate([leaves[j] for j in boxes])]
                found[looking] = np.minimum(found[looking], _squares(own[looking], others).min(axis=1))
        best[rows] = np.sqrt(found)
    best[count > 1] = 0.0
    return best[where.ravel()]


def _panel_distances(panel: pd.DataFrame) -> pd.DataFrame:
    distances = _nearest(np.array(panel["point"].tolist(), dtype="float64"))
    return panel[[*PANEL, "ds"]].assign(distance=np.where(np.isfinite(distances), distances, np.nan))


def _boxes(sample: np.ndarray, cells: int) -> list[tuple[list[float], list[float]]]:
    """Bounds ``low <= x < high`` of about ``cells`` boxes that cover all space, halving a sample's widest coordinates."""
    width = sample.shape[1]
    open_ = [(np.unique(sample, axis=0), np.full(width, -np.inf), np.full(width, np.inf), cells)]
    done = []
    while open_:
        points, low, high, parts = open_.pop()
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(width)
        if parts < 2 or not (spread > 0).any():
            done.append((low.tolist(), high.tolist()))
            continue
        axis = int(np.argmax(spread))
        values = np.sort(points[:, axis])
        # A cut above the least value, so that both sides have points.
        cut = max(values[len(values) // 2], values[np.searchsorted(values, values[0], "right")])
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = cut
        below = points[:, axis] < cut
        open_ += [(points[below], low, left, parts // 2), (points[~below], right, high, parts - parts // 2)]
    return done


def _panel_cells(panel: pd.DataFrame) -> pd.DataFrame:
    boxes = _boxes(np.array(panel["point"].tolist(), dtype="float64"), int(-(-panel["rows"].iloc[0] // CELL_ROWS)))
    cells = [{"cell": i, "low": low, "high": high} for i, (low, high) in enumerate(boxes)]
    return panel[list(PANEL)].iloc[:1].assign(cells=[cells])


def _cell_distances(cell: pd.DataFrame) -> pd.DataFrame:
    return cell[[*PANEL, "cell", "point"]].assign(best=_nearest(np.array(cell["point"].tolist(), dtype="float64")))


def _visitor_distances(visitors: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
    """Distance of each visitor to the nearest point of the cell."""
    own, others = (np.array(f["point"].tolist(), dtype="float64") for f in (visitors, cell))
    best = [np.sqrt(_squares(own[i:i + 256], others).min(axis=1)) for i in range(0, len(own), 256)] if len(others) else []
    return visitors[[*PANEL, "point"]].assign(best=np.concatenate(best) if best else np.inf)


def _divided(points: DataFrame) -> DataFrame:
    """Nearest distances of large panels, cell by cell.

    The distinct points of a panel are dealt to boxes of about ``CELL_ROWS`` (from a sample of at most about
    ``SAMPLE_ROWS``, which only shapes the boxes).  Each cell finds the nearest within it; a point then
    visits the other cells whose boxes are nearer than that, so copies go only to where they can matter.
    """
    panel = list(PANEL)
    distinct = points.groupBy(*panel, "point", "rows").agg(F.count("*").alias("copies"))
    share = F.ceil(F.col("rows") / SAMPLE_ROWS)
    cells = distinct.where(F.pmod(F.xxhash64("point"), share) == 0).groupBy(*panel).applyInPandas(
        _panel_cells, "tenant string, metric string, dim string, cells array<struct<cell:int,low:array<double>,high:array<double>>>")

    def inside(c):
        return F.forall(F.arrays_zip("point", c["low"].alias("low"), c["high"].alias("high")),
                        lambda z: (z["point"] >= z["low"]) & (z["point"] < z["high"]))

    def apart(c):
        sides = F.transform(F.arrays_zip("point", c["low"].alias("low"), c["high"].alias("high")), lambda z: F.greatest(
            z["low"] - z["point"], z["point"] - z["high"], F.lit(0.0)))
        return F.sqrt(F.aggregate(sides, F.lit(0.0), lambda s, x: s + x * x))

    # A panel whose sample is empty is one cell.
    whole = F.array().cast("array<struct<cell:int,low:array<double>,high:array<double>>>")
    placed = distinct.join(cells, panel, "left").withColumn("cells", F.coalesce("cells", whole))
    placed = placed.withColumn("cell", F.coalesce(F.get(F.filter("cells", inside), F.lit(0))["cell"], F.lit(0)))
    kind = "tenant string, metric string, dim string, cell int, point array<double>, best double"
    first = placed.select(*panel, "cell", "point").groupBy(*panel, "cell").applyInPandas(_cell_distances, kind)
    away = first.join(cells, panel).select(*panel, "point", F.explode(F.filter(
        "cells", lambda c: (c["cell"] != F.col("cell")) & (apart(c) < F.col("best")))).alias("to"))
    visits = away.select(*panel, "point", F.col("to.cell").alias("to")).groupBy(*panel, "to")
    residents = placed.select(*panel, F.col("cell").alias("home"), "point").groupBy(*panel, "home")
    second = visits.cogroup(residents).applyInPandas(
        _visitor_distances, "tenant string, metric string, dim string, point array<double>, best double")
    nearest = first.drop("cell").unionByName(second).groupBy(*panel, "point").agg(F.min("best").alias("best"))
    alone = distinct.select(*panel, "point", "copies").join(nearest, [*panel, "point"])
    distance = F.when(F.col("copies") > 1, 0.0).when(F.col("best") < float("inf"), F.col("best")).otherwise(float("nan"))
    return points.drop("rows").join(alone.select(*panel, "point", distance.alias("distance")), [*panel, "point"]).select(
        *panel, "ds", "distance")


def nn_distance(vectors: DataFrame) -> DataFrame:
    """Distance of each anomalous hour's vector to the nearest other one of its panel.

    A panel (shop, metric, dimension) has at most one point per hour of the analysed time,
    independent of the number of events, and is searched without listing pairs.  A panel of more
    than ``PANEL_ROWS`` points is divided among tasks (``_divided``), with the same outcome.
    """
    points = vectors.select(*PANEL, "ds", F.transform("values", lambda v: v["value"]).alias("point"))
    schema = "tenant string, metric string, dim string, ds timestamp_ntz, distance double"
    large = points.groupBy(*PANEL).agg(F.count("*").alias("rows")).where(F.col("rows") > PANEL_ROWS)
    if large.isEmpty():
        found = points.groupBy(*PANEL).applyInPandas(_panel_distances, schema)
    else:
        small = points.join(large, list(PANEL), "left_anti").groupBy(*PANEL).applyInPandas(_panel_distances, schema)
        found = small.unionByName(_divided(points.join(large, list(PANEL))))
    return found.withColumn("distance", rounded(F.when(~F.isnan("distance"), F.col("distance"))))


def knee_eps(distances: DataFrame, rule: str = "global", sensitivity: float = 1.0) -> DataFrame:
    """Knee of each panel's sorted distances, null without spread.

    ``global``: the distance farthest below the straight line from the smallest to the largest.
    ``local``: walking from the largest distance down, the first one that is a local maximum of that
    depth and after which the depth falls by more than ``sensitivity`` steps of the axis before it
    rises again (a local minimum lowers the mark to 0); null if there is none.
    """
    if rule not in ("global", "local"):
        raise ValueError(f"unknown knee rule {rule!r}, expected 'global' or 'local'")
    panel = Window.partitionBy(*PANEL)
    ranked = distances.where(F.col("distance").isNotNull()).select(
        *PANEL, "distance",
        (F.row_number().over(panel.orderBy("distance", "ds")) - 1).alias("i"),
        F.count("*").over(panel).alias("n"),
        F.min("distance").over(panel).alias("low"),
        F.max("distance").over(panel).alias("high"))
    below = F.col("i") / F.nullif(F.col("n") - 1, F.lit(0)) - (
        F.col("distance") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    usable = F.col("high") > F.col("low")
    ranked = ranked.withColumn("below", F.round(below, 9))
    if rule == "local":
        return _local_knee(ranked, sensitivity)
    return (
        ranked.groupBy(*PANEL)
        .agg(F.max_by("distance", F.when(usable, F.struct("below", (-F.col("i")).alias("i")))).alias("eps"))
    )


def _local_knee(ranked: DataFrame, sensitivity: float) -> DataFrame:
    down = Window.partitionBy(*PANEL).orderBy(F.desc("i"))
    walked = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here, before, after = F.col("below"), F.lag("below").over(down), F.lead("below").over(down)
    # The ends have one neighbour; equal neighbours make a place both a maximum and a minimum.
    top = (here >= F.coalesce(before, here)) & (here >= F.coalesce(after, here))
    bottom = (here <= F.coalesce(before, here)) & (here <= F.coalesce(after, here))
    fall = F.round(here - F.lit(float(sensitivity)) / (F.col("n") - 1), 9)
    marked = ranked.where(F.col("high") > F.col("low")).withColumns({
        "mark": F.when(bottom, F.lit(0.0)).when(top, fall), "peak": F.when(top, F.col("distance")), "next": after})
    seen = marked.withColumns({
        "mark": F.last("mark", ignorenulls=True).over(walked), "peak": F.last("peak", ignorenulls=True).over(walked)})
    found = F.col("peak").isNotNull() & (F.col("next") < F.col("mark"))
    local = seen.groupBy(*PANEL).agg(F.max_by("peak", F.when(found, F.col("i"))).alias("eps"))
    return ranked.select(*PANEL).distinct().join(local, list(PANEL), "left")


def max_contributors(vectors: DataFrame, eps: DataFrame, factor: float = LINK_FACTOR) -> DataFrame:
    """Members in the topmost cluster of absolute values, null when there is one cluster.

    Sorted from the largest absolute value down, the topmost cluster ends at the first gap
    wider than ``factor * eps``; that is density clustering with a minimum size of one.
    """
    joined = vectors.join(eps, list(PANEL), "left")
    ranked = joined.withColumn("ranked", F.reverse(F.array_sort(F.transform(
        "values", lambda v: F.struct(F.abs(v["value"]).alias("size"), v["member"].alias("member"))))))
    count = F.size("ranked")
    gaps = F.zip_with(
        F.slice("ranked", 1, count - 1), F.slice("ranked", 2, count - 1),
        lambda a, b: rounded(a["size"] - b["size"]) > F.col("eps") * factor)
    cut = ranked.withColumn("cut", F.when(count > 1, F.array_position(gaps, True)))
    names = F.array_sort(F.transform(F.slice("ranked", 1, F.col("cut").cast("int")), lambda v: v["member"]))
    return cut.select(
        *PANEL, "ds", F.when(F.col("cut") > 0, names).alias("contributors"))


def contributors_combined(by_dim: DataFrame) -> DataFrame:
    """All dimensions' contributors of a metric's hour in one cleaned list, null if none."""
    return (
        by_dim.groupBy("tenant", "metric", "ds")
        .agg(clean_name_lists(F.collect_list("contributors")).alias("contributors"))
    )


def contributors_outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer match of two contributor tables on the list itself, empty lists included.

    Kept folded, one row per list with the hours of either side and the number of matches:
    a list shared by many hours (most often the empty one) is never spelled out in pairs.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tenant", F.col("contributors").alias(f"key_{name}")).agg(
            F.array_sort(F.collect_list("ds")).alias(f"hours_{name}")
        ).withColumnRenamed("tenant", f"tenant_{name}")

    match = F.col("key_x").eqNullSafe(F.col("key_y")) & (F.col("tenant_x") == F.col("tenant_y"))
    none = F.array().cast("array<timestamp_ntz>")
    return side(left, "x").join(side(right, "y"), match, "full").select(
        F.coalesce("tenant_x", "tenant_y").alias("tenant"),
        F.coalesce("key_x", "key_y").alias("contributors"),
        F.coalesce("hours_x", none).alias("hours_x"),
        F.coalesce("hours_y", none).alias("hours_y"),
    ).withColumn("matches", F.size("hours_x").cast("bigint") * F.size("hours_y"))


def find_contributors(scored: DataFrame, profile: Profile) -> DataFrame:
    """``tenant, metric, dim, ds, contributors`` for every anomalous hour."""
    vectors = hour_vectors(scored, profile)
    return max_contributors(vectors, knee_eps(nn_distance(vectors)))
