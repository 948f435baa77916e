"""Approximate nearest neighbours by collision counting (query-aware hashing).

Vectors lie in blocks of about ``BLOCK_ROWS``.  A block has ``LINES`` random projections, each a sorted
array.  For a radius ``R`` a query's window in each array is centred on its own projection, ``HALF_WINDOW *
R`` to each side.  A vector at distance ``R`` or less lies in a window with probability 0.866 or more, so
it collides in ``THRESHOLD`` windows or more with probability 0.84 at ``R`` and far more for nearer ones;
one at 1.25 ``R``, in 77% of the windows, does so once in about 1,500 times.  Vectors that do are verified
by their exact distance.  Narrower windows would need more lines for the same two probabilities.

Each query first searches one block, its home: virtual rehashing widens the windows, counting only
what is new, until the k-th verified distance is within ``R``.  That distance then bounds its search of
every other block: one set of windows, whose collisions are counted by the few rows outside them, and
blocks that too few windows reach are left out.  No number of candidates is capped, and every row
is indexed; only the projections, which the data do not shape, are drawn from a seed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Work

BLOCK_ROWS, QUERY_ROWS, LINES, HALF_WINDOW, STEP = 8192, 256, 320, 1.5, 1.03
_HIT = math.erf(HALF_WINDOW / math.sqrt(2))
THRESHOLD = math.floor(LINES * _HIT - math.sqrt(LINES * _HIT * (1 - _HIT)))


class Block:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # Far components are scaled down for hashing, distances are of the vectors themselves.
        self.scale = float(np.abs(vectors).max(initial=0)) or 1.0
        self.lines = np.random.default_rng(7).standard_normal((vectors.shape[1], LINES))
        shadow = ((self.vectors / self.scale) @ self.lines).T.copy()
        self.rows = np.argsort(shadow, axis=1, kind="stable")
        places = np.take_along_axis(shadow, self.rows, axis=1)
        low = places[:, 0]
        # One array for all lines: each line's places are moved behind those of the line before.
        self.span = 2 * float((places[:, -1] - low).max(initial=0)) + 1
        self.shift = np.arange(LINES) * self.span - low
        self.places = (places + self.shift[:, None]).ravel()
        self.ends = places[:, -1] - low
        self.slack = 1e-9 * LINES * self.span
        deviation = float(shadow.std()) if len(ids) else 0.0
        self.first_radius = max(deviation / 4, 1e-4 * float(np.abs(shadow).mean()) if len(ids) else 0.0, 1e-12)
        self.verified = 0

    def windows(self, centre: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of each line's window."""
        start = np.arange(LINES) * self.span
        n = len(self.ids)
        low = np.clip(centre + self.shift - reach - self.slack - start, 0, self.span)
        high = np.clip(centre + self.shift + reach + self.slack - start, -1, self.span - 1)
        base = np.arange(LINES) * n
        return (np.clip(np.searchsorted(self.places, start + low, "left") - base, 0, n),
                np.clip(np.searchsorted(self.places, start + high, "right") - base, 0, n))

    def _verify(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        self.verified += len(at)
        return np.sqrt(((self.vectors[at] - query) ** 2).sum(1))

    def _best(self, found: np.ndarray, distances: np.ndarray, k: int) -> list[tuple[float, int]]:
        best = np.lexsort((self.ids[found], distances))[:k]
        return list(zip(distances[best].tolist(), self.ids[found[best]].tolist()))

    def widen(self, query: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
        """``(distance, id)`` of the ``k`` nearest found, ties to smaller ids, without id ``own``."""
        n = len(self.ids)
        checked = self.ids == own
        others = n - int(checked.sum())
        centre = (query / self.scale) @ self.lines
        hits = np.zeros(n, np.int64)
        distances, found = np.zeros(0), np.zeros(0, np.int64)
        radius, low, high = self.first_radius, None, None
        while len(found) < others:
            a, b = self.windows(centre, HALF_WINDOW * radius)
            b = np.maximum(a, b)
            if low is None:
                new = [r[i:j] for r, i, j in zip(self.rows, a, b)]
            else:  # an empty window may lie elsewhere than the wider one
                empty = low == high
                low, high = np.where(empty, a, low), np.where(empty, a, high)
                new = [r[i:j] for r, i, j in zip(self.rows, a, low)] + [r[i:j] for r, i, j in zip(self.rows, high, b)]
            low, high = a, b
            hits += np.bincount(np.concatenate(new), minlength=n)
            at = np.flatnonzero((hits >= THRESHOLD) & ~checked)
            if len(at):
                checked[at] = True
                distances = np.concatenate([distances, self._verify(at, query)])
                found = np.concatenate([found, at])
            if len(found) >= k and np.partition(distances, k - 1)[k - 1] <= radius * self.scale:
                break
            radius *= STEP if len(found) else 1.2
        return self._best(found, distances, k)

    def within(self, query: np.ndarray, own: int, k: int, bound: float) -> list[tuple[float, int]]:
        """As ``widen``, of the rows within ``bound``."""
        n = len(self.ids)
        centre = (query / self.scale) @ self.lines
        reach = HALF_WINDOW * bound / self.scale
        off = centre + self.shift - np.arange(LINES) * self.span
        if ((off + reach + self.slack >= 0) & (off - reach - self.slack <= self.ends)).sum() < THRESHOLD:
            return []
        a, b = self.windows(centre, reach)
        b = np.maximum(a, b)
        out = [r[:i] for r, i in zip(self.rows, a)] + [r[j:] for r, j in zip(self.rows, b)]
        missed = np.bincount(np.concatenate(out), minlength=n)
        at = np.flatnonzero((missed <= LINES - THRESHOLD) & (self.ids != own))
        distances = self._verify(at, query)
        near = distances <= bound
        return self._best(at[near], distances[near], k)


def usable() -> Column:
    """Whether a vector is there, finite in all components, and not zero."""
    e = F.col("embedding").cast("array<double>")
    return F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(e, lambda x: x != 0)


def _groups(rows: DataFrame, size: int, salt: str) -> DataFrame:
    """Rows in groups of one length, ``group`` numbered from 0 and of about ``size`` rows, whatever their ids and vectors."""
    sizes = rows.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / size).alias("groups"))
    return rows.join(F.broadcast(sizes), "length").withColumn("group", F.pmod(F.xxhash64(F.lit(salt), "number"), F.col("groups")))


def _packed(rows: DataFrame) -> DataFrame:
    """One row for each group: its ids and its vectors one after the other."""
    def run(key, table):
        table = table.combine_chunks()
        return pa.table({"length": pa.array([key[0].as_py()], pa.int32()), "group": [key[1].as_py()], "groups": [table.column("groups")[0].as_py()],
                         "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                         "vectors": [np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]).tobytes()]})

    return rows.select("length", "group", "groups", "vec_id", "v").groupBy("length", "group").applyInArrow(
        run, "length int, group long, groups long, ids array<long>, vectors binary")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, by Euclidean distance.

    ``is_query`` marks the queries among the rows; candidates are all rows but those of the query's
    id.  Null ids, null, empty and zero vectors and those with a null or non-finite component take no
    part; vectors of another length than the query's are no candidates.  Equal rows are each a
    candidate; ties go to the smaller id.  Equal rows that are queries are one.  Other columns are not
    read.  An empty table gives no rows.
    """
    work = Work(vectors.sparkSession)
    # Numbered when they are written, so that equal rows, however many, are dealt to different blocks.
    rows = work.keep(vectors.filter(usable()).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("length"),
        is_query.alias("is_query"), F.monotonically_increasing_id().alias("number")), "rows")
    blocks = work.keep(_packed(_groups(rows, BLOCK_ROWS, "block")), "blocks")
    asked = rows.filter("is_query").groupBy("vec_id", "v", "length").agg(F.min("number").alias("number"))
    asked = work.keep(_groups(asked, QUERY_ROWS, "query"), "asked")

    def search(block_rows, asked_rows, first: bool) -> list[tuple]:
        length = block_rows[0]
        block = Block(np.array(block_rows[1], np.int64), np.frombuffer(block_rows[2]).reshape(-1, length))
        out = []
        for number, query_id, v, bound in asked_rows:
            query = np.array(v, float)
            # A home with fewer than k rows gives no bound.
            found = block.widen(query, query_id, k) if first or bound is None else block.within(query, query_id, k, bound)
            out += [(number, query_id, i, s) for s, i in found]
        return out

    def run(first: bool):
        def part(left, right):
            out = []
            if left.num_rows and right.num_rows:
                held = left.to_pylist()[0]
                out = search((held["length"], held["ids"], held["vectors"]), list(zip(*(
                    right.column(c).to_pylist() for c in ("number", "vec_id", "v", "bound")))), first)
            columns = list(zip(*out)) or [[]] * 4
            return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                             pa.array(columns[3], pa.float64())], names=["number", "query_id", "vec_id", "score"])
        return part

    shape = "number long, query_id long, vec_id long, score double"
    homes = blocks.groupBy("length").agg(F.first("groups").alias("blocks"))
    asked = asked.select("length", F.col("group").alias("slice"), "number", "vec_id", "v").join(F.broadcast(homes), "length").withColumn(
        "home", F.pmod(F.xxhash64(F.lit("home"), "number"), F.col("blocks")))
    at_home = asked.select("length", F.col("home").alias("group"), "number", "vec_id", "v", F.lit(None).cast("double").alias("bound"))
    found = work.keep(blocks.groupBy("length", "group").cogroup(at_home.groupBy("length", "group")).applyInArrow(run(True), shape), "home")
    bounds = found.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("bound")).filter(F.col("n") >= k).drop("n")

    # A stated query set against all rows: each slice of the queries goes to every other block of its length.
    away = asked.join(bounds, "number", "left").select(
        "length", "slice", "number", "vec_id", "v", "bound", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("group"))
    away = away.filter("group <> home").drop("home")
    slices = away.select("length", "group", "slice").distinct()
    sent = blocks.join(slices, ["length", "group"])
    sent = sent.select("length", "group", F.col("slice").alias("part"), "ids", "vectors")
    far = sent.groupBy("length", "group", "part").cogroup(away.groupBy("length", "group", "slice")).applyInArrow(run(False), shape)
    rank = F.row_number().over(Window.partitionBy("number").orderBy("score", "vec_id"))
    both = found.unionByName(far).withColumn("rank", rank).filter(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
