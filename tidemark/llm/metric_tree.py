"""Exact top-k inner products by best-first search in M-trees.

With one more coordinate, the root of ``M**2 - |x|**2`` for the greatest norm ``M`` of a tree, the
greatest inner products with a query are the least distances to it, so a metric tree finds them.
Vectors are dealt by a hash of the id to trees of about ``TREE_ROWS``.  A tree has pages of
``PAGE`` entries; an entry of an inner page has a routing vector, the covering radius of its page
and the distance to the page's own routing vector, an entry of a leaf has its vector and that
distance.  Queries go through a tree together.  Each visits the leaves first that have the least distance that
anything in them can have; then every leaf takes all queries that still reach it, in one product of matrices,
and leaves out entries whose stored distance to the parent proves them too far before computing theirs.
A query's best of all trees are merged.

Scores are exact integers; bounds are in double precision and are loosened by more than its error.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Work

TREE_ROWS, PAGE = 4096, 64
#: Leaves that a query visits by itself before those it has in common with others, and queries searched together.
FIRST, TOGETHER = 2, 1024


class Tree:
    """An M-tree, loaded in bulk; pages hold routing vectors or, in leaves, rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        norms = (self.vectors * self.vectors).sum(1)
        self.top = float(norms.max(initial=0))
        self.points = np.concatenate([self.vectors, np.sqrt(self.top - norms)[:, None]], 1).astype(np.float64)
        self.pages: list[dict] = []
        self.root = self._page(np.arange(len(ids)), None)

    def _page(self, rows: np.ndarray, centre: np.ndarray | None) -> int:
        points = self.points[rows]
        centre = points.mean(0) if centre is None else centre
        page = {"centre": centre}
        if len(rows) <= PAGE:
            to_parent = np.sqrt(((points - centre) ** 2).sum(1))
            order = np.argsort(to_parent, kind="stable")
            page |= {"rows": rows[order], "to_parent": to_parent[order]}
        else:
            # Routing vectors: spread rows, improved by two rounds of means; each row goes to the nearest.
            k = min(PAGE, math.ceil(len(rows) / PAGE * 2))
            seeds = points[np.linspace(0, len(rows) - 1, k).astype(int)]
            for _ in range(3):
                far = (points ** 2).sum(1)[:, None] - 2 * points @ seeds.T + (seeds ** 2).sum(1)
                home = far.argmin(1)
                seeds = np.array([points[home == j].mean(0) if (home == j).any() else seeds[j] for j in range(k)])
            groups = [rows[home == j] for j in range(k) if (home == j).any()]
            if len(groups) == 1:  # equal vectors: any parts of a page's size
                groups = np.array_split(rows, PAGE)
            seeds = [self.points[g].mean(0) for g in groups]
            page |= {"children": [self._page(g, s) for g, s in zip(groups, seeds)], "routing": np.array(seeds),
                     "radius": np.array([np.sqrt(((self.points[g] - s) ** 2).sum(1)).max() for g, s in zip(groups, seeds)]),
                     "to_parent": np.sqrt(((np.array(seeds) - centre) ** 2).sum(1))}
        self.pages.append(page)
        return len(self.pages) - 1

    def _bounds(self, points: np.ndarray):
        """Leaves, and of each query and leaf: the least distance of anything in it, and the least and greatest to its centre."""
        lengths = (points * points).sum(1)
        leaves, lows, nears, fars = [], [], [], []
        stack = [(self.root, np.zeros(len(points)))]
        while stack:
            number, low = stack.pop()
            page = self.pages[number]
            centres = page["centre"][None] if "rows" in page else page["routing"]
            # Squares by a product lose some digits of both lengths: taken off and added, far above that error.
            both = lengths[:, None] + (centres * centres).sum(1)
            square, error = both - 2 * points @ centres.T, 1e-12 * both
            near, far = np.sqrt(np.maximum(0, square - error)), np.sqrt(np.maximum(0, square) + error)
            if "rows" in page:
                leaves.append(page)
                lows.append(low)
                nears.append(near[:, 0])
                fars.append(far[:, 0])
            else:
                bound = np.maximum(low[:, None], near - page["radius"])
                stack += [(child, bound[:, j]) for j, child in enumerate(page["children"])]
        return leaves, np.array(lows).T, np.array(nears).T, np.array(fars).T

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, score, id)`` of the ``k`` greatest inner products of each query, ties to smaller ids, without its id ``own``.

        Each query first visits its ``FIRST`` best leaves, which give it a reach; then each leaf is compared
        at once with the queries that reach it and have not visited it.
        """
        n = len(queries)
        points = np.concatenate([queries, np.zeros((n, 1))], 1).astype(np.float64)
        squares = (points * points).sum(1)
        length = squares + self.top
        slack = 1e-9 * (1 + length)
        # Whole numbers below 2**53 are exact in floats, so a product of matrices is too.
        exact = float(squares.max(initial=0)) * float((self.points * self.points).sum(1).max(initial=0)) < 2.0 ** 104
        asked = points[:, :-1] if exact else queries
        leaves, lows, nears, fars = self._bounds(points)
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # query, score, id
        least = np.full(n, np.iinfo(np.int64).min)  # the k-th best score of each query
        filled = np.zeros(n, bool)

        def reach(at):
            """No row farther than this is among the k best."""
            return np.where(filled[at], np.sqrt(np.maximum(0.0, length[at] - 2.0 * least[at]) + slack[at]), np.inf) + slack[at]

        def visit(j: int, at: np.ndarray) -> None:
            nonlocal found
            page, r = leaves[j], reach(at)
            first = np.searchsorted(page["to_parent"], (nears[at, j] - r).min(), "left")
            last = np.searchsorted(page["to_parent"], (fars[at, j] + r).max(), "right")
            rows = page["rows"][first:last]
            vectors = self.points[rows, :-1] if exact else self.vectors[rows]
            scores = (asked[at] @ vectors.T).astype(np.int64)
            q, row = np.nonzero((scores >= least[at][:, None]) & (self.ids[rows] != own[at][:, None]))
            if not len(q):
                return
            touched = np.zeros(n, bool)
            touched[at[q]] = True
            old = touched[found[0]]
            merged = [np.concatenate([f[old], new]) for f, new in zip(found, (at[q], scores[q, row], self.ids[rows][row]))]
            order = np.lexsort((merged[2], -merged[1], merged[0]))
            merged = [m[order] for m in merged]
            starts = np.searchsorted(merged[0], merged[0], "left")
            place = np.arange(len(starts)) - starts
            full = merged[0][place == k - 1]
            filled[full], least[full] = True, merged[1][place == k - 1]
            found = tuple(np.concatenate([f[~old], m[place < k]]) for f, m in zip(found, merged))

        best = np.argsort(lows, 1, kind="stable")[:, :FIRST]
        seen = np.zeros(lows.shape, bool)
        for turn in range(best.shape[1]):
            for j in np.unique(best[:, turn]).tolist():
                visit(j, np.flatnonzero(best[:, turn] == j))
        np.put_along_axis(seen, best, True, 1)
        for j in np.argsort(lows.min(0), kind="stable").tolist():
            at = np.flatnonzero(~seen[:, j])
            at = at[lows[at, j] <= reach(at)]
            if len(at):
                visit(j, at)
        return found


def usable(vectors: DataFrame) -> Column:
    """Whether a vector is there and finite in all components."""
    e = F.col("embedding").cast("array<double>")
    return e.isNotNull() & F.forall(e, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.col("vec_id").isNotNull()


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` greatest inner products of each query.

    Components ``x`` count as ``floor(scale * x)``.  ``is_query`` marks the queries among the rows;
    candidates are all rows but those of the query's id.  Null vectors and ids, and vectors with a
    null or non-finite component, take no part; vectors of another length than the query's are no
    candidates; the empty vector is one like others.  Equal rows are each a candidate.  An empty
    table gives no rows.
    """
    work = Work(vectors.sparkSession)
    cut = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    rows = work.keep(vectors.filter(usable(vectors)).select(
        F.col("vec_id").cast("long"), cut.alias("v"), F.size("embedding").alias("length"), is_query.alias("is_query")), "rows")
    trees = work.keep(rows.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).alias("trees")), "trees")
    # Equal ids may repeat, so rows are dealt by id and vector.
    held = rows.join(trees, "length").withColumn("tree", F.pmod(F.xxhash64("vec_id", "v"), F.col("trees")))

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(frame.vec_id.to_numpy(), np.array(frame.v.tolist(), np.int64).reshape(len(frame), -1))
        return pd.DataFrame({"length": [key[0]], "tree": [key[1]], "pages": [pickle.dumps(tree)]})

    built = work.keep(held.select("length", "tree", "vec_id", "v").groupBy("length", "tree").applyInPandas(
        build, "length int, tree long, pages binary"), "pages")
    # A stated query set against all rows: each query goes to every tree of its length, tree first.
    asked = rows.filter("is_query").select("length", F.col("vec_id").alias("query_id"), "v").distinct().join(trees, "length").select(
        "length", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), "query_id", "v")
    both = built.unionByName(asked, allowMissingColumns=True).repartition("length", "tree").sortWithinPartitions(
        "length", "tree", F.col("pages").isNull())

    def search(batches):
        tree = None
        for frame in batches:
            out = [np.empty((0, 3), np.int64)]
            # A tree's row comes before its queries.
            part = frame.pages.notna().cumsum()
            for _, group in frame.groupby(part, sort=True):
                if group.pages.iloc[0] is not None:
                    tree, group = pickle.loads(group.pages.iloc[0]), group.iloc[1:]
                for at in range(0, len(group), TOGETHER):
                    some = group.iloc[at:at + TOGETHER]
                    queries = np.array(some.v.tolist(), np.int64).reshape(len(some), -1)
                    own = some.query_id.to_numpy(np.int64)
                    query, score, id_ = tree.search(queries, own, k)
                    out.append(np.stack([own[query], id_, score], 1))
            yield pd.DataFrame(np.concatenate(out), columns=["query_id", "vec_id", "score"])

    found = both.select("pages", F.coalesce("query_id", F.lit(0)).alias("query_id"), "v").mapInPandas(
        search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
