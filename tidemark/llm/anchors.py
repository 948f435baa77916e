"""Product codes of vectors, by exact k-means rounds over metric trees of their parts.

Vectors of integers are cut into equal parts.  A block of rows has, for each part position, an
anchors-hierarchy tree of its distinct parts, built middle-out: about the root of the number of points
become anchors, each new one the point farthest from the anchor of the greatest ball, which takes over
points nearer to it (the triangle inequality names the only ones that can be); below, each anchor's
points are divided in the same way, above, the pairs of balls that fit into the smallest ball are put
together up to the root.  A ball has its centre and radius and caches the count and sum of its rows.

A round passes the codebook down the trees.  A ball inherits the list of entries that may be nearest to
one of its points, and strikes those that the nearest to its centre beats everywhere in it; once one
is left, the ball is wholly owned and adds its cached sum.  Only points of leaves with several entries
left are compared one by one, in integers, so results are those of the plain rounds, ties included.
Blocks are built once, where their rows are read, and no round shuffles more than the sums.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Work
from tidemark.llm.vectors import integers, matrix

BLOCK_ROWS, LEAF_POINTS = 8192, 96
#: Greatest magnitude of an integer component; squared distances of parts then fit 64 bits.
LIMIT = 1 << 27


class Tree:
    """The balls over the distinct points of one part position of a block."""

    def __init__(self, parts: np.ndarray):
        self.points, self.where = np.unique(parts, axis=0, return_inverse=True)
        self.where = self.where.ravel()
        self.weight = np.bincount(self.where, minlength=len(self.points))
        self._floats = self.points.astype(float)
        self.order = np.zeros(0, np.int64)
        self.spans: list[tuple[int, int, int, int]] = []  # first and last point in the order, children or -1
        taken: list[np.ndarray] = []
        self._taken, self._at = taken, 0
        self.root = self._build(np.arange(len(self.points)))
        self.order = np.concatenate(taken)
        spans = np.array(self.spans)
        self.low, self.high, self.left, self.right = spans.T.copy()
        held = self.points[self.order] * self.weight[self.order][:, None]
        running = np.concatenate([np.zeros((1, parts.shape[1]), np.int64), held.cumsum(0)])
        count = np.concatenate([[0], self.weight[self.order].cumsum()])
        self.sums, self.count = running[self.high] - running[self.low], count[self.high] - count[self.low]
        self.centre = self.sums / self.count[:, None]
        self.radius = np.array([np.sqrt(((self._floats[self.order[a:b]] - c) ** 2).sum(1).max())
                                for a, b, c in zip(self.low, self.high, self.centre)])
        self.points, self.where, self.order = (a.astype(np.int32) for a in (self.points, self.where, self.order))
        del self._taken, self._at, self._floats, self.spans

    def _node(self, low: int, high: int, left: int, right: int) -> int:
        self.spans.append((low, high, left, right))
        return len(self.spans) - 1

    def _leaf(self, points: np.ndarray) -> int:
        self._taken.append(points)
        self._at += len(points)
        return self._node(self._at - len(points), self._at, -1, -1)

    def _build(self, points: np.ndarray) -> int:
        if len(points) <= LEAF_POINTS:
            return self._leaf(points)
        owner = self._anchors(points)
        return self._join([points[owner == i] for i in range(owner.max() + 1)])

    def _anchors(self, points: np.ndarray) -> np.ndarray:
        """The anchor, by number, that owns each point."""
        x = self._floats[points]
        pivots = [x[0]]
        near, owner = np.sqrt(((x - x[0]) ** 2).sum(1)), np.zeros(len(x), np.int64)
        for number in range(1, int(np.ceil(len(points) ** 0.5))):
            far = int(near.argmax())  # the greatest ball's farthest point
            apart = np.sqrt(((np.array(pivots) - x[far]) ** 2).sum(1))
            open_ = np.flatnonzero(near > apart[owner] / 2)  # others are nearer to their own anchor
            there = np.sqrt(((x[open_] - x[far]) ** 2).sum(1))
            closer = there < near[open_]
            near[open_[closer]], owner[open_[closer]] = there[closer], number
            pivots.append(x[far])
        return np.unique(owner, return_inverse=True)[1]

    def _join(self, groups: list[np.ndarray]) -> int:
        """Put the balls of the groups together in pairs; children are laid out one after the other."""
        n = len(groups)
        centre = np.array([self._floats[g].mean(0) for g in groups])
        size = np.array([len(g) for g in groups], float)
        radius = np.array([np.sqrt(((self._floats[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centre)])
        shape: list = list(range(n))
        alive = np.ones(n, bool)

        def costs(i: int) -> np.ndarray:
            apart = np.sqrt(((centre - centre[i]) ** 2).sum(1))
            both = np.maximum(np.maximum(radius, radius[i]), (apart + radius + radius[i]) / 2)
            return np.where(alive & (np.arange(n) != i), both, np.inf)

        cost = np.array([costs(i) for i in range(n)])
        for _ in range(n - 1):
            i, j = divmod(int(cost.argmin()), n)
            middle = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
            radius[i] = max(np.sqrt(((centre[i] - middle) ** 2).sum()) + radius[i], np.sqrt(((centre[j] - middle) ** 2).sum()) + radius[j])
            centre[i], size[i], shape[i], alive[j] = middle, size[i] + size[j], (shape[i], shape[j]), False
            cost[j], cost[:, j] = np.inf, np.inf
            cost[i] = cost[:, i] = costs(i)
            last = i
        def lay(part) -> int:
            stack, done = [(part, False)], []
            while stack:
                what, ready = stack.pop()
                if not isinstance(what, tuple):
                    done.append(self._build(groups[what]) if n > 1 else self._leaf(groups[what]))
                elif not ready:
                    stack += [(what, True), (what[1], False), (what[0], False)]
                else:
                    b, a = done.pop(), done.pop()
                    done.append(self._node(self.spans[a][0], self.spans[b][1], a, b))
            return done[0]

        return lay(shape[last] if n > 1 else 0)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and sums that each entry owns, and the entry and squared distance of each distinct point."""
        e = entries.astype(float)
        between = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
        count, sums = np.zeros(len(e), np.int64), np.zeros(entries.shape, np.int64)
        nearest = np.zeros(len(self.order), np.int64)
        at, open_ = np.array([self.root]), np.ones((1, len(e)), bool)
        leaves, lists = [], []
        while len(at):
            far = ((self.centre[at][:, None] - e[None]) ** 2).sum(2)
            far = np.where(open_, far, np.inf)
            best = far.argmin(1)
            least = far[np.arange(len(at)), best]
            # An entry loses everywhere in the ball if the plane between it and the best lies outside the ball.
            apart = between[best]
            slack = 1e-9 * (1 + least + self.radius[at] ** 2)[:, None] + 1e-9 * np.where(np.isfinite(far), far, 0)
            lost = (far - least[:, None] > 2 * self.radius[at][:, None] * apart + slack) | (
                (apart == 0) & (np.arange(len(e))[None] > best[:, None]))
            open_ &= ~lost
            single = open_.sum(1) == 1
            for node, entry in zip(at[single].tolist(), open_[single].argmax(1).tolist()):
                count[entry] += self.count[node]
                sums[entry] += self.sums[node]
                nearest[self.low[node]:self.high[node]] = entry
            leaf = ~single & (self.left[at] < 0)
            leaves.append(at[leaf])
            lists.append(open_[leaf])
            inner = ~single & ~leaf
            at, open_ = np.concatenate([self.left[at[inner]], self.right[at[inner]]]), np.concatenate([open_[inner]] * 2)
        leaves, lists = np.concatenate(leaves), np.concatenate(lists)
        width = self.high[leaves] - self.low[leaves]
        places = np.repeat(self.low[leaves] - np.concatenate([[0], width.cumsum()[:-1]]), width) + np.arange(width.sum()) if len(leaves) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(leaves)), width)
        for a in range(0, len(places), 4096):
            place = places[a:a + 4096]
            point, entry = np.nonzero(lists[of[a:a + 4096]])
            ids = self.order[place]
            d = ((self.points[ids[point]].astype(np.int64) - entries[entry]) ** 2).sum(1)
            first = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
            won = np.flatnonzero(d == np.minimum.reduceat(d, first)[point])
            won = won[np.unique(point[won], return_index=True)[1]]  # of ties the least index
            nearest[place] = entry[won]
            np.add.at(count, entry[won], self.weight[ids])
            np.add.at(sums, entry[won], self.points[ids].astype(np.int64) * self.weight[ids][:, None])
        entry = np.empty(len(self.order), np.int64)
        entry[self.order] = nearest
        return count, sums, entry, ((self.points.astype(np.int64) - entries[entry]) ** 2).sum(1)


def _blocks(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """The rows in blocks as they are read: ``rows`` (ids and labels) and ``trees``."""

    def build(batches):
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([matrix(b.column(2), length) for b in held])
            trees = [Tree(p) for p in np.split(x, parts, axis=1)]
            ids, labels = (table.column(i).to_pylist() for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())),
                                               pa.array([pickle.dumps(trees)], pa.binary())], ["ids", "labels", "trees"])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK_ROWS - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.select("vec_id", F.col("label").cast("string"), "x").mapInArrow(
        build, "ids array<long>, labels array<string>, trees binary")


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of each usable row, and the codebooks (part, entry, component).

    A codebook starts as the parts of the rows of the ``entries`` smallest ids (of fewer, if there
    are fewer; null ids are last, rows of one id go by their vectors); an entry that owns nothing
    stays.  ``code`` has two hex digits for each part, so ``entries`` is 256 at most.  Null, empty and
    non-finite vectors, those with a null component or one beyond 2**27 / ``scale`` in magnitude, and
    those of another length than most take no part; if ``parts`` does not divide that length, there is a
    ``ValueError``.  Equal rows are coded each; null ids and labels stay null (``label`` is text).  An
    empty table gives no rows and codebooks without entries.  Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so there are 1 to 256 entries")
    spark = vectors.sparkSession
    work = Work(spark)
    rows, length = integers(vectors, scale, 0, LIMIT, work, "rows", "label")
    schema = "vec_id long, label string, code string, error long"
    if not length:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    blocks = work.keep(_blocks(rows, length, parts), "blocks")

    for _ in range(rounds):
        def totals(batches, books=books):
            count, sums = np.zeros(books.shape[:2], object), np.zeros(books.shape, object)
            for batch in batches:
                for trees in batch.column(0):
                    for i, tree in enumerate(pickle.loads(trees.as_py())):
                        n, total, _, _ = tree.assign(books[i])
                        count[i] += n.astype(object)
                        sums[i] += total.astype(object)
            used = np.argwhere(count > 0)
            for at in range(0, len(used), 4096):
                part = used[at:at + 4096]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[:, 0].astype(np.int32)), pa.array(part[:, 1].astype(np.int32)),
                    pa.array([int(count[i, j]) for i, j in part]), pa.array([sums[i, j].astype(np.int64).tolist() for i, j in part], pa.list_(pa.int64()))],
                    ["part", "entry", "n", "sums"])

        found = blocks.select("trees").mapInArrow(totals, "part int, entry int, n long, sums array<long>")
        wide = books.shape[2]
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[
            F.sum(F.col("sums")[i].cast("decimal(30,0)")).alias(f"s{i}") for i in range(wide)]).collect()
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(wide)]

    def code(batches, books=books):
        for batch in batches:
            for ids, labels, trees in zip(*(c for c in batch.columns)):
                codes, error = [], 0
                for i, tree in enumerate(pickle.loads(trees.as_py())):
                    _, _, entry, far = tree.assign(books[i])
                    codes.append(entry[tree.where].astype(np.uint8))
                    error = error + far[tree.where]
                digits = np.stack(codes, 1).tobytes().hex()
                step = 2 * books.shape[0]
                yield pa.RecordBatch.from_arrays([
                    ids.values, labels.values, pa.array([digits[j:j + step] for j in range(0, len(digits), step)]), pa.array(error)],
                    ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(code, schema), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers of the codebooks, in their order, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def describe_codes(vectors: DataFrame, **settings) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of the rows of ``encode``.

    ``label_error`` is the error summed over all rows of the row's label, those without one together.
    """
    coded, books = encode(vectors, **settings)
    coded = Work(vectors.sparkSession).keep(coded, "coded")
    # Summed before the shuffle; a join, unlike a window, lets Spark split a label with many rows.
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
