"""Whitening by spectral divide and conquer on polar decompositions (QDWH).

The covariance is of integers and is summed exactly: components become integers, their rounded mean is
taken off before they are multiplied, and the sums, which are integers too, do not depend on the order
of rows or partitions.  Of the d x d matrix the driver finds the spectrum: the polar factor of
``V - s I``, by dynamically weighted Halley steps in their QR form, is the sign of the shifted matrix, so
``(U + I) / 2`` projects on the eigenvectors above ``s``.  The matrix is compressed to the two invariant
subspaces and each is split again, down to single components.  These, d numbers each, go to the tasks,
which whiten all rows in one pass.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Work
from tidemark.llm.vectors import integers, matrix

#: Greatest length of a vector: the driver holds a matrix of its square.
MAX_LENGTH = 2048
#: Greatest magnitude of an integer component; sums of products of them fit decimal(38).
LIMIT = 1 << 50
EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH."""
    n = len(a)
    x = a / (np.abs(a).sum(0).max() or 1.0)  # the greatest row sum bounds the greatest singular value
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * n ** 0.5)
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, EPS / n), 1.0)
    eye = np.eye(n)
    for _ in range(40):
        l2 = low * low
        d = (4 * max(1 - l2, 0) / (l2 * l2)) ** (1 / 3)
        root = (1 + d) ** 0.5
        f = root + 0.5 * max(8 - 4 * d + 8 * (2 - l2) / (l2 * root), 0) ** 0.5
        g = (f - 1) ** 2 / 4
        h = f + g - 1
        q = np.linalg.qr(np.vstack([h ** 0.5 * x, eye]))[0]
        new = g / h * x + (f - g / h) / h ** 0.5 * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (f + g * l2) / (1 + h * l2))
        if moved <= 1e-8 and abs(1 - low) < 1e-8:  # steps are of third order, so the next is below EPS
            break
    return x


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    norm = np.linalg.norm(a)
    values, vectors = _split(a, norm, np.random.default_rng(12))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _split(a: np.ndarray, norm: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    n, diagonal = len(a), np.diag(a)
    if n == 1 or np.linalg.norm(a - np.diag(diagonal)) <= EPS * norm:
        return diagonal.copy(), np.eye(n)
    if n == 2:
        # One plane rotation splits it.
        t = np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1]) / 2
        q = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        return np.diag(q.T @ a @ q).copy(), q
    ordered, best = np.sort(diagonal), None
    mean = diagonal.mean()
    # The mean lies inside the spectrum; of the shifts, the first that hits no eigenvalue will do.
    for shift in [np.median(ordered), mean, *(mean + t * (ordered[-1] - mean) for t in (0.3, 0.6)), *(mean + t * (ordered[0] - mean) for t in (0.3, 0.6))]:
        sign = polar(a - shift * np.eye(n))
        above = (sign + np.eye(n)) / 2
        k = int(round(float(np.trace(above))))
        if not 0 < k < n:
            continue
        first = np.linalg.qr(above @ rng.standard_normal((n, k)))[0]
        first = np.linalg.qr(above @ first)[0]
        q = np.linalg.qr(np.hstack([first, rng.standard_normal((n, n - k))]))[0]
        q[:, k:] = np.linalg.qr(q[:, k:] - first @ (first.T @ q[:, k:]))[0]
        left = np.linalg.norm(q[:, :k].T @ a @ q[:, k:])
        if best is None or left < best[0]:
            best = (left, k, q)
        if left <= 20 * n * EPS * norm:
            break
    if best is None:  # equal eigenvalues as far as these digits tell
        return diagonal.copy(), np.eye(n)
    _, k, q = best
    parts = [_split((p + p.T) / 2, norm, rng) for p in (q[:, :k].T @ a @ q[:, :k], q[:, k:].T @ a @ q[:, k:])]
    return np.concatenate([p[0] for p in parts]), np.hstack([q[:, :k] @ parts[0][1], q[:, k:] @ parts[1][1]])


def _product(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of integers, exactly, as Python integers."""
    top = int(np.abs(y).max(initial=0))
    step = (1 << 53) // max(top * top, 1)
    if step < 1:
        y = y.astype(object)
        return y.T @ y
    out = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), step):
        part = y[at:at + step].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable row and component.

    ``deviation`` is a decimal(38, 0), which holds it for up to about 10**14 rows.  Components with no
    variance (to double precision) have ``whitened`` and ``explained`` 0 and are left out of
    ``identity_error``; vectors shorter than ``components`` have as many as their length.  Null, empty
    and non-finite vectors, those with a null component or one beyond 2**50, and those of another length
    than most take no part.  Null ids stay null; equal rows are each a row, and none, or a single one, has no
    variance.  An empty table gives no rows.  Of the columns only ``vec_id`` and ``embedding`` are read.
    """
    spark = vectors.sparkSession
    work = Work(spark)
    rows, length = integers(vectors, scale, offset, LIMIT, work, "rows")
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if not length:
        return spark.createDataFrame([], schema)
    if length > MAX_LENGTH:
        raise ValueError(f"vectors are longer than {MAX_LENGTH}")

    def totals(batches):
        total, n = np.zeros(length, object), 0
        for batch in batches:
            x = matrix(batch.column(0), length)
            total, n = total + x.sum(0).astype(object), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length + 1), pa.int32()), _decimals([*total, n])], ["at", "total"])

    found = {r["at"]: int(r["total"]) for r in rows.select("x").mapInArrow(totals, "at int, total decimal(38,0)").groupBy("at").agg(
        F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    sums, n = [found[i] for i in range(length)], found[length]
    mean = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    upper = np.triu_indices(length)

    def products(batches):
        total = np.zeros((length, length), object)
        for batch in batches:
            total += _product(matrix(batch.column(0), length) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int32()), _decimals(total[upper])], ["at", "total"])

    found = rows.select("x").mapInArrow(products, "at int, total decimal(38,0)").groupBy("at").agg(
        F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    covariance = np.zeros((length, length))
    for r in found:  # n * sum(y y') - sum(y) sum(y)', exact until it is divided
        i, j = int(upper[0][r["at"]]), int(upper[1][r["at"]])
        covariance[i, j] = covariance[j, i] = (n * int(r["total"]) - int(rest[i]) * int(rest[j])) / (n * n)
    values, axes = spectrum(covariance)
    k = min(components, length)
    trace = float(np.trace(covariance))
    alive = values[:k] > length * EPS * max(trace, 0.0)
    axes = axes[:, :k] * np.where(np.take_along_axis(axes[:, :k], np.abs(axes[:, :k]).argmax(0)[None], 0)[0] < 0, -1, 1)
    weights = np.where(alive, axes / np.sqrt(np.where(alive, values[:k], 1.0)), 0.0)
    explained = np.where(alive, values[:k] / (trace or 1.0), 0.0)
    fraction = rest / n

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - mean) - fraction) @ weights

    pairs = np.triu_indices(k)

    def moments(batches):
        total = np.zeros(len(pairs[0]))
        for batch in batches:
            w = whitened(matrix(batch.column(0), length))
            total += (w.T @ w)[pairs]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "total"])

    # The whitened rows are centred already, as their mean is taken off exactly.
    error = 0.0
    for r in rows.select("x").mapInArrow(moments, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
        i, j = pairs[0][r["at"]], pairs[1][r["at"]]
        if alive[i] and alive[j]:
            error = max(error, abs(r["total"] / n - float(i == j)))

    def rows_out(batches):
        for batch in batches:
            x = matrix(batch.column(1), length)
            far = int(np.abs(x - mean).max(initial=0)) * n + n
            exact = np.int64 if length * far * far < 1 << 63 else object
            off = (x - mean).astype(exact) * exact(n) - rest.astype(exact) if exact is np.int64 else (x - mean).astype(object) * n - rest.astype(object)
            off = (off * off).sum(1)
            off = pa.array(off).cast(pa.decimal128(38, 0)) if exact is np.int64 else _decimals(off)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x) * k
            yield pa.RecordBatch.from_arrays([
                pc.take(batch.column(0), at), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(m, n)),
                pc.take(off, at), pa.array(whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(rows_out, schema)
