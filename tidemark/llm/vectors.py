"""Integer forms of the usable vectors of a table, for operators that count exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Work


def finite(name: str = "embedding"):
    """Whether a vector is there, not empty, and finite in all components."""
    e = F.col(name).cast("array<double>")
    return e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def integers(vectors: DataFrame, scale: int, offset: int, limit: int, work: Work, name: str, *others: str) -> tuple[DataFrame, int]:
    """``vec_id, x`` and the columns ``others`` of the usable rows, and their length (0 for no rows).

    A component ``c`` becomes ``floor(scale * c) + offset``; vectors with one beyond ``limit`` in
    magnitude take no part.  All vectors are to have one length: of several, the most frequent
    counts (the longest of those), and rows of others take no part.
    """
    e = F.col("embedding").cast("array<double>")
    rows = vectors.filter(finite() & F.forall(e, lambda c: F.abs(c) < limit / scale)).select(
        F.col("vec_id").cast("long").alias("vec_id"), *[F.col(f"`{c}`") for c in others],
        F.transform(e, lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))
    rows = work.keep(rows, name)
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if not lengths:
        return rows, 0
    return rows.filter(F.size("x") == lengths[0]["length"]), lengths[0]["length"]


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
