"""Conflict-constrained best-fit packing of documents into training sequences.

A document of ``size`` words is cut into pieces of ``capacity`` words; whole pieces fill a bin each,
and the last piece, if shorter, is packed.  Bins carry two bitmaps, of the sources and of the
duplicate clusters they hold, and a piece fits only where it has room and neither its source nor its
cluster is present.  Pieces go by falling size into the fitting bin of the least room: bins are
ordered by residual, the search starts at the least sufficient one and goes on through its successors
until a bin is compatible; if none is, a bin is opened.

Rows are dealt by a hash of the id into shards of about ``SHARD_ROWS``, whatever their source or
cluster, and each shard is packed by itself, so a task holds a bounded number of short rows and the
conflicts of any source are spread evenly.  A shard leaves a few bins less full than one global order
would.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, SHARD_ROWS = 2048, 4096
WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins by residual, with bitmaps of what they hold."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.sources, self.clusters = capacity, [], [], []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; ``source`` and ``cluster`` are single bits, or 0 for none."""
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            room, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if room > size:
            insort(self.order, (room - size, number))
        return number, self.capacity - room


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value; 0 for null."""
    codes = pd.factorize(values, sort=True)[0]
    return [1 << c if c >= 0 else 0 for c in codes.tolist()]


def same_text() -> Column:
    """Cluster of the documents of one text, up to case and spaces; null for texts without words."""
    plain = F.trim(F.regexp_replace(F.lower(F.col("text").cast("string")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, source, size, piece, words, bin, place``: one row for each piece of every row of ``docs``.

    ``place`` counts the words of the bin before the piece.  ``cluster`` (by default ``same_text``) is
    null for rows in no duplicate cluster; a null source conflicts with none.  Rows of size 0 (null,
    empty and blank texts) take no room and have piece 0, no words, and a null bin and place.  Equal
    rows are packed each.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (same_text() if cluster is None else cluster).cast("string").alias("cluster"))
    shards = max(1, math.ceil(docs.count() / SHARD_ROWS))
    # Null ids are dealt by their other columns.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(
        F.coalesce(F.col("doc_id"), F.xxhash64("source", "size", "cluster"))), F.lit(shards)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(rest=frame["size"] % capacity).sort_values(
            ["rest", "size", "doc_id", "source", "cluster"], ascending=[False, False, True, True, True], kind="stable")
        bins, number, place = Bins(capacity), [], []
        for size, source, cluster_ in zip(frame.rest.tolist(), _bits(frame.source), _bits(frame.cluster)):
            a, b = bins.place(size, source, cluster_) if size else (None, None)
            number.append(a)
            place.append(b)
        out = frame.assign(number=pd.array(number, "Int64"), place=pd.array(place, "Int64"))
        wholes = out.loc[out.index.repeat(out["size"] // capacity)]
        wholes = wholes.assign(piece=wholes.groupby(level=0).cumcount(), words=capacity, place=pd.array([0] * len(wholes), "Int64"),
                               number=pd.array(range(len(bins.sources), len(bins.sources) + len(wholes)), "Int64"))
        rests = out[(out.rest > 0) | (out["size"] == 0)]
        rests = rests.assign(piece=rests["size"] // capacity, words=rests.rest)
        out = pd.concat([wholes, rests])
        out["bin"] = [None if n is pd.NA else f"{s}-{n}" for s, n in zip(out.shard, out.number)]
        return out[["doc_id", "source", "size", "piece", "words", "bin", "place"]]

    return rows.groupBy("shard").applyInPandas(
        run, "doc_id long, source string, size long, piece long, words long, bin string, place long")
