"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are hashes, in ``BUCKETS`` buckets, of a text's words and word pairs and of the n-grams of
its words' outlines (``features``), and a constant.  The labelled sample is dealt by a hash of
the id to ``SHARDS`` learners; each passes over its rows in the order of that hash, and their
weights are averaged.  A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.shared import bounded

BUCKETS, SHARDS = 1 << 18, 8
#: At most about so many labelled rows are learned from, chosen by a hash of the id.
SAMPLE_ROWS = 16_000
#: Learning rate, its smoothing, the two penalties, and passes over a shard.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 1e-4, 1e-4, 4

#: Kinds of bytes in an outline: small letters (and bytes beyond ASCII), capitals, digits; others are themselves.
OUTLINE = np.arange(256, dtype=np.uint8)
OUTLINE[97:123] = OUTLINE[128:] = ord("a")
OUTLINE[65:91] = ord("A")
OUTLINE[48:58] = ord("0")


def shapes(data: np.ndarray, starts: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each word's outline: runs of one kind of letter or sign count once, and a word that
    repeats the one before it has an outline of its own."""
    kind = OUTLINE[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    at = np.append(np.flatnonzero(new), len(data))
    cut = np.searchsorted(at, np.append(starts, len(data)))
    prefix = T.prefix_hashes(kind[at[:-1]])
    ends = cut[1:].copy()
    # The space after a word is the last kept byte before the next word.
    gap = T.SPACE[data[at[np.maximum(ends - 1, 0)]]] if len(starts) else np.zeros(0, bool)
    for _ in range(6):  # different spaces in a row
        ends = ends - gap
        gap = gap & T.SPACE[data[at[np.maximum(ends - 1, 0)]]] if len(starts) else gap
    out = T.substring_hashes(prefix, cut[:-1], ends)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = False
    return np.where(again, np.uint64(1), out)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text: square roots of the shares of its words and word pairs, and
    of the 1- to 3-grams of their outlines, and the constant 1 in bucket 0."""
    starts, ends, first = T.words(data, offsets)
    word = T.substring_hashes(T.prefix_hashes(data), starts, ends)
    outline = shapes(data, starts, word, first)
    grams = []
    for unit, k in ((word, 1), (word, 2), (outline, 1), (outline, 2), (outline, 3)):
        h = np.full(max(len(unit) - k + 1, 0), (unit is word) + 2 * k, np.uint64)
        for i in range(k):
            h = T.mix(h * np.uint64(T.BASE) + unit[i:i + len(h)])
        grams.append(((h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, k))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        at, value = [np.zeros(1, np.int64)], [np.ones(1)]
        for part in (grams[:2], grams[2:]):
            found, n = np.unique(np.concatenate([h[a:max(a, b - k + 1)] for h, k in part]), return_counts=True)
            at.append(found)
            value.append(np.sqrt(n / max(n.sum(), 1)))
        out.append((np.concatenate(at), np.concatenate(value)))
    return out


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Leader:
    """Follow the regularised leader, proximal form, one coordinate rate each."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (logistic(w @ value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from rows ``doc_id, text, label`` (0 or 1); without rows, all are 0.

    The model has BUCKETS numbers, whatever the input, and is all that reaches the driver.
    """
    rows = bounded(labelled.filter("doc_id is not null and label is not null"), "doc_id", sample_rows)
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard"), "doc_id", "text", "label")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(order=T.mix(frame.doc_id.to_numpy(np.int64).view(np.uint64)), text=frame.text.fillna(""))
        frame = frame.sort_values(["order", "text", "label"])
        data, offsets = T.bytes_of(pa.array(frame.text, pa.string()))
        found = []
        for i in range(0, len(frame), 256):  # features of some rows at a time
            part = offsets[i:i + 257]
            found += features(data[part[0]:part[-1]], part - part[0])
        model = Leader(BUCKETS)
        for _ in range(PASSES):
            for (at, value), label in zip(found, frame.label):
                model.learn(at, value, label)
        w = model.weights()
        at = np.append(np.flatnonzero(w), BUCKETS)  # the last row counts the learners
        return pd.DataFrame({"bucket": at, "weight": np.append(w, 1.0)[at]})

    found = (rows.groupBy("shard").applyInPandas(learn, "bucket long, weight double")
             .groupBy("bucket").agg(F.sum("weight").alias("weight")).toPandas().sort_values("bucket"))
    out = np.zeros(BUCKETS + 1)
    out[found.bucket] = found.weight
    return (out[:-1] / max(out[-1], 1)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts have the constant alone."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            w = model.value
            dots = [float(w[at] @ value) for at, value in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logistic(np.array(dots)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, learned, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from the labelled rows for which ``learned`` holds, and score every row of ``docs``.

    ``doc_id, score, predicted``; an empty table gives no rows, and without labels every score is 0.5.
    """
    # Drawn on ids alone and of SAMPLE_ROWS ids, so it can be broadcast and only its texts are read.
    # Of several labels of one id the commoner counts, label 1 if they are as many.
    one = (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    ids = bounded(one.filter(learned), "doc_id", sample_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    return score(docs, train(rows, sample_rows)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
