"""Language identification by error-correcting output codes.

Every learned language has a codeword; one binary classifier on hashed byte n-grams (1 to 3 bytes
of the text with A-Z lowered) is trained for each bit.  Decoding takes the codeword of the least
loss, each bit weighted by how well its classifier did in training.  A text whose two best
codewords are nearly as good is flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.shared import bounded

BUCKETS, ORDERS, SHARDS = 4096, (1, 2, 3), 8
#: At most about so many labelled rows are learned from, chosen by a hash of the id.
SAMPLE_ROWS = 8_000
STEPS, RATE, PENALTY = 150, 30.0, 1e-5
#: Texts whose best codeword is less likely than this, against the second best, are ambiguous.
MARGIN = 0.55
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """``n`` rows of +1 and -1, far from each other.

    Up to 6 rows: every split of the rows in two.  Beyond: rows of the Sylvester matrix of twice
    the order, without its constant column; any two differ in half the bits.
    """
    if n <= 6:
        bits = np.arange(1, max(2 ** (n - 1), 1))[None, :]
        return np.where(bits >> np.arange(n)[:, None] & 1, 1, -1)
    order = 1 << (2 * n - 1).bit_length()
    parity = np.array([[bin(i & j).count("1") & 1 for j in range(1, order)] for i in range(1, n + 1)])
    return np.where(parity, 1, -1)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the n-gram counts of each text, at unit length; zeros for an empty text."""
    data, n = LOWERED[data], len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * BUCKETS
    out = np.zeros(n * BUCKETS, np.float32)
    code, left = np.zeros(len(data), np.uint32), np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for k in range(1, max(ORDERS) + 1):
        code = code[:len(data) - k + 1] * np.uint32(256) + data[k - 1:] if len(data) >= k else code[:0]
        if k in ORDERS:
            inside = left[:len(code)] >= k
            h = (code[inside] + np.uint32(k << 24)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            bucket = (h * np.uint32(0x85EBCA77)) >> np.uint32(20)
            out += np.bincount(row[:len(code)][inside] + bucket, minlength=len(out)).astype(np.float32)
    out = np.sqrt(out).reshape(n, BUCKETS)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


LOWERED = T.LOWER.astype(np.uint32)


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """Vectors of 128 rows at a time."""
    for i in range(0, len(offsets) - 1, 128):
        part = offsets[i:i + 129]
        yield vectors(data[part[0]:part[-1]], part - part[0])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Model from rows ``doc_id, text, lang``; the rows of a null language, id or text teach nothing.

    Learners on SHARDS shards of the sample, averaged.  What reaches the driver is a number for
    each bit and bucket, whatever the input.
    """
    rows = bounded(labelled.filter("doc_id is not null and lang is not null and text is not null"), "doc_id", sample_rows)
    rows = rows.select("doc_id", "text", F.col("lang").cast("string"), F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard")).persist()
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # of a bounded sample
    codes = codewords(len(langs)) if langs else np.zeros((0, 0))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text", "lang"])
        x = np.concatenate(list(_blocks(*T.bytes_of(pa.array(frame.text, pa.string())))))
        y = codes[np.searchsorted(langs, frame.lang)]
        # Every language weighs the same.
        share = 1 / frame.groupby("lang").lang.transform("size").to_numpy()[:, None]
        share = share / share.sum()
        w, c = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1])
        for step in range(STEPS):
            pull = share * y / (1 + np.exp(np.clip(y * (x @ w + c), -35, 35)))
            w += (RATE * (x.T @ pull.astype(np.float32) - PENALTY * w)).astype(np.float32)
            c += pull.sum(0)
        right = (share * ((x @ w + c) * y > 0)).sum(0)
        table = np.concatenate([w.ravel(), c, right, [1.0]])
        return pd.DataFrame({"place": np.arange(len(table)), "value": table * len(frame)})

    bits = codes.shape[1]
    size = BUCKETS * bits + 2 * bits + 1
    total = np.zeros(size)
    if bits:
        found = (rows.groupBy("shard").applyInPandas(learn, "place long, value double")
                 .groupBy("place").agg(F.sum("value").alias("value")).toPandas())
        total[found.place] = found.value
        total /= total[-1]
    rows.unpersist()
    right = np.clip(total[-1 - bits:-1], 0.5, 1 - 1e-3)
    trust = np.log(right / (1 - right))
    return {"langs": langs, "codes": codes, "w": total[:BUCKETS * bits].reshape(BUCKETS, bits).astype(np.float32),
            "c": total[BUCKETS * bits:BUCKETS * bits + bits], "trust": trust / max(trust.sum(), 1e-9)}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the likeliest language of each vector, its share, and its share against the second best."""
    f = x @ model["w"] + model["c"]
    loss = np.log1p(np.exp(-np.clip(f[:, None, :] * model["codes"][None], -35, 35))) @ model["trust"]
    share = np.exp(-(loss - loss.min(1, keepdims=True)) * model["codes"].shape[1])
    best = loss.argmin(1)
    two = -np.sort(-share, axis=1)[:, :2] if share.shape[1] > 1 else np.pad(share, ((0, 0), (0, 1)))
    return best, 1 / share.sum(1), two[:, 0] / two.sum(1)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row of ``docs``.

    A null text, one without a letter, and every text where nothing was learned have ``und`` and
    score 0; one learned language has score 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            m, letters = shared.value, batch.column(2).to_numpy(zero_copy_only=False)
            if len(m["langs"]) > 1:
                parts = [decode(m, x) for x in _blocks(data, offsets)]
                best, score, margin = (np.concatenate(p) for p in zip(*parts))
            else:
                best, score, margin = np.zeros(len(letters), int), np.ones(len(letters)), np.ones(len(letters))
            known = letters & bool(m["langs"])
            langs = np.array([*m["langs"], UNKNOWN], object)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs[np.where(known, best, len(langs) - 1)], pa.string()),
                 pa.array(np.where(known, score, 0.0)), pa.array(~known | (margin < MARGIN))],
                ["doc_id", "lang_pred", "score", "ambiguous"])

    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), letters).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify_rows(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose text has a language: neither ``und`` nor ambiguous; all columns stay.

    A row is judged by its text alone, so a null id changes nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            m = shared.value
            if len(m["langs"]) > 1:
                batch = batch.filter(pa.array(np.concatenate([decode(m, x)[2] for x in _blocks(data, offsets)]) >= MARGIN))
            yield batch

    if not model["langs"]:
        return docs
    return docs.filter(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)
