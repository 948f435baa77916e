"""Substring dedup by content-defined chunks.

A gear hash of 16 bits rolls over the bytes: it doubles and adds a random number for the byte, so it
depends on the last 16 bytes only.  A chunk ends where its high bits are 0, not before ``LEAST`` bytes
and at ``MOST`` bytes, so an insertion shifts the chunks near it alone.  Chunks are compared by 128-bit
digests; of equal chunks the first (least id, then place) stays.  Equal chunks that follow each other
are removed where they make a run of ``RUN`` bytes or more, so chance phrases stay, or a whole text.
Of a copied passage the bytes before its first own cut and after its last one stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.shared import Work, packed

#: Bytes of a chunk at least and at most, bits that end one (2**-BITS of the places), bytes of a removed run.
LEAST, MOST, BITS, RUN = 16, 128, 4, 48

GEAR = T.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(T.BASE)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: the sum of the last 16 bytes' numbers, each doubled once a byte."""
    out = GEAR[data]
    for shift in (1, 2, 4, 8):
        out[shift:] += out[:-shift] << np.uint16(shift)
    return out


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, from its first byte."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        # Each text by itself, so that a chunk depends on its own text alone.
        cuts = (np.flatnonzero(gear_hashes(data[a:b]) >> np.uint16(16 - BITS) == 0) + 1).tolist()
        ends, start, i, n = [], 0, 0, b - a
        while start < n:
            while i < len(cuts) and cuts[i] < start + LEAST:
                i += 1
            end = min(cuts[i] if i < len(cuts) else n, start + MOST, n)
            ends.append(end)
            start = end
        out.append(ends)
    return out


def _chunks(docs: DataFrame) -> DataFrame:
    """``key, doc_id, low, high, d1, d2`` of every chunk of rows ``key, doc_id, text``."""

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            raw, row, low, high, digest = data.tobytes(), [], [], [], []
            for i, ends in enumerate(chunk_ends(data, offsets)):
                start, base = 0, int(offsets[i])
                for end in ends:
                    row.append(i)
                    low.append(start)
                    high.append(end)
                    digest.append(xxhash.xxh3_128_digest(raw[base + start:base + end]))
                    start = end
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                 pa.array(both[:, 0]), pa.array(both[:, 1])], ["key", "doc_id", "low", "high", "d1", "d2"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, low int, high int, d1 long, d2 long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``row`` (the whole input row) ``, runs``: sorted ``low, high`` byte places to remove.

    Null and empty texts have no chunks and no runs.  Rows of equal id and text are one text, which
    is judged once: they get the same runs.  A null id comes after all others.  An empty table gives no rows.
    """
    work = Work(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = F.lit(2**63 - 1)
    id_ = F.coalesce(F.col("doc_id").cast("long"), last)
    key = F.xxhash64(id_, text)
    chunks = _chunks(docs.select(key.alias("key"), id_.alias("doc_id"), text.alias("text")))
    seen = chunks.groupBy("d1", "d2").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1").select("d1", "d2", "first")
    seen = work.keep(seen, "seen")
    again = work.keep(chunks.join(seen, ["d1", "d2"]), "again")
    # Of the least id's chunks the first stays: the least key, and then place, among them.
    stays = again.filter("doc_id = first").groupBy("d1", "d2").agg(F.min("key").alias("key")).join(
        again.filter("doc_id = first"), ["d1", "d2", "key"]).groupBy("d1", "d2", "key").agg(F.min("low").alias("low"))
    gone = again.select("d1", "d2", "key", "low", "high").distinct().join(stays, ["d1", "d2", "key", "low"], "left_anti")
    # Chunks that touch are one run, which begins where no removed chunk ends; linear in the chunks of a text.
    in_text = Window.partitionBy("key").orderBy("low")
    begins = F.coalesce(F.lag("high").over(in_text) != F.col("low"), F.lit(True)).cast("int")
    run = F.sum("begins").over(in_text.rowsBetween(Window.unboundedPreceding, 0))
    runs = (gone.withColumn("begins", begins).withColumn("run", run)
            .groupBy("key", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .filter((F.col("low") == 0) | (F.col("high") - F.col("low") >= RUN))
            .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs")))
    row_text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    whole = packed(docs).withColumn("key", F.xxhash64(F.coalesce(F.col("row.doc_id").cast("long"), last), row_text))
    # A shorter run that begins a text is removed where it ends it too.
    long_or_whole = F.filter("runs", lambda r: (r["high"] - r["low"] >= RUN) | (r["high"] == F.octet_length(row_text)))
    return whole.join(runs, "key", "left").select("row", F.coalesce(
        long_or_whole, F.array().cast("array<struct<low:int,high:int>>")).alias("runs"))


def describe_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_chunks, n_removed, n_spans, kept_sha256`` of every row of ``docs``."""
    found = repeated_chunks(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "runs")

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            out = []
            for i, (runs, ends) in enumerate(zip(batch.column(2).to_pylist(), chunk_ends(data, offsets))):
                raw = data[offsets[i]:offsets[i + 1]].tobytes()
                kept = kept_bytes(raw, runs)
                out.append((len(raw), len(ends), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                ["doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_chunks long, n_removed long, n_spans long, kept_sha256 string")


def kept_bytes(raw: bytes, runs: list[dict]) -> bytes:
    """``raw`` without the runs."""
    edges = [0, *(x for r in runs for x in (r["low"], r["high"])), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated runs in ``text``; all rows and columns stay.

    Bytes left of a character that was cut are dropped too.
    """
    found = repeated_chunks(docs)
    raw = F.col("row.text").cast("string").cast("binary")
    parts = F.aggregate("runs", F.struct(F.lit(0).alias("at"), F.lit(b"").alias("kept")), lambda s, r: F.struct(
        r["high"].alias("at"), F.concat(s["kept"], F.substring(raw, s["at"] + 1, r["low"] - s["at"])).alias("kept")))
    kept = F.concat(parts["kept"], F.substring(raw, parts["at"] + 1, F.octet_length(raw)))
    text = F.when(F.size("runs") == 0, F.col("row.text").cast("string")).otherwise(
        F.regexp_replace(kept.cast("string"), "�", ""))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
