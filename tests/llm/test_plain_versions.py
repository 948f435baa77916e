"""Chunk dedup and best-fit packing against versions that go byte by byte and bin by bin."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunks, packing
from test_operators import ODD, rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_chunks(raw):
    """Bounds of the chunks, from a hash that is rolled over every byte."""
    out, start, h = [], 0, 0
    for i, b in enumerate(raw):
        h = (2 * h + int(chunks.GEAR[b])) % 65536
        long_enough = i + 1 - start >= chunks.LEAST
        if (long_enough and h >> (16 - chunks.BITS) == 0) or i + 1 - start == chunks.MOST or i + 1 == len(raw):
            out.append((start, i + 1))
            start = i + 1
    return out


def plain_dedup(texts):
    """``doc_id: (n_bytes, n_chunks, n_removed, n_spans, kept_sha256)`` of texts by rising id."""
    seen, out = set(), {}
    for i, text in texts:
        raw, runs = (text or "").encode(), []
        bounds = plain_chunks(raw)
        for a, b in bounds:
            if raw[a:b] not in seen:
                seen.add(raw[a:b])
            elif runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        runs = [r for r in runs if r[1] - r[0] >= chunks.RUN or r == [0, len(raw)]]
        kept, at = b"", 0
        for a, b in [*runs, [len(raw), len(raw)]]:
            kept, at = kept + raw[at:a], b
        out[i] = (len(raw), len(bounds), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return out


def test_chunks_agree_with_a_plain_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_dedup(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert {r.doc_id: tuple(r)[1:] for r in chunks.describe_chunks(docs).collect()} == want
    assert sum(w[2] > 0 for w in want.values()) > 20


def test_chunks_of_odd_rows(spark):
    """Null ids come last; equal rows are judged once and get the same runs; a long text repeats itself."""
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans) for r in chunks.describe_chunks(rows(spark, ODD)).collect())
    texts, seen = [], set()
    for i, t, _, _ in sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)):
        if (i, t) not in seen:
            seen.add((i, t))
            texts.append(((i, t), t))
    want = plain_dedup(texts)
    # The long text repeats with every 10 bytes, so all but its first chunks go.
    assert got == sorted(((i or 0), *(want[i, t][k] for k in (0, 2, 3))) for i, t, _, _ in ODD)
    assert dict((g[0], g[2]) for g in got)[6] > 290_000


def plain_best_fit(docs, capacity):
    """Piece by piece, all bins are looked at: the tightest one that is compatible, the oldest of equal ones."""
    rests, bins, out = [], [], {}
    for i, text, source in docs:
        size = len(WORD.findall(text or ""))
        if size % capacity:
            cluster = " ".join(WORD.findall(text.lower()))
            rests.append((-(size % capacity), -size, i, source, cluster))
    for rest, size, i, source, cluster in sorted(rests, key=lambda r: (r[0], r[1], r[2])):
        fitting = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= -rest and source not in b["sources"] and cluster not in b["clusters"]]
        if fitting:
            n = min(fitting)[1]
        else:
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
            n = len(bins) - 1
        out[i] = (n, capacity - bins[n]["room"], -rest)
        bins[n]["room"] += rest
        bins[n]["sources"] |= {source} - {None}
        bins[n]["clusters"].add(cluster)
    return out


@pytest.mark.parametrize("capacity", [2048, 300])
def test_packing_agrees_with_plain_best_fit(spark, capacity):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn(
        "source", F.when(F.col("doc_id") % 11 > 0, F.concat("source", (F.col("doc_id") % 7).cast("string"))))
    want = plain_best_fit([(r.doc_id, r.text, r.source) for r in docs.collect()], capacity)
    got = {r.doc_id: (int(r.bin.split("-")[1]), r.place, r.words) for r in packing.pack(docs, capacity=capacity).collect()
           if r.words and r.piece == r.size // capacity}
    assert got == want
