"""Removal of long repeated strings by a hash-compared suffix sort.

A byte is removed if it lies in a string of ``length`` bytes that also starts anywhere else, in
the same text or another; strings are judged on the input.

Strings meet through anchors: of the grams (half of ``length``) of every such string, those of the
least hash are anchors, so equal strings have equal anchors at equal places and every string has one
(about one byte in ``length / 4`` is an anchor).  An anchor's context is what strings through it
can reach.  Anchors are counted by (gram, context):

* a context found twice is repeated as a whole;
* other contexts of a gram that has several are sorted.  Their suffixes from the anchor onwards,
  and their prefixes read backwards, are put in order by a mergesort that compares two of them by
  binary search for the longest common extension on prefix polynomial hashes; neighbours' common
  extensions are checked byte by byte.  Two contexts share the string that begins ``d`` bytes
  before the anchor if they agree in ``d`` bytes before and ``length - d`` from the anchor on, which
  the sorted orders tell for all contexts of a gram and each ``d``;
* a gram with over ``GROUP`` contexts is not gathered in one task.  Its contexts are looked at as
  texts of their own, with longer grams (three quarters of ``length``), which tell most of them
  apart; for a long gram that still has over ``GROUP`` contexts the hashes of the strings are counted.

Rows are identified by ``doc_id`` and a hash of the text; rows alike in both are separate occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidemark.llm import text as T
from tidemark.llm.shared import Work, packed

#: Contexts of a gram that one task sorts; contexts sorted at once.
GROUP, SORTED_AT_ONCE = 16_384, 2_048


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), text)


def _least_in_window(values: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Least (or greatest) value of each ``width`` values in a row."""
    pad = np.uint64(0) if least is np.maximum else ~np.uint64(0)
    rows = np.full(-(-len(values) // width) * width, pad, np.uint64)
    rows[:len(values)] = values
    rows = rows.reshape(-1, width)
    left = least.accumulate(rows, axis=1).ravel()
    right = least.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(right[:len(values) - width + 1], left[width - 1:len(values)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, scope=None, origin=None):
    """Places of the anchors, their texts, grams, contexts and the bounds of the contexts.

    With ``scope`` and ``origin`` (of each text) only grams of one scope and place from the origin are equal.
    """
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none, None, None, None
    prefix = T.prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    hashes = T.substring_hashes(prefix, at, at + gram)
    least = _least_in_window(hashes, width)
    end = np.repeat(offsets[1:], np.diff(offsets))[:len(least)]
    least[np.arange(len(least)) + length > end] = 0
    # Place p is an anchor if it is the least of some string through it; width - 1 strings start before p.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    greatest = _least_in_window(padded, width, np.maximum)[:len(hashes)]
    place = np.flatnonzero((greatest == hashes) & (greatest > 0))
    text = np.searchsorted(offsets, place, "right") - 1
    low = np.maximum(offsets[text], place - (length - gram))
    high = np.minimum(offsets[text + 1], place + length)
    context = T.mix(T.substring_hashes(prefix, low, high) + (place - low).astype(np.uint64) * np.uint64(T.BASE))
    grams = hashes[place]
    if scope is not None:
        grams = T.mix(T.mix(grams + (place - offsets[text] - origin[text]).astype(np.uint64)) + scope.view(np.uint64)[text])
    return place, text, grams, context, low, high, prefix, hashes, least


def _scoped(batch: pa.RecordBatch) -> tuple:
    """Scope and origin of the rows, where they have them."""
    at = batch.schema.get_field_index("scope")
    return () if at < 0 else (batch.column(at).to_numpy(), batch.column(at + 1).to_numpy())


def _anchor_rows(docs: DataFrame, length: int, size: int) -> DataFrame:
    """``key, place, gram, context`` of every anchor of rows ``key, text`` and maybe ``scope, origin``."""

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            place, text, gram, context, *_ = anchors(data, offsets, length, size, *_scoped(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array((place - offsets[text]).astype(np.int32)),
                 pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["key", "place", "gram", "context"])

    return docs.mapInArrow(run, "key long, place int, gram long, context long")


def _contexts(docs: DataFrame, length: int, size: int, strings: bool) -> DataFrame:
    """The wanted contexts (arrays of gram and context in ``wanted``) of rows as for ``_anchor_rows``.

    Either ``gram, context, before, after`` (bytes before the anchor, and from it on), or, one row for
    each string through the anchor, ``gram, context, d, string`` (its hash).
    """
    reach = length - size

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            place, text, gram, context, low, high, prefix, hashes, least = anchors(data, offsets, length, size, *_scoped(batch))
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            lengths = np.diff(wanted.offsets.to_numpy())
            pairs = wanted.flatten()
            code = [T.mix(pairs.field(i).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(i)) for i in (0, 1)]
            listed = T.mix(code[0] * np.uint64(3) + code[1]) + np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
            here = T.mix(T.mix(gram) * np.uint64(3) + T.mix(context + np.uint64(1))) + text.astype(np.uint64)
            chosen = np.flatnonzero(np.isin(here, listed))
            # An equal context may stand in a text several times; once is enough.
            _, once = np.unique(here[chosen], return_index=True)
            chosen = chosen[once]
            place, gram, context, low, high = (x[chosen] for x in (place, gram, context, low, high))
            g, c = gram.view(np.int64), context.view(np.int64)
            if strings:
                for i in range(0, len(chosen), 1024):
                    s = slice(i, i + 1024)
                    start = place[s, None] - np.arange(reach + 1)[None]
                    inside = (start >= low[s, None]) & (start + length <= high[s, None])
                    # A string goes by its least gram alone, which depends on nothing but the string.
                    inside &= least[np.clip(start, 0, len(least) - 1)] == hashes[place[s]][:, None]
                    row, d = np.nonzero(inside)
                    start = start[row, d]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[s][row]), pa.array(c[s][row]), pa.array(d.astype(np.int32)),
                         pa.array(T.substring_hashes(prefix, start, start + length).view(np.int64))], ["gram", "context", "d", "string"])
            else:
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(c), pa.array([raw[a:b] for a, b in zip(low, place)], pa.binary()),
                     pa.array([raw[a:b] for a, b in zip(place, high)], pa.binary())], ["gram", "context", "before", "after"])

    shape = "d int, string long" if strings else "before binary, after binary"
    return docs.mapInArrow(run, f"gram long, context long, {shape}")


class Strings:
    """Byte strings with prefix hashes, for comparing and sorting."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.size = parts, np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        self.prefix = T.prefix_hashes(self.data)
        self.unshift = T.powers(T.INVERSE, len(self.prefix))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common beginnings, by binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        x, y = self.start[a], self.start[b]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = (self.prefix[x + mid] - self.prefix[x]) * self.unshift[x] == (self.prefix[y + mid] - self.prefix[y]) * self.unshift[y]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    def before(self, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether string ``a`` sorts before or equals ``b``: by group, and then by bytes."""
        out = group[a] < group[b]
        at = np.flatnonzero(group[a] == group[b])
        a, b = a[at], b[at]
        n = self.common(a, b)
        out[at] = (n == self.size[a]) | ((n < self.size[b]) & (self.data[self.start[a] + n] < self.data[np.minimum(self.start[b] + n, len(self.data) - 1)]))
        return out

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the strings by group and bytes: a mergesort, all merges of a level at once."""
        n, order, width = len(self.parts), np.arange(len(self.parts)), 1
        at = np.arange(n)
        while width < n:
            base = at // (2 * width) * (2 * width)
            left = at < base + width
            low = np.where(left, np.minimum(base + width, n), base)
            first, high = low.copy(), np.where(left, np.minimum(base + 2 * width, n), np.minimum(base + width, n))
            while (open_ := np.flatnonzero(low < high)).size:  # strings of the other run that go first
                mid = (low[open_] + high[open_]) // 2
                own, other, is_left = order[open_], order[mid], left[open_]
                goes = np.empty(len(open_), bool)  # in a tie the left run goes first
                goes[is_left] = ~self.before(own[is_left], other[is_left], group)
                goes[~is_left] = self.before(other[~is_left], own[~is_left], group)
                low[open_] = np.where(goes, mid + 1, low[open_])
                high[open_] = np.where(goes, high[open_], mid)
            rank = np.where(left, at, at - width) + (low - first)
            merged = np.empty(n, np.int64)
            merged[rank] = order
            order, width = merged, 2 * width
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common beginnings of each string with the one before it in the order, checked byte by byte."""
        n = np.concatenate([[0], self.common(order[:-1], order[1:])])
        n[1:][group[order[1:]] != group[order[:-1]]] = -1
        n[:1] = -1
        for i in np.flatnonzero(n > 0):
            x, y = self.parts[order[i - 1]], self.parts[order[i]]
            if x[:n[i]] != y[:n[i]]:  # equal hashes of different bytes
                n[i] = next(j for j in range(n[i]) if x[j] != y[j])
        return n


def repeated_contexts(group: np.ndarray, before: list[bytes], after: list[bytes], length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest ``d`` whose string each context shares with another of its group; -1 for none."""
    reach = length - size
    back, onward = Strings([b[::-1] for b in before]), Strings(after)
    least, most = np.full(len(group), -1), np.full(len(group), -1)
    orders = []
    for s in (back, onward):
        order = s.sort(group)
        orders.append((order, s.neighbours(order, group)))
    for d in range(reach + 1):
        sides = []
        for (order, near), depth in zip(orders, (d, length - d)):
            side = np.empty(len(order), np.int64)
            side[order] = np.cumsum(near < depth)
            sides.append(side)
        fits = np.flatnonzero((back.size >= d) & (onward.size >= length - d))
        code = sides[0][fits] * (len(group) + 1) + sides[1][fits]
        _, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
        found = fits[n[inverse] > 1]
        most[found] = d
        least[found] = np.where(least[found] < 0, d, least[found])
    return least, most


def _sorted(contexts: DataFrame, length: int, size: int) -> DataFrame:
    """``gram, context, least, most`` of the contexts that share a string with another of their gram."""

    def run(batches):
        def found(rows):
            gram, context = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            least, most = repeated_contexts(np.unique(gram, return_inverse=True)[1], [r[2] for r in rows], [r[3] for r in rows], length, size)
            at = np.flatnonzero(most >= 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(gram[at]), pa.array(context[at]), pa.array(least[at].astype(np.int32)), pa.array(most[at].astype(np.int32))],
                ["gram", "context", "least", "most"])

        held: list[tuple] = []
        for batch in batches:  # in the order of the grams
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= SORTED_AT_ONCE and row[0] != held[-1][0]:
                    yield found(held)
                    held = []
                if not held or row[:2] != held[-1][:2]:
                    held.append(row)
        if held:
            yield found(held)

    ordered = contexts.repartition("gram").sortWithinPartitions("gram", "context")
    return ordered.mapInArrow(run, "gram long, context long, least int, most int")


def _find(texts: DataFrame, length: int, size: int, work: Work, name: str) -> tuple[DataFrame, DataFrame]:
    """Anchors ``key, place, gram, context`` of the texts, and ``gram, context, low, high``: parts of the
    repeated contexts, from the anchor's place, that are covered by repeated strings."""
    reach = length - size
    rows = _anchor_rows(texts, length, size)
    counted = rows.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    counted = counted.withColumn("contexts", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter("n > 1 or contexts > 1")
    classes = work.keep(counted, f"{name}_contexts")

    wanted = classes.filter("contexts > 1").groupBy("key").agg(
        F.collect_list(F.when(F.col("contexts") <= GROUP, F.struct("gram", "context"))).alias("small"),
        F.collect_list(F.when(F.col("contexts") > GROUP, F.struct("gram", "context"))).alias("large"))
    wanted = work.keep(texts.join(wanted, "key"), f"{name}_wanted")
    small = _sorted(_contexts(wanted.filter("size(small) > 0").withColumnRenamed("small", "wanted").drop("large"), length, size, False), length, size)
    large = wanted.filter("size(large) > 0").withColumnRenamed("large", "wanted").drop("small")
    by_d = ["gram", "context", (-F.col("most")).alias("low"), (F.lit(length) - F.col("least")).alias("high")]
    if size < 3 * length // 4:
        # Rows of several keys alike would count one context twice.
        large = work.keep(_contexts(large, length, size, False).dropDuplicates(["gram", "context"]).select(
            "gram", "context", F.xxhash64("gram", "context").alias("key"), F.concat("before", "after").alias("text"),
            F.col("gram").alias("scope"), F.octet_length("before").cast("long").alias("origin")), f"{name}_large")
        inner, parts = _find(large.select("key", "text", "scope", "origin"), length, 3 * length // 4, work, f"{name}_long")
        # All these strings hold the gram at the origin, so together they are one part of the context.
        inside = inner.join(parts, ["gram", "context"]).groupBy("key").agg(
            F.min(F.col("place") + F.col("low")).alias("low"), F.max(F.col("place") + F.col("high")).alias("high"))
        large = large.join(inside, "key").select(
            "gram", "context", (F.greatest(F.lit(0), "low") - F.col("origin")).cast("int").alias("low"),
            (F.least(F.octet_length("text"), "high") - F.col("origin")).cast("int").alias("high"))
    else:
        # The same place of the same gram: a string meets itself at other anchors only.
        strings = work.keep(_contexts(large, length, size, True).distinct(), f"{name}_strings")
        place = ["gram", "d", "string"]
        twice = strings.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*place)
        large = strings.join(twice, place).groupBy("gram", "context").agg(F.min("d").alias("least"), F.max("d").alias("most")).select(*by_d)
    # A context found twice reaches from its beginning to its end, which may be those of the text.
    whole = classes.filter("n > 1").select("gram", "context", F.lit(-reach).alias("low"), F.lit(length).alias("high"))
    return rows, work.keep(small.select(*by_d).unionByName(large).unionByName(whole), f"{name}_found")


def repeat_spans(docs: DataFrame, length: int, work: Work) -> DataFrame:
    """``key, spans`` of the rows (``key, text``) with repeats: places and ends of runs through anchors."""
    rows, found = _find(docs, length, max(1, length // 2), work, "whole")
    covered = rows.join(found, ["gram", "context"]).select(
        "key", F.greatest(F.lit(0), F.col("place") + F.col("low")).alias("low"), (F.col("place") + F.col("high")).alias("high"))
    return covered.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def _runs(spans: list, n_bytes: int) -> list[tuple[int, int]]:
    """The covered parts of a text, joined where they touch."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], min(s["high"], n_bytes)) for s in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def find_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``row`` (the whole input row) ``, runs`` (array of ``low, high`` byte places to remove).

    Null and short texts have no runs; neither has a row whose text has none.  An empty table gives
    no rows.  Columns of any name may be there besides ``doc_id`` and ``text``.
    """
    work = Work(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(_key(F.col("doc_id"), text).alias("key"), text.alias("text"))
    spans = work.keep(repeat_spans(rows, length, work), "spans")
    whole = packed(docs).withColumn("key", _key(F.col("row.doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    return whole.join(spans, "key", "left").drop("key")


def describe_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, text`` of every row of ``docs``.

    ``kept_sha256`` is of the remaining bytes; ``text`` is what they spell, without what is left of a
    character that was cut, and null where it was null.
    """
    found = find_repeats(docs.select("doc_id", "text"), length).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "spans")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                runs = _runs(spans or [], len(raw))
                kept = _kept(raw, runs)
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore") if runs else text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return raw
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; all rows and columns stay.

    Bytes left of a character that was cut are dropped too.
    """
    found = find_repeats(docs, length)

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                out.append(_kept(raw, _runs(spans, len(raw))).decode("utf-8", "ignore") if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], ["text", "row"])

    row = found.schema["row"].dataType
    done = found.select(F.col("row.text").cast("string").alias("text"), "spans", "row").mapInArrow(
        run, S.StructType([S.StructField("text", S.StringType()), S.StructField("row", row)]))
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
