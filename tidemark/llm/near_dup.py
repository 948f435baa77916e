"""Near-duplicate documents by SetSketch registers.

A document's set are the distinct hashes of its k-word shingles.  Register i of its sketch is
``floor(1 - log_b(h))`` for the least ``h`` of exponentially distributed hashes of the set's
members, cut to ``0 .. LEVELS``.  Registers of a union are the greater of both, and two sketches
agree in a register with a probability close to the sets' similarity.

1. Documents of equal sets form a class (digest of the whole set), so copies cost nothing more.
2. Each band of ``ROWS`` registers is a bucket key.  Every member of a bucket is paired with the
   bucket's least id; the pairs that stay after the joint likelihood are confirmed on whole sets.
3. In buckets whose members are still in different components, every pair across components is
   compared by registers, block against block, inside tasks, and by an exact bound on the members
   in common; the pairs that pass are confirmed as well.  So no pair that shares a bucket is left out, and no list of all pairs is made.

A pair at the threshold 0.8 shares no bucket with probability 5e-5, at 0.85 with 4e-7; that and a
joint estimate over 5 standard deviations too low are the only ways to miss a link.
Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.graph import components
from tidemark.llm.shared import Work, packed

REGISTERS, ROWS = 128, 5
BANDS = REGISTERS // ROWS
#: Base of the registers, rate of the exponential distribution and greatest level.
B, RATE, LEVELS = 1.02, 20.0, 4096
#: Members of a bucket that are compared with another block at once.
BLOCK = 512
#: Similarities below the threshold by so many standard deviations of the estimate are dismissed.
SIGMAS = 5
#: Members are counted in so many cells; sets differ in at least as many members as their counts do.
CELLS = 512


def _odd(n: int) -> np.ndarray:
    return T.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(T.BASE)) | np.uint64(1)


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set of 64-bit hashes."""
    factors, least = _odd(REGISTERS)[:, None], np.full(REGISTERS, ~np.uint64(0))
    for i in range(0, len(members), 2048):
        least = np.minimum(least, (factors * members[None, i:i + 2048]).min(axis=1))
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-52)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(B)), 0, LEVELS).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity of each pair of sketches (rows), given the sizes of the sets."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = REGISTERS - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 65)[None, :] * np.minimum(u / v, v / u)

    def chance(x):
        return -np.log1p(-np.clip(x, 1e-9, 1) * (B - 1) / B) / np.log(B)

    p, q = chance(u - v * j), chance(v - u * j)
    likelihood = above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-9))
    return j[np.arange(len(j)), likelihood.argmax(1)]


def plausible(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose estimate is not far below it."""
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    out = np.zeros(len(fits), bool)
    at = np.flatnonzero(fits)
    for i in range(0, len(at), 4096):
        s = at[i:i + 4096]
        out[s] = joint_estimate(a[s], b[s], n_a[s].astype(float), n_b[s].astype(float)) >= _least(percent)
    return out


def _least(percent: int) -> float:
    """The lowest estimate that is confirmed on whole sets."""
    t = percent / 100
    return t - SIGMAS * (t * (1 - t) / REGISTERS) ** 0.5


def _rows(column: pa.Array) -> np.ndarray:
    """Registers of a binary column as one matrix."""
    data, _ = _binary(column)
    return data.view("<u2").reshape(-1, REGISTERS)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if len(column) else np.zeros(0, np.uint8), offsets - offsets[0]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` (digest of the set) ``, regs`` of every row."""
    schema = "doc_id long, n_shingles long, d1 long, d2 long, regs binary"

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            n, d1, d2, regs = [], [], [], []
            for members in T.shingle_sets(data, offsets, k):
                n.append(len(members))
                d1.append(int(members.sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int((T.mix(members) * members).sum(dtype=np.uint64).astype(np.int64)))
                regs.append(registers(members).tobytes() if len(members) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "regs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """``id, members`` (sorted hashes) ``, counts`` (of the members in each cell) of rows ``id, d1, d2, text`` whose set has that digest."""

    def run(batches):
        for batch, data, offsets in T.slices(batches):
            d1, d2, ids, out, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), [], [], []
            for i, members in enumerate(T.shingle_sets(data, offsets, k)):
                if (int(members.sum(dtype=np.uint64).astype(np.int64)) == d1[i]
                        and int((T.mix(members) * members).sum(dtype=np.uint64).astype(np.int64)) == d2[i]):
                    ids.append(batch.column(0)[i].as_py())
                    out.append(members.tobytes())
                    counts.append(np.minimum(np.bincount((members % np.uint64(CELLS)).astype(int), minlength=CELLS), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(counts, pa.binary())],
                                             ["id", "members", "counts"])

    return docs.select("id", "d1", "d2", "text").mapInArrow(run, "id long, members binary, counts binary")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The plausible ones of pairs ``a, b``."""

    def side(x):
        return classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                keep = plausible(_rows(t.column(4)), _rows(t.column(5)), t.column(2).to_numpy(), t.column(3).to_numpy(), percent)
                yield t.select(["a", "b"]).filter(pa.array(keep))

    sized = (pairs.join(side("a"), "a").join(side("b"), "b")
             .filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    return sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the threshold."""

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(x):
        return sets.select(F.col("id").alias(x), F.col("members").alias(f"members_{x}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "members_a", "members_b").mapInArrow(
        run, "a long, b long")


def _across(mixed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of different components that share a bucket: rows ``key, id, component``.

    A component with over BLOCK members of a bucket has blocks of its own, the others share
    blocks; two blocks that hold the same one component are not compared.
    """
    per = mixed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    pool = per.groupBy("key").agg(F.sum(F.when(F.col("size") <= BLOCK, F.col("size")).otherwise(0)).alias("pool"))
    per = per.filter(F.col("size") > BLOCK)
    placed = (
        mixed.join(pool, "key").join(per, ["key", "component"], "left")
        .withColumn("part", F.when(F.col("size").isNull(), F.pmod(F.xxhash64("component"), F.ceil(F.col("pool") / BLOCK)))
                    .otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))))
        .withColumn("home", F.when(F.col("size").isNull(), F.lit(-1)).otherwise(F.col("component")))
        .join(classes.select("id", "n", "regs"), "id").join(sets.select("id", "counts").dropDuplicates(["id"]), "id"))
    blocks = placed.groupBy("key", "home", "part").agg(
        F.collect_list(F.struct("id", "component", "n", "regs", "counts")).alias("m"),
        F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = blocks.withColumn("block", F.struct("home", "part"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block"))
                   & ((F.col("x.low") != F.col("y.high")) | (F.col("x.high") != F.col("y.low"))))

    def run(batches):
        for t in batches:
            for i in range(t.num_rows):
                left, right = (t.column(c).slice(i, 1).flatten() for c in (0, 1))
                (id_a, c_a, n_a), (id_b, c_b, n_b) = ([s.field(f).to_numpy() for f in ("id", "component", "n")] for s in (left, right))
                regs_a, regs_b = _rows(left.field("regs")), _rows(right.field("regs"))
                cells_a, cells_b = (_binary(s.field("counts"))[0].reshape(-1, CELLS).astype(np.int16) for s in (left, right))
                out = []
                for p in range(len(id_a)):
                    near = np.flatnonzero(
                        (c_b != c_a[p]) & (100 * np.minimum(n_b, n_a[p]) >= percent * np.maximum(n_b, n_a[p])))
                    # Registers agree at least as often as members do, so this dismisses none that the estimate keeps.
                    near = near[(regs_b[near] == regs_a[p]).sum(1) >= REGISTERS * _least(percent)]
                    apart = np.abs(cells_b[near] - cells_a[p]).sum(1, dtype=np.int64)
                    both = (n_b[near] + n_a[p] - apart) // 2  # members in common, at most
                    near = near[100 * both >= percent * (n_b[near] + n_a[p] - both)]
                    if len(near):
                        q = near[plausible(np.broadcast_to(regs_a[p], (len(near), REGISTERS)), regs_b[near],
                                           np.full(len(near), n_a[p]), n_b[near], percent)]
                        out += [(min(id_a[p], id_b[x]), max(id_a[p], id_b[x])) for x in q]
                out = np.array(out, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return pairs.select(F.col("x.m").alias("x"), F.col("y.m").alias("y")).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two ids are linked if ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the least id reachable, and ``kept`` marks that id's rows.  Null, empty
    and blank texts have an empty set and are linked with nothing.  Rows of a null id keep a null
    component and are kept.  Rows that repeat an id are one vertex.  An empty table gives no rows.
    """
    work = Work(docs.sparkSession)
    every = work.keep(sketches(docs, k), "sketches")
    some = every.filter("n_shingles > 0 and doc_id is not null")
    classes = work.keep(
        some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")),
        "classes")
    keys = [F.xxhash64(F.lit(j), F.substring("regs", 2 * ROWS * j + 1, 2 * ROWS)) for j in range(BANDS)]
    bands = classes.select("id", F.explode(F.array(*keys)).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    members = work.keep(bands.join(buckets.select("key", "least"), "key"), "members")

    wanted = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    wanted = wanted.join(classes.select("id", "d1", "d2"), "id")
    sets = work.keep(_whole_sets(texts.join(wanted, "id"), k), "sets")

    stars = members.filter("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    stars = _confirmed(_estimated(stars, classes, percent), sets, percent)
    # Ids whose rows differ belong to several classes; members of a class belong to its id.
    owned = some.join(classes.select("d1", "d2", "id"), ["d1", "d2"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    edges = work.keep(stars.unionByName(owned.filter("a != b").distinct()), "stars")
    first = components(edges, work, "first")

    placed = members.select("key", "id").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    mixed = work.keep(placed.join(mixed.select("key"), "key"), "mixed")
    across = _confirmed(_across(mixed, classes, sets, percent), sets, percent)
    joined = (across.join(first.select(F.col("id").alias("a"), F.col("component").alias("c")), "a", "left")
              .join(first.select(F.col("id").alias("b"), F.col("component").alias("d")), "b", "left")
              .select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b")).distinct())
    second = components(joined, work, "second").select(F.col("id").alias("component"), F.col("component").alias("top"))
    # Every component of the first round is the least of its ids, so the second round's least is the least of all.
    final = (first.join(second, "component", "left").select("id", F.coalesce("top", "component").alias("component_id"))
             .unionByName(second.join(first, "component", "left_anti").select(F.col("component").alias("id"), F.col("top").alias("component_id")))
             .withColumnRenamed("id", "doc_id"))
    return (
        every.select("doc_id", "n_shingles").join(final, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with all their columns, of each component only one text of its least id.

    Of rows that share id and text one stays.  Rows that share an id but not the text are documents of
    their own: the one of the least text hash counts by the id, the others come after all ids, in an order of
    hashes, so a text goes only where a near duplicate of it stays.  Rows of a null id all stay.  An empty
    table gives no rows.
    """
    work = Work(docs.sparkSession)
    numbered = packed(docs.filter("doc_id is not null")).select(
        "row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("hash"))
    texts = numbered.groupBy("id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).filter("least < most")
    texts = work.keep(texts.select("id", "least"), "repeated")
    if texts.isEmpty():
        keyed = numbered.withColumn("key", F.col("id"))
    else:
        later = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("id", "hash"), 2)
        keyed = numbered.join(texts, "id", "left").withColumn(
            "key", F.when(F.col("least").isNull() | (F.col("hash") == F.col("least")), F.col("id")).otherwise(later))
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), k, percent)
    found = found.filter("kept").select(F.col("doc_id").alias("key")).distinct()
    rows = keyed.join(found, "key", "left_semi").dropDuplicates(["key"])
    return rows.select("row.*").unionByName(docs.filter("doc_id is null"))
