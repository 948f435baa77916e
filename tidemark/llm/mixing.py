"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

* Sizes are words.  Sources weigh 5, 2, 1 in turn and share the words of all; a target stops at
  three times its source's words, and what is over is shared again by weight.
* The documents of a source are put in a random order (hash of the id) and laid end to end; this
  line of words is cut into blocks of ``block_words``.
* Slot ``i`` of the schedule has the golden-ratio point ``frac(i * 0.618...)``; the source in whose
  part of the cumulative target shares the point falls provides the slot.  The slots of a source
  are ranked, and rank ``r`` takes its words ``[r * block, (r + 1) * block)``, starting over at the
  end.  A source stops at its target, and what the points leave short is added at the end, so
  every source is taken to its target rounded down, and no word more than three times.

Ranks and running sums are taken in chunks first and over chunks then, so that a source with most
of the rows is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Work, packed

WEIGHTS, MOST, BLOCK_WORDS = (5, 2, 1), 3, 256
#: Rows of a chunk, about.
CHUNK_ROWS = 16_384
#: Share of a source's target that whole rows may be off.
SLACK = 0.125
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every row."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, weights: Sequence[float], work: Work) -> DataFrame:
    """``source, source_size, target, place``; place counts the sources by code point, null last, from 0."""
    per = work.keep(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "per_source")
    # Places of any number of sources: ranges by task, then the rows before each range.
    parts = work.keep(
        per.repartitionByRange(16, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = parts.join(F.broadcast(before), "part").withColumn(  # at most 16 rows
        "place", F.coalesce("before", F.lit(0)) + F.row_number().over(
            Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = work.keep(placed.select("source", "source_size", "place", weight.alias("weight")), "placed")
    # The level of words for each unit of weight rises until no further source is full; sums only reach the driver.
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        is_full = F.col("weight") * level >= MOST * F.col("source_size")
        s = placed.agg(F.count(F.when(is_full, 1)), F.sum(F.when(is_full, MOST * F.col("source_size"))),
                       F.sum(F.when(~is_full, F.col("weight")))).first()
        if s[0] == full or not s[2]:
            break
        full, level = s[0], (total - (s[1] or 0)) / s[2]
    return placed.select("source", "source_size", "place", F.least(
        F.lit(level) * F.col("weight"), (MOST * F.col("source_size")).cast("double")).alias("target"))


def _running(rows: DataFrame, chunk: str, value: str, order: list, name: str, groups: tuple = ("source",)) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, by chunk and then by ``order``."""
    whole = rows.groupBy(*groups, chunk).agg(F.sum(value).alias("in_chunk"))
    whole = whole.withColumn("base", F.coalesce(F.sum("in_chunk").over(
        Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_chunk")
    inside = F.coalesce(F.sum(value).over(
        Window.partitionBy(*groups, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(whole, [*groups, chunk]).withColumn(
        name, F.col("base") + F.col("inside")).drop("base", "inside")


def schedule(goal: DataFrame, block_words: int, work: Work) -> DataFrame:
    """``slot, place, rank, words`` of every slot; ``words`` is short of a block only in a source's last one."""
    spark = goal.sparkSession
    quota = goal.filter("target >= 1").select(
        "place", "source_size", F.floor("target").alias("quota"), F.col("target"))
    total = quota.agg(F.sum("target")).first()[0] or 0.0
    slots = math.ceil(total / block_words)
    # Parts of [0, 1): each source is listed in the cells that its part meets, so a point meets few sources.
    cells = max(1, int(quota.count()))
    width = Window.partitionBy("wing").orderBy("place")
    wings = quota.withColumn("wing", F.floor(F.col("place") / 4096))
    base = wings.groupBy("wing").agg(F.sum("target").alias("sum")).withColumn(
        "base", F.coalesce(F.sum("sum").over(Window.orderBy("wing").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    parts = wings.join(base, "wing").withColumn("high", (F.col("base") + F.sum("target").over(width)) / F.lit(total or 1.0)).withColumn(
        "low", F.col("high") - F.col("target") / F.lit(total or 1.0))
    parts = parts.withColumn("cell", F.explode(F.sequence(
        F.greatest(F.floor(F.col("low") * cells), F.lit(0)), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    parts = work.keep(parts.select("place", "quota", "low", "high", "cell"), "parts")
    golden = (math.sqrt(5) - 1) / 2
    # Whole turns are taken off in integers, so the points stay even for any number of slots.
    turn = int(golden * 2**40)
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (F.pmod(F.pmod("id", F.lit(2**20)) * turn + F.pmod(
            F.floor(F.col("id") / 2**20) * F.lit((turn << 20) % 2**40), F.lit(2**40)), F.lit(2**40)) / F.lit(float(2**40))).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    drawn = points.join(parts, "cell").filter("point >= low and point < high").select(
        "slot", "place", F.floor(F.col("slot") / CHUNK_ROWS).alias("chunk"), F.lit(1).alias("one"))
    drawn = _running(drawn, "chunk", "one", ["slot"], "rank", ("place",)).select("slot", "place", "rank")
    drawn = work.keep(drawn, "drawn")
    need = quota.select("place", "quota", F.ceil(F.col("quota") / block_words).alias("need"))
    short = need.join(drawn.groupBy("place").agg(F.count(F.lit(1)).alias("have")), "place", "left").filter("coalesce(have, 0) < need")
    added = short.select("place", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("need") - 1)).alias("rank"))
    added = added.select((F.lit(slots) + F.col("rank")).alias("slot"), "place", "rank")
    return drawn.unionByName(added).join(need, "place").filter("rank < need").select(
        "slot", "place", "rank", F.least(F.lit(block_words), F.col("quota") - F.col("rank") * block_words).alias("words"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mixture and its plan.

    First ``doc_id, source, size, source_size, target, taken`` for every row, where ``taken`` counts
    the words that the mixture takes of it; second the pieces ``slot, doc_id, from, words`` in the
    order of the slots, of which the mixture consists.

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source of its
    own.  Rows that agree in all of id, source and size share what is taken evenly.  An empty table gives no
    rows.
    """
    work = Work(docs.sparkSession)
    rows = work.keep(sizes(docs), "sizes")
    goal = work.keep(targets(rows, weights, work), "targets")
    plan = schedule(goal, block_words, work)
    # Equal rows are one document of so many copies, whose words follow each other.
    found = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    found = work.keep(found.join(goal, found.source.eqNullSafe(goal.source)).drop(goal.source), "found")
    chunks = max(1, math.ceil(found.count() / CHUNK_ROWS))
    line = found.filter("size > 0").select(
        "doc_id", "size", "copies", "place", "source_size", (F.col("size") * F.col("copies")).alias("length"),
        F.xxhash64(F.lit("mix"), "doc_id", "size").alias("order"))
    line = line.withColumn("chunk", F.pmod(F.shiftright("order", 32), F.lit(chunks)))
    line = _running(line, "chunk", "length", ["order", "doc_id", "size"], "start", ("place",))
    # Where rank r takes from: words [r * block, r * block + words) of the line repeated; by block of the line.
    blocks = line.withColumn("end", F.col("start") + F.col("length")).withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
    at = F.col("rank") * block_words
    cuts = plan.join(goal.select("place", "source_size"), "place").select("slot", "place", "words", F.pmod(at, F.col("source_size")).alias("low"))
    # A slot meets two blocks of the line or, at its end, starts over, more often where the line is shorter than a slot.
    lap = F.col("source_size")
    source = goal.select("place", "source_size")
    cuts = cuts.join(source, "place").withColumn("high", F.col("low") + F.col("words")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("high") - 1) / lap))))
    cuts = cuts.select("slot", "place", "turn", F.greatest(F.lit(0), F.col("low") - F.col("turn") * lap).alias("low"),
                       F.least(lap, F.col("high") - F.col("turn") * lap).alias("high")).filter("low < high")
    cuts = cuts.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words))))
    low = F.greatest("start", "low", F.col("block") * block_words)
    high = F.least("end", "high", (F.col("block") + 1) * block_words)
    pieces = cuts.join(blocks, ["place", "block"]).select(
        "slot", "doc_id", "place", "size", (low - F.col("start")).alias("from"), (high - low).alias("words")).filter("words > 0")
    pieces = work.keep(pieces, "pieces")
    taken = pieces.groupBy("doc_id", "place", "size").agg(F.sum("words").alias("all_taken"))
    given = found.join(taken, found.doc_id.eqNullSafe(taken.doc_id) & (found.place == taken.place) & (found.size == taken.size), "left").select(
        found.doc_id, "source", found.size, "source_size", "target", found.place, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        "copies", F.coalesce("all_taken", F.lit(0)).alias("all_taken"))
    share = F.floor(F.col("all_taken") / F.col("copies")) + (F.col("copy") <= F.col("all_taken") % F.col("copies")).cast("long")
    return (given.select("doc_id", "source", "size", "source_size", "target", share.alias("taken")),
            pieces.select("slot", "doc_id", "from", "words"))


def _rounded(groups: DataFrame, work: Work) -> DataFrame:
    """``group, more, cut``: whole rows to add or take off, and words of a row that is cut, so that sources meet their targets.

    Of a source's line only the last row taken is in part.  Its words are made up by other whole rows
    that fit, or it is taken whole and others that fit are left out, whichever comes nearer; one row
    of each of the sizes ``2**(i / 16)`` is tried, the longest first.  If both are off by over
    ``SLACK`` of the target, the row itself is cut.
    """
    edge = groups.filter("part > 0").select(
        "home", F.col("group").alias("edge"), "part", (F.col("size") - F.col("part")).alias("over"), "target")
    edge = work.keep(edge, "edge")
    others = groups.select("home", "group", "size", "copies", "units").join(edge.select("home", "edge", "part", "over"), "home").filter(
        "group != edge")

    def fitting(rows, room, name):
        reps = rows.filter(F.col("size") <= F.col(room)).groupBy("home", room, F.floor(F.log2("size") * 16).alias("class")).agg(
            F.max(F.struct("size", "group")).alias("rep"))
        listed = reps.groupBy("home", room).agg(F.sort_array(F.collect_list("rep"), asc=False).alias("reps"))
        kind = "struct<rest:bigint,groups:array<bigint>>"
        fit = F.aggregate("reps", F.struct(F.col(room).alias("rest"), F.array().alias("groups")).cast(kind), lambda s, r: F.when(
            r["size"] <= s["rest"], F.struct((s["rest"] - r["size"]).alias("rest"), F.concat(s["groups"], F.array(r["group"])).alias("groups")).cast(kind)).otherwise(s))
        return listed.select("home", fit.alias(name))

    ways = (edge.join(fitting(others.filter(F.col("units") < MOST * F.col("copies")), "part", "added"), "home", "left")
            .join(fitting(others.filter("units > 0"), "over", "dropped"), "home", "left"))
    under, above = F.coalesce("added.rest", "part"), F.coalesce("dropped.rest", "over")
    none = F.array().cast("array<bigint>")

    def change(ids, more):
        return F.transform(F.coalesce(ids, none), lambda g: F.struct(
            g.alias("group"), F.lit(more).cast("bigint").alias("more"), F.lit(0).cast("bigint").alias("cut")))

    cut = F.array(F.struct(F.col("edge").alias("group"), F.lit(0).cast("bigint").alias("more"), F.col("part").alias("cut")))
    changes = F.when(F.least(under, above) > F.lit(SLACK) * F.col("target"), cut).when(
        above < under, F.concat(change(F.array("edge"), 1), change(F.col("dropped.groups"), -1))).otherwise(
        change(F.col("added.groups"), 1))
    return ways.select(F.explode(changes).alias("c")).select("c.*")


def mix_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes its words.

    What the mixture takes of a row in part is made up by whole rows of its source; where they leave
    the source further than ``SLACK`` from its target, as beside one long document, the row comes with
    its first words only.  Rows alike in id, source and size are told apart by their texts' hash.
    """
    work = Work(docs.sparkSession)
    taken, _ = mix(docs, weights, block_words)
    id_, source = F.col("doc_id"), F.col("source")
    group = F.xxhash64(id_.isNull(), id_, source.isNull(), source, "size")
    groups = taken.filter("size > 0").withColumn("group", group).withColumn("home", F.xxhash64(source.isNull(), source)).groupBy(
        "group", "home", "size", "target").agg(F.sum("taken").alias("words"), F.count(F.lit(1)).alias("copies"))
    groups = work.keep(groups.withColumn("units", F.expr("words div size")).withColumn("part", F.expr("words % size")), "groups")
    counts = groups.join(_rounded(groups, work), "group", "left").select(
        "group", "size", "copies", (F.col("units") + F.coalesce("more", F.lit(0))).alias("units"), F.coalesce("cut", F.lit(0)).alias("cut"))
    counts = work.keep(counts.filter("units > 0 or cut > 0"), "counts")
    text = F.col("row.text").cast("string")
    keys = packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"),
                               F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    rows = keys.select("row", group.alias("group")).join(counts, "group")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64(text))) - 1)
    extra = F.col("units") % F.col("copies")
    times = F.expr("units div copies") + (F.col("nth") < extra).cast("long")
    parts = F.when((F.col("cut") > 0) & (F.col("nth") == extra), F.array("cut")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("row", "size", F.explode(F.concat(F.array_repeat("size", times.cast("int")), parts)).alias("own"))
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("own").cast("int")), "")
    return rows.select(*[F.when(F.col("own") < F.col("size"), first).otherwise(F.col("row.text")).alias(c) if c == "text"
                         else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
