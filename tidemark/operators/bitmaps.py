"""Unique keys at several levels from one pass over exact, mergeable bitmaps.

Distinct counts do not add up from hours to days or from members to totals, so each level would scan and
shuffle the keys again.  A key's number within its shop is dense, so the keys of a cell are bits of words of
64, which ``or`` puts together at any level: cells, then grouping sets of them.  A cell has only the words that
its keys are in, so a table of many small cells takes no more rows than it has keys, and a word is a
number in the aggregates' buffers, which hash and spill; a level of many keys has up to 64 of them in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a bit's place in its word, numbers of a bucket's range, and keys that a bucket is to hold.
WORD_BITS, BITS, BUCKET_KEYS = 6, 32_768, 16_384
#: Least number of tasks that buckets are dealt to; a row there becomes one at every level.
LEAST_TASKS = 256


def numbered_keys(rows: DataFrame, key: str, by=("tenant",)) -> DataFrame:
    """``rows`` with ``number``, the same for all rows of a key and of no other key of its ``by``.

    Keys are dealt by a hash to buckets of about ``BUCKET_KEYS`` and ranked there, so numbers are half
    dense, and a task sorts buckets, never a whole shop.  Rows should be one for each key and cell (as
    ``key_cells`` makes them), for a key with many events to weigh no more than its cells.
    """
    by = list(by)
    sizes = rows.groupBy(*by).agg(
        F.ceil(F.approx_count_distinct(key) / BUCKET_KEYS).alias("buckets"))
    dealt = rows.join(sizes, by).withColumn(
        "bucket", F.pmod(F.xxhash64(key), F.greatest(F.col("buckets"), F.lit(1))))
    # A number of its own, for adaptive execution to leave: it would put buckets together by their small size on disk.
    tasks = max(LEAST_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(tasks, *by, "bucket")
    place = F.dense_rank().over(Window.partitionBy(*by, "bucket").orderBy(key)).cast("bigint") - 1
    # A bucket of more than BITS keys goes on behind all first parts, in a range of its own.
    ranked = dealt.withColumn("place", place)
    number = (F.col("bucket") + F.greatest(F.col("buckets"), F.lit(1)) * F.floor(F.col("place") / BITS)) * BITS + (
        F.col("place") % BITS)
    return ranked.withColumn("number", number.cast("bigint")).drop("bucket", "buckets", "place")


def key_cells(rows: DataFrame, key: str, cells) -> DataFrame:
    """One row for each key and cell; rows without a key count in none."""
    return rows.where(F.col(key).isNotNull()).select(*cells, key).distinct()


def cell_bitmaps(numbered: DataFrame, cells) -> DataFrame:
    """``cells + part + bits``: each row's key as a bit, ``part`` numbering the words.

    A task has all rows of a bucket's words, so ``roll_up`` puts them together where they are, and only
    what is left of each word of a level is shuffled.
    """
    number = F.col("number")
    return numbered.select(
        *cells, F.call_function("shiftright", number, F.lit(WORD_BITS)).alias("part"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (number % (1 << WORD_BITS)).cast("int")).alias("bits"))


def roll_up(bitmaps: DataFrame, columns, sets) -> DataFrame:
    """Unique keys ``n`` at each of the grouping sets (lists of ``columns``), with their ``level``.

    Words of a set and part are put together before the shuffle; what is left of each is counted.
    ``level`` is the number of the set, columns outside it are null.
    """
    names = list(columns)
    every = [[*s, "part"] for s in sets]
    merged = bitmaps.groupingSets([[F.col(c) for c in s] for s in every], *[F.col(c) for c in [*names, "part"]]).agg(
        F.bit_or("bits").alias("bits"), F.grouping_id().alias("gid"))
    width = len(names) + 1
    level: Column = F.lit(None)
    for i, s in enumerate(every):
        gid = sum(1 << (width - 1 - at) for at, c in enumerate([*names, "part"]) if c not in s)
        level = F.when(F.col("gid") == gid, i).otherwise(level)
    return merged.withColumn("level", level).groupBy(*names, "level").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n"))


def unique_levels(rows: DataFrame, key: str, columns, sets, by=("tenant",)) -> DataFrame:
    """``columns + level + n``: keys counted once in every cell of every grouping set."""
    cells = list(columns)
    numbered = numbered_keys(key_cells(rows, key, cells), key, by)
    return roll_up(cell_bitmaps(numbered, cells), cells, sets)
