"""Activity kept by day, so that new, late and repeated loads touch only what they bring.

A table of ``activity`` rows in a shared folder, partitioned by day and load.  Adding a load writes the
partitions of its own days and reads nothing that is there; adding the same load again replaces them, so a
repeated delivery counts once.  Rows of one key from several loads are put together when days are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidemark.operators.cube import ACTIVITY_KEYS, activity
from tidemark.plans.profiles import Profile

_LOAD_NAME = re.compile(r"[A-Za-z0-9_.-]+")


class DailyActivity:
    """The activity of all loads so far, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, profile: Profile):
        self.spark, self.folder, self.profile = spark, folder.rstrip("/"), profile

    def add(self, events: DataFrame, load: str) -> None:
        """Write the activity of ``events`` under the load's name, in place of what that name had.

        Days that the load had before and has no longer are removed after the others are written.  A write that
        fails half way leaves a mixture of both until it is repeated.
        """
        if not _LOAD_NAME.fullmatch(load):
            raise ValueError(f"load name {load!r}: letters, digits, '_', '.' and '-' only")
        rows = activity(events, self.profile).withColumns({"day": F.col("ds").cast("date"), "load": F.lit(load)})
        before = self._days(load)  # none the first time
        # A partition by day, as rows of one day meet in few files; a busy day still has several.
        rows.repartition("day", F.pmod(F.xxhash64("visitor"), F.lit(8))).write.partitionBy("day", "load").mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.folder)
        if before:
            self._remove(load, before - self._written(events))

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Activity of the days ``first`` to ``last``; other days' files are not opened."""
        rows = self._rows()
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
        if last is not None:
            rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
        return rows.groupBy(*ACTIVITY_KEYS).agg(
            F.sum("n").alias("n"), F.min("first_time").alias("first_time"))

    def loads(self) -> DataFrame:
        """``load, day, n``: events of each load and day."""
        return self._rows().groupBy("load", "day").agg(F.sum("n").alias("n"))

    def _rows(self) -> DataFrame:
        text = S.StringType()
        schema = S.StructType([
            *[S.StructField(c, S.TimestampNTZType() if c == "ds" else text) for c in ACTIVITY_KEYS],
            S.StructField("n", S.LongType()), S.StructField("first_time", S.TimestampNTZType()),
            S.StructField("day", S.DateType()), S.StructField("load", text)])
        return self.spark.read.schema(schema).parquet(self.folder)

    def _written(self, events: DataFrame) -> set[str]:
        """Days of a load, from the times of its events alone (at most one name a day)."""
        day = F.col(self.profile.time).cast("date").alias("day")
        return {str(r["day"]) for r in events.select(day).where("day IS NOT NULL").distinct().collect()}

    def _system(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(context._jsc.hadoopConfiguration()), path

    def _days(self, load: str) -> set[str]:
        """Days that a load has, by the names of the folders."""
        system, path = self._system()
        found = system.globStatus(path(f"{self.folder}/day=*/load={load}"))
        return {f.getPath().getParent().getName().removeprefix("day=") for f in found or []}

    def _remove(self, load: str, days: set[str]) -> None:
        system, path = self._system()
        for day in sorted(days):
            system.delete(path(f"{self.folder}/day={day}/load={load}"), True)
