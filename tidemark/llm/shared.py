"""What the operators of this package share: work tables, stable row keys, folds, bounded samples."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local master (tests) gets a folder of its own and any other raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-llm-")
    return f"{folder.rstrip('/')}/tidemark-llm-{uuid.uuid4().hex}"


class Work:
    """Intermediate tables as Parquet; a lost executor then costs no more than the current step."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, work_folder(spark)
        _open.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the tables; DataFrames that read them end here."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


_open: list[Work] = []


@contextlib.contextmanager
def closing() -> Iterator[None]:
    """Work tables that operators write inside are removed at the end; read no result of theirs after it."""
    before = len(_open)
    try:
        yield
    finally:
        for work in _open[before:]:
            work.close()
        del _open[before:]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``, and so the same in every run."""
    share = min(1.0, rows / max(1, df.count()))
    return df if share == 1 else df.filter(F.xxhash64(F.lit("bounded"), key) < int((share - 0.5) * 2.0**64))


def packed(df: DataFrame) -> DataFrame:
    """The row as one column ``row``, so that no other column of it can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
