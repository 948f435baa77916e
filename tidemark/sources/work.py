"""Tables written between stages.

A long analysis is cut into written Parquet tables in the folder that the
cluster shares, so a lost executor never forces the raw events to be read
again, and the next stage plans with real file sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("name a work folder, or set spark.checkpoint.dir, to one that all executors share")
    return folder.rstrip("/")


class WorkTables:
    """Writes stage results below one fresh folder and reads them back.

    ``close``, or the end of a ``with`` block, removes the folder; DataFrames read from it end there.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = f"{(folder or shared_folder(spark)).rstrip('/')}/tidemark-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        df.write.mode("errorifexists").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

    def __enter__(self) -> WorkTables:
        return self

    def __exit__(self, *error) -> None:
        self.close()
