"""Writers for KPI tables and reports, and the readers that take them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeparts import parse_time, stamp, truncate


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Arrays of text joined by ``|``, other nested values as JSON, times as text."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            column = F.array_join(column, "|")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        elif isinstance(kind, T.TimestampNTZType):
            column = stamp(column)
        out.append(column.alias(field.name))
    return df.select(*out)


def write_report_csv(df: DataFrame, path: str) -> None:
    flat_for_csv(df).write.mode("overwrite").option("header", True).csv(path)


def write_kpi_tables(tables: dict[tuple[str, str], DataFrame], folder: str) -> dict[tuple[str, str], str]:
    """One CSV folder per KPI and dimension: ``<folder>/<kpi>_<dim>``."""
    paths = {}
    for (kpi, dim), df in tables.items():
        paths[kpi, dim] = f"{folder.rstrip('/')}/{kpi}_{dim}"
        write_report_csv(df, paths[kpi, dim])
    return paths


def write_cube(cube: DataFrame, path: str) -> None:
    """Long KPI cube as Parquet, one folder per metric and dimension."""
    cube.write.mode("overwrite").partitionBy("metric", "dim").parquet(path)


def read_kpi_csv(spark: SparkSession, path: str, schema: T.StructType, time_column: str = "time") -> DataFrame:
    """KPI table from CSV with its time column typed and floored to the hour."""
    as_text = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == time_column else f.dataType)
        for f in schema
    ])
    raw = spark.read.schema(as_text).option("header", True).csv(path)
    return raw.withColumn(time_column, truncate(parse_time(F.col(time_column)), "1h"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
