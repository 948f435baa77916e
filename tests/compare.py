"""Run a registered query on Spark and its SQL on DuckDB and compare rows.

``python tests/compare.py <sf_dir> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, sf_dir: str, build, text: str) -> tuple[bool, str]:
    found = build(spark, sf_dir)
    mine = rows_of(found.columns, found.collect())
    result = db.execute(text)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(found.columns) != sorted(names):
        return False, f"columns {sorted(set(found.columns) ^ set(names))}"
    if mine == theirs:
        return True, f"{len(mine)} rows"
    only_mine, only_theirs = set(mine) - set(theirs), set(theirs) - set(mine)
    return False, (f"{len(mine)} against {len(theirs)} rows, {len(only_mine)} differ; {sorted(names)}\n"
                   f"    spark {sorted(only_mine, key=repr)[:1]}\n    sql   {sorted(only_theirs, key=repr)[:1]}")


def main(sf_dir: str, wanted: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, texts, db = entry.queries(), entry.oracle_sql(), connect(sf_dir)
    bad = 0
    for name in wanted or queries:
        start = time.time()
        try:
            if name in texts:
                good, note = compare(spark, db, sf_dir, queries[name], texts[name])
            else:
                good, note = True, f"{queries[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as error:  # one line per query, whatever happens to it
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
