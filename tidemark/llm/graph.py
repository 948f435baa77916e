"""Connected components of an edge table, by hooking to the least neighbour and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Work


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """``id, component`` of every id in the edges ``a, b``; the component is its least id.

    Each round, a label takes the least label among its neighbours' labels, and then the label
    of its label.  Least labels are combined before the shuffle, so a vertex of many edges is
    no heavier than others.  Rounds end when nothing changes.
    """
    edges = work.keep(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a != b").distinct(), f"{name}_edges")
    labels = work.keep(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")),
                       f"{name}_labels")
    turn = 0
    while True:
        near = (edges.join(labels, edges.b == labels.id).groupBy(F.col("a").alias("id"))
                .agg(F.min("component").alias("near")))
        hooked = (labels.join(near, "id").select("id", F.least("component", "near").alias("component"),
                                                 (F.col("near") < F.col("component")).alias("moved")))
        hooked = work.keep(hooked, f"{name}_hooked{turn}")
        if hooked.filter("moved").isEmpty():
            return hooked.select("id", "component")
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("up"))
        labels = work.keep(hooked.join(up, "component").select("id", F.col("up").alias("component")),
                           f"{name}_labels{turn}")
        turn += 1
