"""Connected components by contraction, without leaving DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root``, the smallest id reachable, for the ends of ``edges`` (a, b).

    In each round every vertex hooks to its smallest neighbour and the graph is
    contracted by that.  A vertex that stays has a larger neighbour that doesn't, so
    the vertices at least halve and chains of any length end after a logarithmic
    number of rounds.  Nothing but one bit per round reaches the driver.
    """
    both = edges.where("a <> b").select("a", "b")
    graph = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    assigned: DataFrame | None = None
    while not graph.isEmpty():
        parent = materialize(graph.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "parents")
        if assigned is None:
            step = materialize(parent.select(F.col("v").alias("id"), F.col("p").alias("root")), "roots")
        else:
            step = materialize(assigned.join(parent, F.col("root") == F.col("v"), "left").select("id", F.coalesce("p", "root").alias("root")), "roots")
            drop(assigned)
        assigned = step
        ends = parent.select(F.col("v").alias("w"), F.col("p").alias("q"))
        smaller = graph.join(parent, F.col("a") == F.col("v")).join(ends, F.col("b") == F.col("w")).where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
        contracted = materialize(smaller, "edges")
        drop(graph, parent)
        graph = contracted
    if assigned is None:
        return graph.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return assigned
