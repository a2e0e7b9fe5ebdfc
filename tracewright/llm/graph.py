"""Connected components of an edge table, without ever collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of ``edges(a, b)``; the label is the smallest id.

    Rounds of contraction: each node moves to its smallest neighbour, edges
    follow their ends, loops and repeats fall away, until no edge is left.
    Each round is one aggregation and two joins over the edges that remain,
    which halve at least; the round tables lie in the shared folder.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    nodes, read = None, []
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("id"), F.least("a", "to").alias("to")), "step")
        if nodes is None:
            nodes = step.select("id", F.col("to").alias("label"))
        else:
            nodes = nodes.join(step.select(F.col("id").alias("label"), "to"), "label", "left").select(
                "id", F.coalesce("to", "label").alias("label")
            )
        left, right = step.select(F.col("id").alias("a"), F.col("to").alias("a2")), step.select(F.col("id").alias("b"), F.col("to").alias("b2"))
        read.append(step)
        edges = materialise(
            edges.join(left, "a")
            .join(right, "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct(),
            "edges",
        )
        read.append(edges)
        if edges.isEmpty():
            break
    labels = materialise(nodes, "labels")
    release(*read)
    return labels
