"""Connected components of an edge table by repeated contraction.

Each round maps every vertex to the least of itself and its neighbours, jumps
pointers twice, relabels the edges and drops loops.  Edges shrink by at least
the vertices that are no local minimum; each round is written to the shared
folder, so lineage stays short and Spark knows the tables' sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b); a component's id is its least vertex.

    Loops and repeated edges don't matter; no edges give an empty table.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        step = materialize(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p")), "parents")
        for _ in range(2):
            above = step.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            step = materialize(step.join(above, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_p", "p").alias("p")), "parents")
        if labels is None:
            labels = step
        else:
            above = step.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            labels = materialize(labels.join(above, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_p", "p").alias("p")), "labels")
        to_a, to_b = step.select(F.col("v").alias("a"), F.col("p").alias("pa")), step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = materialize(moved.distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return labels.select("v", F.col("p").alias("component"))
