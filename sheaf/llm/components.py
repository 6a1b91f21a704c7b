"""Connected components of a links table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of every node of ``links`` (``a, b``, longs).

    Each round every node points to its least neighbour, if that is less; pointers are followed to their end by doubling,
    nodes become what they point to, and links inside one node go. Rounds shrink the graph until no link is left. Every
    round is written to the shared folder, so nothing is recomputed and nothing is gathered on the driver. A node with a
    large part of all links is pre-aggregated before the shuffle, and its joins are skew joins.
    """
    links = materialize(links.where((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not links.isEmpty():
        # the greater end of a link is the only one that can point along it
        up = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        pointers = materialize(up, "pointers")
        while True:
            further = pointers.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            pointers = materialize(pointers.join(further, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "pointers")
            if pointers.where("moved").isEmpty():
                break
            pointers = pointers.select("node", "to")
        p = pointers.select("node", "to")
        pa, pb = p.select(F.col("node").alias("a"), F.col("to").alias("pa")), p.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        moved = links.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        labels = materialize(labels.join(p.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        links = materialize(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels
