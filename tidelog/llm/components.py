"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(key, component) for every endpoint of `links` (a, b): component is the least key reachable.

    In each step every vertex moves to its least neighbour, and that one's choice, if smaller;
    links are rewritten to the new vertices. All vertices but local minima vanish in a step, so
    a few steps do for any graph. Each step is stored, which keeps the lineage short.
    """
    both = links.select("a", "b").filter("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct()
    edges = stored(both, "links")
    labels = edges.select(F.col("a").alias("key")).distinct().withColumn("component", F.col("key"))
    while not edges.isEmpty():
        near = edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        further = near.select(F.col("a").alias("to"), F.col("to").alias("next"))
        moves = stored(near.join(further, "to", "left").select("a", F.least("to", "next").alias("to")), "moves")
        labels = stored(labels.join(moves, labels["component"] == moves["a"], "left").select("key", F.coalesce("to", "component").alias("component")), "labels")
        left = moves.select("a", F.col("to").alias("na"))
        right = moves.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        edges = stored(edges.join(left, "a").join(right, "b").filter("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "links")
    return labels
