"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.plans.lineage import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node that a link names; the component is its least node.

    Each round gives a node the least label among its own and its neighbours', then that label's own label,
    so that chains are shortened by halves. Rounds end when no label changes. Labels stay distributed; only
    a count reaches the driver. Links with a null end, loops and repeated links say nothing.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x != y").distinct()
    both = cut(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.least("x", F.min("y")).alias("l")))
    while not both.isEmpty():
        near = both.join(labels.select(F.col("x").alias("y"), F.col("l").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
        step = labels.join(near, "x").select("x", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = step.join(labels.select(F.col("x").alias("l"), F.col("l").alias("far")), "l", "left")
        new = cut(jump.select("x", "was", F.least("l", F.coalesce("far", "l")).alias("l")))
        changed = new.where("l != was").limit(1).count()
        labels = new.select("x", "l")
        if not changed:
            break
    return labels.select(F.col("x").alias("node"), F.col("l").alias("component"))
