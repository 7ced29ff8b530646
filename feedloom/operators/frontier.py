"""Bounded breadth-first expansion of a link frontier, one Spark job a hop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.distinct import top_n
from feedloom.plans.lineage import cut


def expand(seeds: DataFrame, follow: Callable[[DataFrame], DataFrame], hops: int = 2, most: int = 3) -> DataFrame:
    """``root, node, hop`` of every node reached from ``seeds`` (root, node).

    ``follow`` maps a frontier (root, node) to its links (root, node, ord, next): an edge table's join, or a
    fetcher over stored pages. At most ``most`` links of a page, the first by ``ord``, are taken; nodes that
    the root has visited are left out then, in this order. Each hop is written to the shared checkpoint
    folder, so a fetcher isn't called twice for a page.
    """
    visited = cut(seeds.select("root", "node").where("node is not null").distinct().withColumn("hop", F.lit(0)))
    frontier = visited
    for hop in range(1, hops + 1):
        linked = top_n(follow(frontier.select("root", "node")), most, ["root", "node"], F.col("ord"), F.col("next"))
        new = linked.select("root", F.col("next").alias("node")).where("node is not null").distinct().join(visited, ["root", "node"], "left_anti")
        frontier = cut(new.withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def along(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A ``follow`` over an edge table (node, ord, next)."""
    return lambda frontier: frontier.join(edges, "node").select("root", "node", "ord", "next")
