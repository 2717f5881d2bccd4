"""Connected components by union of minimum labels, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Each round takes the smallest label among a node's neighbours and then the label of that
    label (union-find's path halving on tables), so long chains take a logarithmic number of
    rounds. Labels are stored in the shared folder each round; none reach the driver. No edges
    give no rows; self-loops and repeated edges change nothing. Raises if `rounds` don't suffice.
    """
    pairs = stored(edges.select("a", "b").where("a <> b"))
    both = stored(pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct())
    discard(pairs)
    table = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    labels = table
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        now = stored(hooked.join(up, "component", "left").select("node", F.coalesce(F.least("upper", "component"), "component").alias("component"), "old"))
        moved = now.where("component <> old").limit(1).count()
        discard(table)
        table, labels = now, now.select("node", "component")
        if not moved:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
