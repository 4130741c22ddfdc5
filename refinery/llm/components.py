"""Connected components by repeated contraction, for edge lists of any size.

Each round every node picks, among itself and its neighbours, the node with
the smallest hash under that round's seed, and edges move to the picked nodes.
A constant share of the remaining nodes disappears per round on average, so
the rounds grow with the logarithm of the longest chain.  All steps are
map-side-combined aggregates and joins that adaptive execution can split;
a node with very many neighbours never gathers them in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b); one arbitrary root per component.

    Self-loops and repeated edges are allowed.  No edges: an empty frame.
    """
    live = scratch.table(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    round_no = 0
    while not live.isEmpty():
        seed = F.lit(round_no)
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).union(live.select("b", "a"))
        best = F.min(F.struct(F.xxhash64("to", seed).alias("h"), F.col("to").alias("to")))
        own = F.struct(F.xxhash64("node", seed).alias("h"), F.col("node").alias("to"))
        picked = scratch.table(
            both.groupBy("node").agg(best.alias("n")).select("node", F.least("n", own)["to"].alias("pick")), "picks")
        moved = (live.join(picked.select(F.col("node").alias("a"), F.col("pick").alias("pa")), "a")
                 .join(picked.select(F.col("node").alias("b"), F.col("pick").alias("pb")), "b")
                 .filter("pa <> pb")
                 .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        following = scratch.table(moved, "edges")
        if labels is None:
            relabelled = picked.select("node", F.col("pick").alias("root"))
        else:
            relabelled = labels.join(picked.withColumnRenamed("node", "root"), "root", "left").select(
                labels["node"], F.coalesce("pick", "root").alias("root"))
        relabelled = scratch.table(relabelled, "labels")
        scratch.drop(live, picked, labels)
        live, labels = following, relabelled
        round_no += 1
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
