"""Connected components by label hooking and shortcutting; every round is cut by a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

MAX_ROUNDS = 200


def connected_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): label is the smallest node reachable from v, itself included.

    ``nodes`` is (v, label) with a start label of the same component that is no greater than v, one
    row a node; ``edges`` is (a, b), in any direction and number. Hooks run on labels, so long chains need
    a number of rounds that grows with the logarithm of their length; the rounds end only when no
    label changes (an error after MAX_ROUNDS, never a partial result). Nodes of many edges are dealt
    with by Spark's skew join: each join reads two stored tables. The tables of ended rounds are deleted; the result lies in ``scratch``.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.stored(both, "edges")
    labels = scratch.stored(nodes.select("v", "label"), "labels")
    if both.isEmpty():
        return labels
    old = Scratch(scratch.spark)
    for _ in range(MAX_ROUNDS):
        own = Scratch(scratch.spark)
        near = both.join(labels.withColumnsRenamed({"v": "a", "label": "la"}).hint("merge"), "a").groupBy("b").agg(F.min("la").alias("near"))
        step = own.stored(labels.join(near.withColumnRenamed("b", "v"), "v", "left").select("v", "label", F.coalesce(F.least("label", "near"), F.col("label")).alias("new")), "labels")
        # a root takes the smallest label that any of its nodes has seen
        hooks = step.where("new < label").groupBy("label").agg(F.min("new").alias("hook"))
        moved = own.stored(step.select("v", F.col("new").alias("label")).join(hooks.select(F.col("label").alias("v"), "hook"), "v", "left").select("v", F.least("label", "hook").alias("label")), "labels")
        jump = moved.select(F.col("v").alias("label"), F.col("label").alias("up"))
        after = moved.join(jump.hint("merge"), "label", "left").select("v", F.coalesce("up", "label").alias("label"))
        after = own.stored(after, "labels")
        changed = after.withColumnRenamed("label", "now").join(labels, "v").where("now <> label").limit(1).count()
        labels = after
        old.drop()
        old = own
        if not changed:
            scratch.paths += own.paths
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
