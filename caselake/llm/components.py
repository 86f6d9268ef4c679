"""Connected components of a link table, as joins and aggregates.

Each round takes every node's smallest neighbour (its own label included), points the labels'
nodes there as well (hooking) and halves the paths (jumping). The table of labels is written to the
shared folder after each round, so a lost executor costs a re-read. A hub's links are reduced by
partial minima in each task; nothing is collected but one count per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.session import materialize


def components(links: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node of ``links`` (a, b) is connected with."""
    both = links.filter("a <> b").select("a", "b")
    edges = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(
        F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), label)
    for _ in range(most_rounds):
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        best = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("low"))
        # Hooking: the root itself learns the smallest label any of its members has seen.
        hooks = best.filter("low < root").groupBy(F.col("root").alias("hooked")).agg(F.min("low").alias("hook"))
        moved = best.select("node", "low").join(hooks, F.col("node") == F.col("hooked"), "left").select(
            "node", F.least("low", "hook").alias("low"))
        moved = materialize(moved, label)
        # Jumping: a label's own label is at least as small.
        jumped = moved.alias("x").join(moved.alias("y"), F.col("x.low") == F.col("y.node"), "left").select(
            F.col("x.node"), F.least("x.low", "y.low").alias("root"))
        jumped = materialize(jumped, label)
        changed = jumped.join(labels.withColumnsRenamed({"node": "n", "root": "old"}), F.col("node") == F.col("n")).filter(
            "root <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels
    raise RuntimeError(f"no end after {most_rounds} rounds")
