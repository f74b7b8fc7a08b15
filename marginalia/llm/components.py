"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.session import materialize

JUMPS = 2


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node per node: edges ``(a, b)`` to ``(node, component)``.

    Each round hangs every node under its smallest neighbour, shortens the paths of that
    forest and draws the edges anew between the parents. Every edge is carried over, so
    connections stay; inner edges vanish. Rounds go on until no edge is left. Nodes without
    an edge to another node do not appear. Each round is cut by a checkpoint.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct())
    nodes = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                              .select("node", F.least("node", "m").alias("parent")))
        up = parents.select(F.col("node").alias("at"), F.col("parent").alias("above"))
        for _ in range(JUMPS):
            parents = parents.join(up, parents.parent == up.at).select("node", F.col("above").alias("parent"))
        parents = materialize(parents)
        if nodes is None:
            nodes = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("was"), "parent")
            nodes = nodes.join(step, nodes.component == step.was, "left").select(
                "node", F.coalesce("parent", "component").alias("component"))
        nodes = materialize(nodes)
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = materialize(edges.join(pa, "a").join(pb, "b").where("pa <> pb")
                            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if nodes is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes
