"""Connected components of a distributed edge list by contraction.

Each round hooks every node to its least neighbour, shortens the pointers and renames the
edges; edges inside one node disappear. Every round at least halves the nodes of a
component, so the rounds grow with the logarithm of the largest one. All grouping is a
partial ``min``, and the joins have one row per node on one side, so a hub's edges can be
split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, one row per node that has an edge; the root is a node of its component.

    Null ends and loops are ignored; repeated and reversed edges count once. No edges: no rows.
    """
    e = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{name}-edges",
    )
    labels = None
    for step in range(64):
        if not e.take(1):
            break
        both = e.select(F.col("a").alias("node"), F.col("a").alias("to")).union(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = materialize(both.groupBy("node").agg(F.min("to").alias("up")), f"{name}-up{step}")
        # the pointers run to smaller nodes; two doublings shorten chains, the next rounds do the rest
        for hop in range(2):
            far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            up = materialize(up.join(far, "up").select("node", F.col("far").alias("up")), f"{name}-hop{step}-{hop}")
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            nxt = up.select(F.col("node").alias("root"), "up")
            labels = materialize(labels.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-labels{step}")
        ua = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        ub = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        moved = e.join(ua, "a").join(ub, "b").where("ra <> rb")
        e = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges{step}")
    if labels is None:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    return labels
