"""Connected components of an undirected graph by minimum labels with contraction: rounds shrink the edges whatever the shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.session import cut, drop_cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for all nodes (id): the smallest id reachable over edges (a, b). Edges with a null end link nothing; ends that are no nodes are ignored in the result."""
    live = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while live.limit(1).count():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
        while True:  # pointers to pointers, until all point to the roots of their trees
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            nxt = cut(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moved = nxt.where("moved").limit(1).count()
            drop_cut(parent)
            parent = nxt
            if not moved:
                break
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        old, old_label = live, label
        label = cut(label.join(parent.select(F.col("v").alias("component"), F.col("p").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        live = cut(live.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        drop_cut(old, old_label, parent)
    return label
