"""One group for all directly or indirectly linked records.

1. Peel: breadth-first from the vertex of highest degree, a frontier join a round, as long as the frontier is a sizeable part
   of what has been reached. In match graphs this takes the giant component, which is shallow, in a few rounds; the reached
   vertices are anti-joined away.
2. The rest: minimum propagation with contraction. Each vertex takes the smallest of itself and its neighbours; these
   pointers form trees, which pointer doubling flattens; edges are rewritten to the tree roots and loops dropped. A round shrinks
   the edges by a constant factor whatever the shape, so a chain of n takes O(log n) rounds, not n.

   Once the edges left are few, one task takes the minimum over them by union-find: the labels are the same, without a round of jobs for each halving.

What the peel left unfinished (a long tail on the giant) is no special case: the reached vertices become one vertex, and the
edges leading out of it go on to step 2. Each round is written to the checkpoint folder. Nothing but counts
and the one starting vertex reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.session import cut, drop_cut

#: At most so many edges are finished in one task (about 50 MB).
LOCAL_EDGES = 200_000
#: The peel goes on while a frontier holds at least this part of what has been reached.
PEEL_SHARE = 0.05


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _peel(edges: DataFrame) -> DataFrame:
    """(v): vertices reached from the one of highest degree (ties: the smallest id)."""
    both = _neighbours(edges)
    start = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a").limit(1)
    reached = frontier = cut(start.select(F.col("a").alias("v")))
    total, share, waves = 1, 1.0, [reached]
    while share >= PEEL_SHARE:
        step = both.join(frontier, both.a == frontier.v, "left_semi").select(F.col("b").alias("v")).distinct()
        frontier = cut(step.join(reached, "v", "left_anti"))
        waves.append(frontier)
        new = frontier.count()
        reached = reached.unionByName(frontier)
        total, share = total + new, new / (total + new)
    whole = cut(reached)
    drop_cut(*waves)
    return whole


def _flatten(parent: DataFrame) -> DataFrame:
    """(v, p) with p <= v made to point to the roots of its trees, by pointer doubling."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        nxt = cut(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        drop_cut(parent)
        parent = nxt
        if not moved:
            return parent


def _smallest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, p): for each end of the edges (a, b) the smallest id of its component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for pdf in it:
        for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pd.DataFrame({"v": list(up), "p": [root(x) for x in list(up)]}).astype("int64")


def connected_components(pairs: DataFrame, a: str, b: str, peel: bool = True, local: int = LOCAL_EDGES) -> DataFrame:
    """(id, group_id) for each id in a row with both ids; group_id is the smallest id of its component.

    Rows with a null id link nothing and bring no id. An id paired only with itself is its own group. Reversed and
    repeated rows count once; an empty table gives an empty result. Other columns are ignored.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = cut(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    vertices = cut(_neighbours(edges).select(F.col("a").alias("v")).distinct())
    written, edges = edges, edges.where("a <> b")
    levels: list[DataFrame] = []
    n = edges.count()
    if peel and n:
        reached = _peel(edges)
        root = reached.agg(F.min("v")).first()[0]
        giant = reached.select("v", F.lit(root).cast("long").alias("p"))
        levels.append(giant)
        ra, rb = giant.select(F.col("v").alias("a"), F.col("p").alias("pa")), giant.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(ra, "a", "left").join(rb, "b", "left").where("pa is null or pb is null")
        edges = cut(moved.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).distinct())
        drop_cut(written)
        written = edges
        n = edges.count()
    while n > local:
        low = _neighbours(edges).groupBy("a").agg(F.min("b").alias("m"))
        parent = _flatten(cut(low.select(F.col("a").alias("v"), F.least("a", "m").alias("p"))))
        levels.append(parent)
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = cut(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        drop_cut(written)
        written = edges
        n = edges.count()
    if n:
        levels.append(cut(edges.coalesce(1).mapInPandas(_smallest, "v long, p long")))
    label = vertices.select("v", F.col("v").alias("p"))
    for level in levels:
        up = level.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        label = label.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
    groups = cut(label.select(F.col("v").alias("id"), F.col("p").alias("group_id")))
    drop_cut(written, vertices, *levels)  # only the result stays in the checkpoint folder
    return groups
