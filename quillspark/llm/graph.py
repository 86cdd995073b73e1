"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component: the smallest node reached.

    Each round points every node, then every node's larger neighbours, to the
    smallest neighbour it knows.  Both steps are grouped minima with map-side
    combining, so a node with very many neighbours needs no list of them.  The
    rounds end when the edges stop changing; the state is checkpointed.
    """
    pairs = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    state = checkpointed(pairs)
    seen = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node is linked with the node's smallest neighbour
        both = state.unionByName(state.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        # small star: every neighbour below a node, and the node, are linked with the smallest of them
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where(F.col("src") != F.col("dst"))
        state = checkpointed(small.unionByName(low.select("src", F.col("low").alias("dst"))).distinct())
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == seen:
            return state.groupBy("src").agg(F.min("dst").alias("component")).select(F.col("src").alias("node"), "component").unionByName(
                state.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            )
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
