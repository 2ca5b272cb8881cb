"""Connected components by alternating large-star and small-star steps, on DataFrames alone.

Loops and repeated edges change nothing; an edge with a null end is no edge; no edges: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``edges`` (a, b) in any direction; gives (node, component) with the smallest node reachable.

    Nodes without an edge are absent. Each round links every node to the smallest neighbour it has
    seen: minima are aggregated on the map side, and a hot node is a skewed join key at worst.
    Rounds end when the links no longer change; their number grows with the logarithm of the longest chain.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links = checkpointed(links)
    before = None
    for _ in range(most_rounds):
        # Large star: neighbours above u, and u's minimum.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # Small star: u (which is above its neighbours) and they all go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        links = checkpointed(small.filter("u <> v").distinct())
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
