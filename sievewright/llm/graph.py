"""Connected components by minimum labels, in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, comp): the smallest node of each node's component, for all nodes of ``edges`` (a, b).

    Each round replaces every edge by edges to the smallest neighbour (large-star, then
    small-star), which keeps the components and shortens all paths to the smallest node; it ends
    when nothing changes. Only the count of changes reaches the driver. The minimum of a hot node
    is combined before the shuffle and its edges are joined, so no neighbourhood is gathered.
    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    before = None
    for _ in range(most_rounds):
        # large-star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("m <> v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # small-star: every smaller neighbour of u, and u, go to the smallest of them
        small = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(small, "u")
        after = cut(
            joined.where("m <> v").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
            .union(small.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct()
        )
        sign = after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("lo", "hi")), F.lit(0))).first()
        now = after
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(now.select("lo", "lo").distinct())
