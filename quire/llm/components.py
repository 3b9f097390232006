"""Connected components of a link table by alternating large-star and small-star steps, without a hub in one task.

Minima are taken by partial aggregation, written, and joined back in a join whose skewed partitions can be split, so a node with any number of links
is never gathered. Each round is written to the shared folder. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _common as C


def _large_star(links: DataFrame) -> DataFrame:
    """(u, v) with v < u for each link; every larger neighbour of a node goes to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = C.materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the least of them."""
    least = C.materialize(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = links.join(least, "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """u, v: each node that isn't the least of its component, with the least. Links are (u, v) of any order; loops count for nothing."""
    ordered = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = C.materialize(ordered, "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        before, old = state, now
        large = C.materialize(_large_star(old), "links")
        now = C.materialize(_small_star(large), "links")
        for done in (old, large):
            C.drop_materialized(done)
