"""Connected components of an edge table by alternating large and small stars, in O(log n) rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import stored


def connected(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that edges (a, b) reach. Nodes without an edge are not returned.

    Null ends, loops and repeated edges are ignored; an empty table gives no rows. Every round is written to the shared
    folder, and no node's neighbours are gathered in a list: a hub is a minimum and a join that can be split.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = stored(now, "edges")
    seen = _state(now)
    if not seen[0]:
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    while True:
        both = now.union(now.select("lo", "hi"))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both.hi == least.u).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(least, large.hi == least.u).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        now = stored(small.union(least.select("u", "m")).distinct(), "edges")
        state = _state(now)
        if state == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
        seen = state


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
