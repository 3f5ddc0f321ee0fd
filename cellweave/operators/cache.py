"""A distance cache that is refreshed only near changes, and how stale it gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators import search
from cellweave.session import INF, stored


def build(cells: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """map_id, i, j, d, ri, ci, rj, cj: the full matrix with the viewpoints' cells, written to the shared folder."""
    return stored(_placed(search.matrix(cells, viewpoints), viewpoints), "cache")


def _placed(dist: DataFrame, viewpoints: DataFrame) -> DataFrame:
    side = lambda x: viewpoints.select("map_id", F.col("i").alias(x), F.col("r").alias(f"r{x}"), F.col("c").alias(f"c{x}"))
    return dist.join(side("i"), ["map_id", "i"]).join(side("j"), ["map_id", "j"]).select("map_id", "i", "j", "d", "ri", "ci", "rj", "cj")


def refresh(cache: DataFrame, cells: DataFrame, viewpoints: DataFrame, centre: tuple[int, int], radius: int = 12) -> DataFrame:
    """The cache for a new list of viewpoints after a change at `centre`.

    A viewpoint is modified if it is new or within `radius` of the centre (Chebyshev); its row is searched anew, and its column
    is the same. Nothing is searched from the others.
    Other pairs keep what the cache had for their cells, the first entry of repeated cells. Returns the columns of build()
    and fresh.
    """
    first = W.partitionBy("map_id", "ri", "ci").orderBy("i")
    old_points = cache.select("map_id", "i", "ri", "ci").distinct().withColumn("k", F.row_number().over(first)).where("k = 1").select("map_id", F.col("ri").alias("r"), F.col("ci").alias("c"), F.col("i").alias("old"))
    near = (F.abs(F.col("r") - centre[0]) <= radius) & (F.abs(F.col("c") - centre[1]) <= radius)
    points = viewpoints.select("map_id", "i", "r", "c").join(old_points, ["map_id", "r", "c"], "left").withColumn("modified", F.col("old").isNull() | near)
    points = stored(points, "points")
    own = search.matrix(cells, points, sources=points.where("modified")).withColumnRenamed("d", "now")
    own = stored(own, "searched")
    still = points.where("not modified").select("map_id", F.col("i").alias("j"))
    searched = own.unionByName(own.join(still, ["map_id", "j"], "left_semi").select("map_id", F.col("j").alias("i"), F.col("i").alias("j"), "now"))
    side = lambda x: points.select("map_id", F.col("i").alias(x), F.col("r").alias(f"r{x}"), F.col("c").alias(f"c{x}"), F.col("old").alias(f"old_{x}"), F.col("modified").alias(f"mod_{x}"))
    both = side("i").join(side("j"), "map_id").join(searched, ["map_id", "i", "j"], "left")
    kept = cache.select("map_id", F.col("i").alias("old_i"), F.col("j").alias("old_j"), F.col("d").alias("was"))
    fresh = F.col("mod_i") | F.col("mod_j")
    value = F.when(fresh, F.col("now")).otherwise(F.coalesce("was", F.when(F.col("i") == F.col("j"), 0).otherwise(INF)))
    return both.join(kept, ["map_id", "old_i", "old_j"], "left").select("map_id", "i", "j", value.cast("int").alias("d"), "ri", "ci", "rj", "cj", fresh.alias("fresh"))


def lookup(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (map_id, i, j) with d, INF outside the cache."""
    return wanted.join(cache.select("map_id", "i", "j", "d"), ["map_id", "i", "j"], "left").withColumn("d", F.coalesce("d", F.lit(INF)).cast("int"))


def staleness(cache: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a map over ordered pairs i <> j: how many entries are above a finite true distance, and by how much.

    mean_relative_error is over all pairs. An entry above a true distance of 0 (one cell twice) has no relative error.
    """
    pairs = cache.select("map_id", "i", "j", "d").join(truth.select("map_id", "i", "j", F.col("d").alias("gt")), ["map_id", "i", "j"]).where("i <> j")
    stale = (F.col("d") > F.col("gt")) & (F.col("gt") < INF)
    over = F.when(stale, F.col("d") - F.col("gt"))
    relative = F.when(stale & (F.col("gt") > 0), (F.col("d") - F.col("gt")) / F.col("gt"))
    out = pairs.groupBy("map_id").agg(F.count("*").alias("total_pairs"), F.count_if(stale).alias("stale_pairs"), F.coalesce(F.max(over), F.lit(0)).cast("int").alias("max_absolute_error"), F.coalesce(F.max(relative), F.lit(0.0)).alias("max_relative_error"), F.coalesce(F.sum(relative), F.lit(0.0)).alias("s"))
    return out.select("map_id", "total_pairs", "stale_pairs", (F.col("stale_pairs") / F.col("total_pairs")).alias("stale_pair_fraction"), "max_absolute_error", "max_relative_error", (F.col("s") / F.col("total_pairs")).alias("mean_relative_error"))
