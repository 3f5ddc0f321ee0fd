"""Frontier clusters, their representatives, and the choice of viewpoints."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators import raster, scans
from cellweave.operators.neighbourhood import EIGHT, KEY, clearance, frontier_cells, scatter, square
from cellweave.session import stored

#: Cells up to which the exact medoid is taken; beyond it the cell nearest the centroid.
EXACT = 128


def cluster_cells(cells: DataFrame, min_size: int = 2, max_size: int = 16) -> DataFrame:
    """map_id, cluster_id, ord, r, c, clr: frontier cells in 8-connected clusters, in the order a breadth-first visit meets them.

    Clusters are numbered by their first cell in row-major order, those that are dropped too: under min_size, or nowhere at
    clearance 2. A group is one component, found in squares; numbers come from a scan over components. One over max_size (0: no limit) is cut along the visit into clusters that take the next numbers; a tail
    under min_size is dropped.
    """
    found = stored(frontier_cells(cells).select(F.col("map_id").cast("string").alias("map_id"), "r", "c", "clr"), "frontier")
    whole = raster.linked(found, raster._largest(cells), diagonal=True)
    schema = pa.schema([("map_id", pa.string()), ("label", pa.string()), ("part", pa.int32()), ("ord", pa.int32()), ("r", pa.int32()), ("c", pa.int32()), ("clr", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        """The parts of one component; part -1, a row of its first cell, stands for the component itself."""
        clr = {(r, c): x for r, c, x in zip(*(table.column(n).to_pylist() for n in ("r", "c", "clr")))}
        first = min(clr)
        left, visit, queue = set(clr) - {first}, [], deque([first])
        while queue:
            r, c = queue.popleft()
            visit.append((r, c))
            for step in EIGHT:
                near = (r + step[0], c + step[1])
                if near in left:
                    left.discard(near)
                    queue.append(near)
        parts = []
        if len(visit) >= min_size and max(clr.values()) > 1:
            parts = [visit]
            if 0 < max_size < len(visit):
                parts = [p for k in range(0, len(visit), max_size) if len(p := visit[k : k + max_size]) >= min_size]
        cut = len(parts) if 0 < max_size < len(visit) else 0
        out = [(-1, cut, *first, 0)] + [(k, i, *p, clr[p]) for k, part in enumerate(parts) for i, p in enumerate(part)]
        name, label = table.column("map_id")[0].as_py(), table.column("label")[0].as_py()
        return pa.Table.from_arrays([pa.array([name] * len(out), pa.string()), pa.array([label] * len(out), pa.string()), *(pa.array(x, pa.int32()) for x in zip(*out))], schema=schema)

    parts = whole.join(found, ["map_id", "r", "c"]).groupBy("map_id", "label").applyInArrow(run, "map_id string, label string, part int, ord int, r int, c int, clr int")
    parts = stored(parts, "parts")
    # a component takes one number, and its parts the next ones
    taken = parts.where("part < 0").select("map_id", "label", (F.col("ord") + 1).alias("takes"), (F.col("ord") > 0).cast("int").alias("cut"))
    taken = scans.running(taken, ["map_id"], [F.col("label").asc()], sums={"upto": F.col("takes")})
    first = taken.select("map_id", "label", (F.col("upto") - F.col("takes") + F.col("cut")).alias("first"))
    return parts.where("part >= 0").join(first, ["map_id", "label"]).select("map_id", (F.col("first") + F.col("part")).cast("int").alias("cluster_id"), "ord", "r", "c", "clr")


def medoids(clustered: DataFrame) -> DataFrame:
    """map_id, cluster_id, size, r, c: the cell of least total L1 distance plus a penalty for clearance (1000, 100, 0 at tiers
    up to 1, 2 and 3), the first in the cluster's order among equals; over EXACT cells, nearest the centroid (200, 20, 0)."""
    by = ["map_id", "cluster_id"]
    sized = clustered.join(clustered.groupBy(*by).agg(F.count("*").alias("size"), F.avg("r").alias("mr"), F.avg("c").alias("mc")), by)

    def penalty(near: float, middle: float) -> Column:
        return F.when(F.col("clr") <= 1, near).when(F.col("clr") == 2, middle).otherwise(0)

    small = sized.where(f"size <= {EXACT}")
    other = small.select(*by, F.col("r").alias("r2"), F.col("c").alias("c2"))
    total = F.sum(F.abs(F.col("r") - F.col("r2")) + F.abs(F.col("c") - F.col("c2")))
    exact = small.join(other, by).groupBy(*by, "size", "ord", "r", "c", "clr").agg(total.alias("sum")).withColumn("cost", (F.col("sum") + penalty(1000, 100)).cast("double"))
    dr, dc = F.col("r") - F.col("mr"), F.col("c") - F.col("mc")
    rough = sized.where(f"size > {EXACT}").withColumn("cost", dr * dr + dc * dc + penalty(200.0, 20.0))
    costs = exact.select(*by, "size", "cost", "ord", "r", "c").unionByName(rough.select(*by, "size", "cost", "ord", "r", "c"))
    return costs.groupBy(*by, "size").agg(F.min(F.struct("cost", "ord", "r", "c")).alias("m")).select(*by, F.col("size").cast("int").alias("size"), "m.r", "m.c")


def stand_off(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (map_id, r, c, ...) with (safe_r, safe_c): the point at clearance 2 and more, else the passable cell of the 7 x 7
    square with the highest clearance, then the nearest, then the first in row-major order."""
    clr = clearance(cells).select(*KEY, "clr", "observed")
    near = scatter(points.select(*KEY).distinct(), square(3, True), F.col("r").alias("pr"), F.col("c").alias("pc"))
    own = (F.col("dr") == 0) & (F.col("dc") == 0)
    met = near.join(clr, KEY).where(own | (F.col("observed") == 1))
    order = F.struct((-F.col("clr")).alias("a"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("b"), "r", "c")
    best = met.groupBy("map_id", "pr", "pc").agg(F.max(F.when(own, F.col("clr"))).alias("own"), F.min(order).alias("m"))
    best = best.select("map_id", F.col("pr").alias("r"), F.col("pc").alias("c"), "own", F.col("m.r").alias("mr"), F.col("m.c").alias("mc"))
    keep = F.coalesce(F.col("own") >= 2, F.lit(False)) | F.col("mr").isNull()
    return points.join(best, KEY, "left").withColumn("safe_r", F.when(keep, F.col("r")).otherwise(F.col("mr"))).withColumn("safe_c", F.when(keep, F.col("c")).otherwise(F.col("mc"))).drop("own", "mr", "mc")


def frontier_clusters(cells: DataFrame, min_size: int = 2, max_size: int = 16) -> DataFrame:
    """map_id, id, rep (r, c), cells: clusters with the stand-off cell of their medoid."""
    own = cluster_cells(cells, min_size, max_size)
    safe = stand_off(medoids(own), cells).select("map_id", "cluster_id", F.struct(F.col("safe_r").alias("r"), F.col("safe_c").alias("c")).alias("rep"))
    listed = own.groupBy("map_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("ord", "r", "c"))).alias("cells"))
    return safe.join(listed, ["map_id", "cluster_id"]).select("map_id", F.col("cluster_id").alias("id"), "rep", F.transform("cells", lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"))).alias("cells"))


def select_viewpoints(reps: DataFrame, cap: int, side: int) -> DataFrame:
    """reps (map_id, cluster_id, size, r, c, cols) with pick, of at most `cap` a map: all in order if they fit, else in rounds
    over the tiles, in each the largest cluster that is left, the first of equals."""
    tile = F.floor(F.col("r") / side) * F.ceil(F.col("cols") / side) + F.floor(F.col("c") / side)
    n = F.count("*").over(W.partitionBy("map_id"))
    turn = F.row_number().over(W.partitionBy("map_id", "tile").orderBy(F.desc("size"), "cluster_id"))
    dealt = reps.withColumn("tile", tile.cast("int")).withColumn("n", n).withColumn("turn", turn)
    order = [F.when(F.col("n") > cap, F.col("turn")), F.when(F.col("n") > cap, F.col("tile")), F.col("cluster_id")]
    return dealt.withColumn("pick", (F.row_number().over(W.partitionBy("map_id").orderBy(*order)) - 1).cast("int")).where(F.col("pick") < cap).drop("n", "turn")
