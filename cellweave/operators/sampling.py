"""Samples of the cells of a component (map_id, rows, cols, r, c)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Divisions up to which sectors are doubled to reach the wanted number.
MOST_DIVISIONS = 64


def sectors(component: DataFrame, divisions: int = 8, origin_r: int = 0, origin_c: int = 0) -> DataFrame:
    """map_id, sector, r, c: for each of divisions x divisions centres the nearest cell (L1, then row-major) of the window around it.

    Windows include both edges, so neighbours overlap and may pick the same cell; a sector without a cell has no row. A cell
    meets only the centres around it, by arithmetic, never all of them.
    """
    for axis, n, origin in (("r", "rows", origin_r), ("c", "cols", origin_c)):
        step = F.greatest(F.lit(1), F.floor(F.col(n) / divisions))
        component = component.withColumn(f"step_{axis}", step.cast("int")).withColumn(f"half_{axis}", F.greatest(F.lit(1), F.floor(step / 2)).cast("int"))
        near = F.floor((F.col(axis) - origin) / F.col(f"step_{axis}")).cast("int")
        component = component.withColumn(f"s{axis}", F.explode(F.array(near - 2, near - 1, near, near + 1, near + 2)))
        component = component.withColumn(f"centre_{axis}", (F.col(f"s{axis}") * F.col(f"step_{axis}") + F.floor(F.col(f"step_{axis}") / 2) + origin).cast("int"))
        component = component.where((F.abs(F.col(axis) - F.col(f"centre_{axis}")) <= F.col(f"half_{axis}")) & F.col(f"s{axis}").between(0, divisions - 1))
    l1 = F.abs(F.col("r") - F.col("centre_r")) + F.abs(F.col("c") - F.col("centre_c"))
    best = component.groupBy("map_id", (F.col("sr") * divisions + F.col("sc")).alias("sector")).agg(F.min(F.struct(l1.alias("l1"), "r", "c")).alias("m"))
    return best.select("map_id", "sector", "m.r", "m.c")


def _farthest(table: pa.Table, n: int, first: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Add the cell farthest (L1) from those chosen, the first in row-major order of equals, until there are n."""
    import numpy as np

    r, c = (table.column(x).to_numpy() for x in ("r", "c"))
    order = np.lexsort((c, r))
    r, c = r[order].astype(np.int64), c[order].astype(np.int64)
    out = list(first) or [(int(r[0]), int(c[0]))]
    far = np.full(len(r), 1 << 30)
    for p in out:
        far = np.minimum(far, np.abs(r - p[0]) + np.abs(c - p[1]))
    while len(out) < min(n, len(r)) and far.max() > 0:
        k = int(far.argmax())
        out.append((int(r[k]), int(c[k])))
        far = np.minimum(far, np.abs(r - r[k]) + np.abs(c - c[k]))
    return out


def _listed(table: pa.Table, points: list[tuple[int, int]]) -> pa.Table:
    name = table.column("map_id")[0].as_py()
    r, c = zip(*points) if points else ((), ())
    return pa.table({"map_id": pa.array([name] * len(r), pa.string()), "i": pa.array(range(len(r)), pa.int32()), "r": pa.array(r, pa.int32()), "c": pa.array(c, pa.int32())})


DDL = "map_id string, i int, r int, c int"


def farthest(component: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """map_id, i, r, c: n cells, each the farthest from those before; the first is the cell of least hash of seed, r and c."""

    def run(table: pa.Table) -> pa.Table:
        first = min(zip(*(table.column(x).to_pylist() for x in ("h", "r", "c"))))
        return _listed(table, _farthest(table, n, [first[1:]])[:n])

    return component.select(F.col("map_id").cast("string").alias("map_id"), "r", "c", shuffled(seed).alias("h")).groupBy("map_id").applyInArrow(run, DDL)


def nearest(component: DataFrame, n: int, centre_r, centre_c) -> DataFrame:
    """map_id, i, r, c: the n cells nearest a centre by Chebyshev, then L1 distance, then in row-major order."""
    dr, dc = F.abs(F.col("r") - centre_r), F.abs(F.col("c") - centre_c)
    order = F.row_number().over(W.partitionBy("map_id").orderBy(F.greatest(dr, dc), dr + dc, "r", "c"))
    return first_of_each_map(component, order, n)


def first_of_each_map(df: DataFrame, order, n: int) -> DataFrame:
    """map_id, i, r, c: the rows whose number in order is n at most; the filter is on the number itself, so that each task keeps n rows of a map."""
    return df.withColumn("number", order).where(F.col("number") <= n).select("map_id", (F.col("number") - 1).cast("int").alias("i"), "r", "c")


def shuffled(seed: int):
    """An arithmetic hash of a cell, by which draws are ordered."""
    return ((F.col("r").cast("long") * 100_003 + F.col("c")) * 7919 + seed) % 1_000_003


def uniform(component: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """map_id, i, r, c: k cells in the order of an arithmetic hash of seed, r and c."""
    order = F.row_number().over(W.partitionBy("map_id").orderBy(shuffled(seed), "r", "c"))
    return first_of_each_map(component, order, k)


def geometry(component: DataFrame, name: str, n: int, seed: int = 0) -> DataFrame:
    """Dispatch by name: spread, cluster, or sectors padded by the farthest rule and cut to n in order of sectors."""
    if name == "spread":
        return farthest(component, n, seed)
    if name == "cluster":
        first = uniform(component, 1, seed).select("map_id", F.col("r").alias("r0"), F.col("c").alias("c0"))
        return nearest(component.join(first, "map_id"), n, F.col("r0"), F.col("c0"))
    divisions = 8
    while divisions * divisions < n and divisions < MOST_DIVISIONS:
        divisions *= 2
    once = sectors(component, divisions).groupBy("map_id", "r", "c").agg(F.min("sector").alias("sector"))
    listed = once.select(F.col("map_id").cast("string").alias("map_id"), "sector", "r", "c")
    all_ = component.select(F.col("map_id").cast("string").alias("map_id"), "r", "c")

    def run(cells: pa.Table, chosen: pa.Table) -> pa.Table:
        points = [(r, c) for _, r, c in sorted(zip(*(chosen.column(x).to_pylist() for x in ("sector", "r", "c"))))]
        return _listed(cells, (points if len(points) >= n else _farthest(cells, n, points))[:n])

    return all_.groupBy("map_id").cogroup(listed.groupBy("map_id")).applyInArrow(run, DDL)


def withheld(component: DataFrame, want: int, side: int, protect: DataFrame, seed: int = 0, spread: bool = False) -> DataFrame:
    """map_id, i, r, c: `want` cells to withhold, none of those in `protect`.

    All in one tile, the first that has enough; or, with spread, one from each tile in turn."""
    tile = (F.floor(F.col("r") / side) * F.ceil(F.col("cols") / side) + F.floor(F.col("c") / side)).cast("int")
    free = component.join(protect.select("map_id", "r", "c").distinct(), ["map_id", "r", "c"], "left_anti").withColumn("tile", tile)
    free = free.withColumn("turn", F.row_number().over(W.partitionBy("map_id", "tile").orderBy(shuffled(seed), "r", "c"))).withColumn("room", F.count("*").over(W.partitionBy("map_id", "tile")))
    if spread:
        order = F.row_number().over(W.partitionBy("map_id").orderBy("turn", "tile"))
    else:
        free = free.where(F.col("room") >= want)
        order = F.row_number().over(W.partitionBy("map_id").orderBy("tile", "turn"))
    return first_of_each_map(free, order, want)
