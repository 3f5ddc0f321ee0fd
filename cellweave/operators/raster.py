"""Components of maps, labelled in squares and joined across their sides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import scans
from cellweave.operators.components import connected
from cellweave.session import INF, stored

#: Side of the squares in which components are labelled; a larger map is joined from them.
SQUARE = 1024


def components(cells: DataFrame, layer: str = "gt") -> DataFrame:
    """map_id, r, c, comp, size: 4-connected components of the passable cells, numbered from 0 in row-major order of their first cell.

    Cells are labelled in squares, a task each; labels that meet across the sides of squares are joined as a graph, so no task
    holds a large map.
    """
    labelled = linked(_passable(cells, layer), _largest(cells))
    sizes = labelled.groupBy("map_id", "label").agg(F.count("*").alias("size"))
    numbered = scans.running(sizes, ["map_id"], [F.col("label").asc()], sums={"number": F.lit(1)}).withColumn("comp", (F.col("number") - 1).cast("int"))
    return labelled.join(numbered, ["map_id", "label"]).select("map_id", "r", "c", "comp", "size")


def _passable(cells: DataFrame, layer: str) -> DataFrame:
    return cells.where((F.col(layer) == 1) & (F.col("weight") < INF))


def _largest(cells: DataFrame) -> int:
    return cells.agg(F.greatest(F.max("rows"), F.max("cols"))).first()[0] or 0


def linked(points: DataFrame, largest: int, diagonal: bool = False) -> DataFrame:
    """map_id, r, c, label of some cells: the map and the first cell of the component they are in, as text that sorts by them.

    largest: side of the largest map, beyond SQUARE of which labels are joined across the sides of squares."""
    labelled = _labelled(points, diagonal)
    if largest <= SQUARE:
        return labelled
    labelled = stored(labelled, "labels")
    met = connected(_seams(labelled, diagonal)).withColumnRenamed("component", "joined")
    return labelled.join(met, F.col("label") == F.col("node"), "left").select("map_id", "r", "c", F.coalesce("joined", "label").alias("label"))


def _labelled(points: DataFrame, diagonal: bool) -> DataFrame:
    """The labels of components within squares."""
    schema = pa.schema([("map_id", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("label", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        top, left, width = int(r.min()), int(c.min()), int(c.max()) - int(c.min()) + 3
        mask = np.zeros((int(r.max()) - top + 3) * width, bool)
        at = (r - top + 1) * width + c - left + 1
        mask[at] = True
        label = labels(mask, width, diagonal)[at]
        name = table.column("map_id")[0].as_py()
        first = [f"{name}\u0001{x // width - 1 + top:010d}{x % width - 1 + left:010d}" for x in label.tolist()]
        return pa.Table.from_arrays([table.column("map_id"), pa.array(r), pa.array(c), pa.array(first)], schema=schema)

    own = points.select(F.col("map_id").cast("string").alias("map_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    square = lambda x: F.floor(F.col(x) / SQUARE)
    return own.groupBy("map_id", square("r").alias("sy"), square("c").alias("sx")).applyInArrow(run, "map_id string, r int, c int, label string")


def _seams(labelled: DataFrame, diagonal: bool = False) -> DataFrame:
    """Edges (a, b) between the labels of cells that touch across the sides of squares."""
    down, right = [(1, 0)], [(0, 1)]
    if diagonal:
        down, right = [(1, -1), (1, 0), (1, 1)], [(-1, 1), (0, 1), (1, 1)]
    on = F.when(F.col("r") % SQUARE == SQUARE - 1, _steps(down)).otherwise(_steps([])), F.when(F.col("c") % SQUARE == SQUARE - 1, _steps(right)).otherwise(_steps([]))
    out = labelled.withColumn("step", F.explode(F.concat(*on)))
    out = out.select("map_id", (F.col("r") + F.col("step.dr")).alias("r"), (F.col("c") + F.col("step.dc")).alias("c"), F.col("label").alias("a"))
    over = labelled.select("map_id", "r", "c", F.col("label").alias("b"))
    return out.join(over, ["map_id", "r", "c"]).where("a <> b").select("a", "b").distinct()


def _steps(offsets: list[tuple[int, int]]):
    return F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets)).cast("array<struct<dr:int,dc:int>>")


def labels(mask: np.ndarray, width: int, diagonal: bool = False) -> np.ndarray:
    """The least flat place of each cell's component, by hooking neighbours' roots and jumping to the root."""
    n = len(mask)
    root = np.arange(n)
    at = np.flatnonzero(mask)
    steps = (1, width, width - 1, width + 1) if diagonal else (1, width)
    a, b = [], []
    for s in steps:
        x = at[at + s < n]
        x = x[mask[x + s]]
        a.append(x)
        b.append(x + s)
    a, b = np.concatenate(a), np.concatenate(b)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        low, high = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def largest_component(cells: DataFrame, layer: str = "gt") -> DataFrame:
    """map_id, r, c of the largest component of each map, the first of equals."""
    all_ = components(cells, layer)
    best = all_.groupBy("map_id").agg(F.max(F.struct("size", (-F.col("comp")).alias("first"))).alias("b")).select("map_id", (-F.col("b.first")).alias("comp"))
    return all_.join(best, ["map_id", "comp"]).select("map_id", "r", "c", "comp", "size")
