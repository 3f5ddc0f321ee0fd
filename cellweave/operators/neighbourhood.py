"""Windows over space: clearance, frontiers, proximity, line of sight, footprints and snapping.

Neighbours meet by scattering: the few cells that matter (obstacles, unknown cells) are exploded to the cells around them
and met with the map in one aggregation by (map_id, r, c). No operator compares cells pairwise.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions import scalar
from cellweave.session import stored

KEY = ["map_id", "r", "c"]
FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = tuple((a, b) for a, b in itertools.product((-1, 0, 1), repeat=2) if a or b)


def square(radius: int, centre: bool = False) -> tuple[tuple[int, int], ...]:
    return tuple((a, b) for a, b in itertools.product(range(-radius, radius + 1), repeat=2) if centre or a or b)


def scatter(df: DataFrame, offsets, *carry: Column | str) -> DataFrame:
    """Each row once for every offset, moved by it; dr and dc are kept."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])).alias("o")
    return df.select("*", around).select("map_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), *carry)


def clearance(cells: DataFrame) -> DataFrame:
    """cells with clr: 0 impassable, else the Chebyshev distance to the nearest obstacle or map edge, 3 if over 2."""
    walls = scatter(cells.where("observed = 2"), square(2)).select(*KEY, F.greatest(F.abs("dr"), F.abs("dc")).alias("near"))
    near = walls.groupBy(*KEY).agg(F.min("near").alias("near"))
    edge = F.least(F.col("r") + 1, F.col("c") + 1, F.col("rows") - F.col("r"), F.col("cols") - F.col("c"))
    clr = F.when(scalar.is_passable(F.col("observed")), F.least(F.coalesce("near", F.lit(3)), edge, F.lit(3))).otherwise(0)
    return cells.join(near, KEY, "left").withColumn("clr", clr.cast("int")).drop("near")


def frontier_cells(cells: DataFrame) -> DataFrame:
    """map_id, r, c, clr of free cells that border on a region of unknown cells worth going to.

    At least one unknown 4-neighbour, and one that itself has two; 4 unknown cells in the 5 x 5 square; and next to a wall
    (clearance 1) fewer than 6 obstacles and at least 6 unknown cells there. Outside the map counts as an obstacle.
    """
    seen = clearance(cells)
    unknown = cells.where("observed = 0").select(*KEY)
    beside = scatter(unknown, FOUR).groupBy(*KEY).agg(F.count("*").alias("u4"))
    deep = unknown.join(beside.where("u4 >= 2"), KEY, "left_semi")
    one, no = F.lit(1).cast("int"), F.lit(0).cast("int")
    states = scatter(cells.where("observed <> 1"), square(2), "observed")
    near = F.when((F.abs("dr") + F.abs("dc") == 1) & (F.col("observed") == 0), one).otherwise(no)
    marks = states.select(*KEY, near.alias("n4"), (F.col("observed") == 0).cast("int").alias("unk"), (F.col("observed") == 2).cast("int").alias("obst"), no.alias("deep"))
    marks = marks.unionByName(scatter(deep, FOUR).select(*KEY, no.alias("n4"), no.alias("unk"), no.alias("obst"), one.alias("deep")))
    counts = marks.groupBy(*KEY).agg(*[F.sum(x).alias(x) for x in ("n4", "unk", "obst", "deep")])
    inside_r = F.least(F.col("r"), F.lit(2)) + F.least(F.col("rows") - 1 - F.col("r"), F.lit(2)) + 1
    inside_c = F.least(F.col("c"), F.lit(2)) + F.least(F.col("cols") - 1 - F.col("c"), F.lit(2)) + 1
    walls = F.col("obst") + 25 - inside_r * inside_c
    ok = (F.col("n4") > 0) & (F.col("unk") >= 4) & (F.col("deep") > 0) & ~((F.col("clr") <= 1) & ((walls >= 6) | (F.col("unk") < 6)))
    return seen.where("observed = 1").join(counts, KEY).where(ok).select(*KEY, "clr")


def seam_edges(cells: DataFrame, side: int) -> DataFrame:
    """map_id, r, c, r2, c2, w: passable neighbours that lie in different tiles of a side, the lower or left one first."""
    free = cells.where("observed = 1").select(*KEY, "weight")
    out = scatter(free, ((1, 0), (0, 1)), (F.col("r")).alias("r1"), F.col("c").alias("c1"), F.col("weight").alias("w1"))
    crossing = (scalar.tile(F.col("r1"), side) != scalar.tile(F.col("r"), side)) | (scalar.tile(F.col("c1"), side) != scalar.tile(F.col("c"), side))
    met = out.where(crossing).join(free, KEY)
    return met.select("map_id", F.col("r1").alias("r"), F.col("c1").alias("c"), F.col("r").alias("r2"), F.col("c").alias("c2"), scalar.edge_weight(F.col("w1"), F.col("weight")).alias("w"))


def area_explored(points: DataFrame, cells: DataFrame, radius: int = 4) -> DataFrame:
    """points (map_id, r, c, ...) with explored: no unknown cell in the square around; true for points outside their map."""
    size = cells.groupBy("map_id").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"))
    open_ = scatter(cells.where("observed = 0").select(*KEY), square(radius, True)).select(*KEY).distinct().withColumn("open", F.lit(True))
    valid = scalar.in_bounds(F.col("r"), F.col("c"), F.col("rows"), F.col("cols"))
    return points.join(size, "map_id", "left").join(open_, KEY, "left").withColumn("explored", ~F.coalesce(valid, F.lit(False)) | F.col("open").isNull()).drop("rows", "cols", "open")


def area_visited(points: DataFrame, robots: DataFrame, cells: DataFrame, radius: int = 4) -> DataFrame:
    """The same where nothing is hidden: points (map_id, r, c, ...) with explored: a robot (map_id, r, c) is within radius + 2."""
    size = cells.groupBy("map_id").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"))
    near = scatter(robots.select(*KEY), square(radius + 2, True)).select(*KEY).distinct().withColumn("near", F.lit(True))
    valid = scalar.in_bounds(F.col("r"), F.col("c"), F.col("rows"), F.col("cols"))
    return points.join(size, "map_id", "left").join(near, KEY, "left").withColumn("explored", ~F.coalesce(valid, F.lit(False)) | F.col("near").isNotNull()).drop("rows", "cols", "near")


def nearest_passable(points: DataFrame, cells: DataFrame, radii: tuple[int, ...] = (16, 32)) -> DataFrame:
    """points (map_id, id, r, c) with (snap_r, snap_c): the cell itself if passable, else the nearest passable one by squared
    distance within the first radius that has any, in row-major order among equals, else the point.

    Most points have one beside them: nothing outside the 3 x 3 square is as near. Only the others meet whole bins of cells."""
    free = cells.where("observed = 1").select(*KEY)
    beside = scatter(points, square(1, True), "id").join(free, KEY).groupBy("map_id", "id")
    first = F.struct((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"), F.col("r").alias("fr"), F.col("c").alias("fc"))
    beside = stored(beside.agg(F.min(first).alias("m")).select("map_id", "id", "m.fr", "m.fc"), "beside")
    reach = max(radii)
    bins = lambda x: F.floor(x / reach).cast("int")
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    p = points.join(beside, ["map_id", "id"], "left_anti").select("map_id", "id", "r", "c").withColumn("br", F.explode(F.transform(steps, lambda k: bins(F.col("r")) + k))).withColumn("bc", F.explode(F.transform(steps, lambda k: bins(F.col("c")) + k)))
    f = free.select("map_id", F.col("r").alias("fr"), F.col("c").alias("fc"), bins(F.col("r")).alias("br"), bins(F.col("c")).alias("bc"))
    dr, dc = F.col("fr") - F.col("r"), F.col("fc") - F.col("c")
    away = F.greatest(F.abs(dr), F.abs(dc))
    ring = F.lit(len(radii))
    for i, radius in reversed(list(enumerate(sorted(radii)))):
        ring = F.when(away <= radius, i).otherwise(ring)
    exact = (F.when(away == 0, -1).otherwise(ring)).alias("ring")
    near = p.join(f, ["map_id", "br", "bc"]).where(away <= reach).groupBy("map_id", "id").agg(F.min(F.struct(exact, (dr * dr + dc * dc).alias("d2"), F.col("fr"), F.col("fc"))).alias("m"))
    found = beside.union(near.select("map_id", "id", "m.fr", "m.fc"))
    return points.join(found, ["map_id", "id"], "left").select(*points.columns, F.coalesce("fr", "r").alias("snap_r"), F.coalesce("fc", "c").alias("snap_c"))


def _under(poses: DataFrame, size: float) -> DataFrame:
    """poses (x, y, radius, and more) once for each cell r, c under the disc of min(radius, 0.38 size)."""
    eff = F.least(F.col("radius"), F.lit(0.38 * size))
    span = lambda v: F.sequence(F.floor((v - eff) / size).cast("int"), F.floor((v + eff) / size).cast("int"))
    return poses.withColumn("r", F.explode(span(F.col("y")))).withColumn("c", F.explode(span(F.col("x")))).where(_touches("x", "y", size))


def _touches(x: str, y: str, size: float) -> Column:
    """Whether the disc of min(radius, 0.38 size) at a place meets the inside of the cell r, c."""
    eff = F.least(F.col("radius"), F.lit(0.38 * size))
    gap = lambda v, k: F.greatest(k * size - v, v - (k + 1) * size, F.lit(0.0))
    dx, dy = gap(F.col(x), F.col("c")), gap(F.col(y), F.col("r"))
    return dx * dx + dy * dy < eff * eff


def _all_passable(under: DataFrame, cells: DataFrame) -> DataFrame:
    """map_id, id, clear: whether all cells that an id asks for (map_id, id, r, c) are passable."""
    state = under.select("map_id", "id", "r", "c").join(cells.select(*KEY, "observed"), KEY, "left")
    return state.groupBy("map_id", "id").agg(F.bool_and(scalar.is_passable(F.col("observed"))).alias("clear"))


def footprint_clear(poses: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """poses (map_id, id, x, y, radius) with clear: no impassable cell, nor the outside, under the disc of min(radius, 0.38 size)."""
    verdict = _all_passable(_under(poses.select("map_id", "id", "x", "y", "radius"), size), cells)
    return poses.join(verdict, ["map_id", "id"], "left").withColumn("clear", F.coalesce("clear", F.lit(True)))


def segment_clear(segments: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """segments (map_id, id, x1, y1, x2, y2, radius) with clear: every footprint along the way, in steps of min(0.35 size, 0.035), is clear.

    A footprint asks only for the cells that the one before it did not lie on, so a segment asks once for each cell under it."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(1), F.ceil(length / min(0.35 * size, 0.035)).cast("int"))
    along = segments.select("map_id", "id", "x1", "y1", "x2", "y2", "radius", n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    place = lambda v, k: F.col(f"{v}1") + k / F.col("n") * (F.col(f"{v}2") - F.col(f"{v}1"))
    k = F.col("k")
    poses = along.select("map_id", "id", "radius", "k", place("x", k).alias("x"), place("y", k).alias("y"), place("x", k - 1).alias("px"), place("y", k - 1).alias("py"))
    under = _under(poses, size).where((k == 0) | ~_touches("px", "py", size))
    asked = segments.dropna(subset=["map_id", "id", "x1", "y1", "x2", "y2"])
    return asked.join(_all_passable(under, cells), ["map_id", "id"], "left").withColumn("clear", F.coalesce("clear", F.lit(True)))


def line_of_sight(pairs: DataFrame, cells: DataFrame, corners: bool = False) -> DataFrame:
    """pairs (map_id, id, r1, c1, r2, c2) with visible: all cells of the digital line are passable.

    The line takes one cell for each step along its longer axis, halves rounded away from the start. corners: a diagonal
    step also needs both cells beside it, by the true layer.
    """
    dr, dc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    n = F.greatest(F.abs(dr), F.abs(dc))
    ray = pairs.select("map_id", "id", "r1", "c1", dr.alias("dr"), dc.alias("dc"), n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))

    def at(start: str, step: str, k: Column) -> Column:
        whole = F.floor((2 * k * F.abs(step) + F.col("n")) / F.greatest(2 * F.col("n"), F.lit(1))).cast("int")
        return F.col(start) + F.signum(step).cast("int") * whole

    k = F.col("k")
    ray = ray.withColumn("r", at("r1", "dr", k)).withColumn("c", at("c1", "dc", k)).withColumn("pr", at("r1", "dr", F.greatest(k - 1, F.lit(0)))).withColumn("pc", at("c1", "dc", F.greatest(k - 1, F.lit(0))))
    need = ray.select("map_id", "id", "r", "c")
    if corners:
        turned = ray.where("r <> pr and c <> pc")
        need = need.unionByName(turned.select("map_id", "id", "r", F.col("pc").alias("c"))).unionByName(turned.select("map_id", "id", F.col("pr").alias("r"), "c"))
    free = F.col("gt") == 1 if corners else F.col("observed") == 1
    seen = need.join(cells.select(*KEY, "gt", "observed"), KEY, "left").groupBy("map_id", "id").agg(F.bool_and(F.coalesce(free, F.lit(False))).alias("visible"))
    return pairs.join(seen, ["map_id", "id"])


def update_cells(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply updates (map_id, r, c, seq, op, weight): open, block, reveal (take the true state) or reweight; per cell and kind
    the last by seq wins, and updates outside the map are ignored."""
    kind = F.when(F.col("op") == "reweight", "w").otherwise("s")
    last = updates.groupBy(*KEY, kind.alias("kind")).agg(F.max_by(F.struct("op", F.col("weight").alias("new")), "seq").alias("u"))
    by_cell = last.groupBy(*KEY).agg(F.max(F.when(F.col("kind") == "s", F.col("u.op"))).alias("op"), F.max(F.when(F.col("kind") == "w", F.col("u.new"))).alias("new"))
    state = F.when(F.col("op") == "open", 1).when(F.col("op") == "block", 2).when(F.col("op") == "reveal", F.col("gt")).otherwise(F.col("observed"))
    out = cells.join(by_cell, KEY, "left")
    return out.withColumn("observed", state.cast("int")).withColumn("weight", F.coalesce("new", "weight").cast("int")).drop("op", "new")


def revealed_except(cells: DataFrame, withheld: DataFrame) -> DataFrame:
    """Every cell observed as it is, but free cells that are withheld (map_id, r, c) are unknown."""
    held = withheld.select(*KEY).distinct().withColumn("held", F.lit(True))
    state = F.when(F.col("gt") == 2, 2).when((F.col("gt") == 1) & F.col("held").isNull(), 1).otherwise(0)
    return cells.join(held, KEY, "left").withColumn("observed", state.cast("int")).drop("held")


def tile_order(cells: DataFrame, side: int) -> Column:
    """The row-major number of a cell's tile in its map."""
    across = F.ceil(F.col("cols") / side)
    return (scalar.tile(F.col("r"), side) * across + scalar.tile(F.col("c"), side)).cast("int")


def ranked(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
