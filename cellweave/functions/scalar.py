"""Scalar expressions on distances, points, tiles, ports and poses. All take and return Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.session import FREE, INF, OBSTACLE


def add_dist(*parts: Column) -> Column:
    """The sum of distances, INF where one is INF or the sum reaches it."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(INF), total)


def manhattan(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.abs(r1 - r2) + F.abs(c1 - c2)


def in_bounds(r: Column, c: Column, rows: Column, cols: Column) -> Column:
    return (r >= 0) & (c >= 0) & (r < rows) & (c < cols)


def cell_index(r: Column, c: Column, cols: Column) -> Column:
    return r * cols + c


def cell_point(index: Column, cols: Column) -> Column:
    return F.struct(F.floor(index / cols).cast("int").alias("r"), (index % cols).cast("int").alias("c"))


def observed_or_wall(observed: Column) -> Column:
    """The state of a cell that was looked up: outside the map is an obstacle."""
    return F.coalesce(observed, F.lit(OBSTACLE))


def is_passable(observed: Column) -> Column:
    return F.coalesce(observed == FREE, F.lit(False))


def cell_weight(observed: Column, weight: Column) -> Column:
    """Obstacles and cells outside are INF; an unknown cell has the weight it is stored with."""
    return F.when(observed_or_wall(observed) == OBSTACLE, INF).otherwise(F.coalesce(weight, F.lit(1)))


def edge_weight(a: Column, b: Column) -> Column:
    half = F.floor((a + b) / 2).cast("int")
    return F.when((a >= INF) | (b >= INF), INF).otherwise(F.greatest(F.lit(1), half))


def tile(x: Column, side: int) -> Column:
    return F.floor(x / side).cast("int")


def local_index(r: Column, c: Column, b: int) -> Column:
    return (r % b) * b + c % b


def ports(r0: Column, c0: Column, side: int) -> Column:
    """The perimeter of a square tile as an array of (idx, r, c): top row, bottom row, left column, right column; corners once."""
    if side < 2:
        raise ValueError("a tile has at least 2 x 2 cells")
    around = [(0, k) for k in range(side)] + [(side - 1, k) for k in range(side)] + [(k, 0) for k in range(1, side - 1)] + [(k, side - 1) for k in range(1, side - 1)]
    return F.array(*[F.struct(F.lit(i).alias("idx"), (r0 + dr).alias("r"), (c0 + dc).alias("c")) for i, (dr, dc) in enumerate(around)])


def port_index(r: Column, c: Column, side: int) -> Column:
    """The place of a cell among its tile's ports, -1 inside the tile."""
    x, y = r % side, c % side
    return F.when(x == 0, y).when(x == side - 1, side + y).when(y == 0, 2 * side + x - 1).when(y == side - 1, 3 * side - 2 + x - 1).otherwise(-1)


def lca_level(r1: Column, c1: Column, r2: Column, c2: Column, b: int, g: int, height: int) -> Column:
    """The lowest level whose tile holds both cells: 0 in one leaf, height + 1 if none does."""
    out = F.lit(height + 1)
    for level in range(height, -1, -1):
        side = b * g**level
        out = F.when((tile(r1, side) == tile(r2, side)) & (tile(c1, side) == tile(c2, side)), level).otherwise(out)
    return out


def world_to_cell(x: Column, y: Column, size: float, rows: Column, cols: Column) -> Column:
    def clamp(v: Column, n: Column) -> Column:
        return F.greatest(F.lit(0), F.least(n - 1, F.floor(v / size).cast("int"))).cast("int")

    return F.struct(clamp(y, rows).alias("r"), clamp(x, cols).alias("c"))


def cell_to_world(r: Column, c: Column, size: float) -> Column:
    return F.struct(((c + 0.5) * size).alias("x"), ((r + 0.5) * size).alias("y"))


def normalize_angle(a: Column) -> Column:
    """The same angle in [-pi, pi]; both ends stay."""
    wrapped = a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi))
    return F.when((a >= -math.pi) & (a <= math.pi), a).otherwise(wrapped)


def ray_step(span_degrees: Column, rays: Column) -> Column:
    """Degrees between the rays of a scanner: a full turn has no closing ray."""
    return F.when(rays <= 1, F.lit(0.0)).when(span_degrees >= 360, span_degrees / rays).otherwise(span_degrees / (rays - 1))


def remaining(waypoints: Column, current: Column) -> Column:
    return F.greatest(F.lit(0), F.size(waypoints) - current)


def current_goal(waypoints: Column, current: Column) -> Column:
    return F.try_element_at(waypoints, (current + 1).cast("int"))


def advance(waypoints: Column, current: Column) -> Column:
    return F.when(current < F.size(waypoints), current + 1).otherwise(current)


def parse_ints(text: Column) -> Column:
    """The integers of a comma-separated list; an item that does not start with a number is 0, an empty item is left out."""
    items = F.filter(F.split(text, ","), lambda x: F.trim(x) != "")
    return F.transform(items, lambda x: F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)))


def join_ints(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")
