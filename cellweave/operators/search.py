"""Exact searches on maps of any size, spread over square tiles.

A tile is one row: the weights of at most SIDE x SIDE cells, 0 where impassable; on maps narrower than SIDE it is so much
longer. A task holds a tile and a few sources, and
keeps for each of them only the distances on the tile's border and at the targets in it. What becomes shorter on a side goes
to the tile beyond, as one line of distances and weights, and is relaxed there. A round takes the tiles whose nearest news is
within a bucket's width of the nearest of all, so that few tiles are searched before their shortest news has come; there are
about as many rounds as a shortest path meets tiles. Maps of one tile take one round and are not written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import INF, stored

#: None: so far off that no way on a map is as long.
FAR = np.int32(1 << 30)
#: Side of a tile, and sources that are searched together.
SIDE, CHUNK = 1024, 4
#: Width of a bucket, in sides of a tile at the mean weight.
BUCKET = 2
#: Rows of a round: STATE holds what a source's search knows in a tile, SEED where it begins, a side what comes over it.
STATE, SEED, SIDES = 0, 1, (2, 3, 4, 5)
#: Per side (top, bottom, left, right): the tile beyond, and the side at which the line arrives there.
BEYOND = ((-1, 0, SIDES[1]), (1, 0, SIDES[0]), (0, -1, SIDES[3]), (0, 1, SIDES[2]))
KEY = ["map_id", "ty", "tx", "chunk"]
ROUND_DDL = "map_id string, ty int, tx int, chunk long, s long, kind int, low int, X binary"
ROUND = pa.schema([("map_id", pa.string()), ("ty", pa.int32()), ("tx", pa.int32()), ("chunk", pa.int64()), ("s", pa.int64()), ("kind", pa.int32()), ("low", pa.int32()), ("X", pa.binary())])


def relax(dist: np.ndarray, weights: np.ndarray, width: int, wave: np.ndarray, unit: bool) -> None:
    """Carry the distances at `wave` on over flat padded rasters, in place; cells are not entered at the distances that they begin with, or beyond.

    Cells move in order of distance, a band at a time, so that few of them move twice; with unit steps a band is one distance.
    Each direction moves different cells to different cells, so a wave is four masked assignments.
    """
    later = wave[:0]
    band = 1 if unit else max(1, int(np.median(weights[weights > 0]))) if len(wave) else 1
    bound = int(dist[wave].min()) + band if len(wave) else 0
    while len(wave) or len(later):
        if len(later) or not unit:
            wave = np.unique(np.concatenate((wave, later)))
        far = dist[wave] >= bound
        if far.all():
            bound = int(dist[wave].min()) + band
            far = dist[wave] >= bound
        wave, later = wave[~far], wave[far]
        moved = []
        for step in (-width, width, -1, 1):
            to = wave + step
            on = weights[to] > 0
            at, to = wave[on], to[on]
            new = dist[at] + (1 if unit else np.maximum(1, (weights[at] + weights[to]) // 2))
            nearer = new < dist[to]
            dist[to[nearer]] = new[nearer]
            moved.append(to[nearer])
        wave = np.concatenate(moved)


def border(h: int, w: int) -> list[np.ndarray]:
    """Places in a padded raster of the cells along each side of an h x w tile."""
    row = lambda r: (r + 1) * (w + 2) + 1 + np.arange(w)
    column = lambda c: (np.arange(h) + 1) * (w + 2) + 1 + c
    return [row(0), row(h - 1), column(0), column(w - 1)]


def extent(rows: int, cols: int, side: int) -> tuple[int, int]:
    """Height and width of the tiles of maps of at most so many rows and columns: side x side cells, in one strip if the maps fit."""
    if 0 < cols < side:
        return side * side // cols, side
    if 0 < rows < side:
        return side, side * side // rows
    return side, side


def tile_rows(cells: DataFrame, layer: str, tall: int, wide: int) -> DataFrame:
    """map_id, ty, tx, rows, cols, grid: the weights of each tile with a passable cell, row-major."""

    def build(table: pa.Table) -> pa.Table:
        name, ty, tx, rows, cols = (table.column(c)[0].as_py() for c in ("map_id", "ty", "tx", "rows", "cols"))
        h, w = min(tall, rows - ty * tall), min(wide, cols - tx * wide)
        grid = np.zeros(h * w, np.int32)
        grid[(table.column("r").to_numpy() - ty * tall) * w + table.column("c").to_numpy() - tx * wide] = table.column("w").to_numpy()
        return pa.table({"map_id": pa.array([name], pa.string()), "ty": pa.array([ty], pa.int32()), "tx": pa.array([tx], pa.int32()), "rows": pa.array([rows], pa.int32()), "cols": pa.array([cols], pa.int32()), "grid": pa.array([grid.tobytes()], pa.binary())})

    free = cells.where((F.col(layer) == 1) & (F.col("weight") < INF))
    slim = free.select(F.col("map_id").cast("string").alias("map_id"), *_tile(tall, wide), F.col("rows").cast("int"), F.col("cols").cast("int"), F.col("r").cast("int"), F.col("c").cast("int"), F.greatest("weight", F.lit(1)).cast("int").alias("w"))
    return slim.groupBy("map_id", "ty", "tx").applyInArrow(build, "map_id string, ty int, tx int, rows int, cols int, grid binary")


def _tile(tall: int, wide: int) -> list:
    return [F.floor(F.col(x) / side).cast("int").alias(t) for x, t, side in (("r", "ty", tall), ("c", "tx", wide))]


def _points(points: DataFrame) -> DataFrame:
    return points.select(F.col("map_id").cast("string").alias("map_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct()


def distances(cells: DataFrame, sources: DataFrame, targets: DataFrame, weighted: bool = False, layer: str = "observed", side: int | None = None, far: int = INF) -> DataFrame:
    """map_id, sr, sc, r, c, d: the distances under `far` from the cells in sources to those in targets (map_id, r, c, repeats ignored)."""
    shape = cells.agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), F.avg(F.when(F.col("weight") < INF, F.col("weight"))).alias("mean")).first()
    rows, cols = shape["rows"] or 0, shape["cols"] or 0
    tall, wide = extent(rows, cols, side or SIDE)
    inside = cells.select(F.col("map_id").cast("string").alias("map_id"), "rows", "cols").distinct()
    on_map = (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("rows")) & (F.col("c") < F.col("cols"))
    place = ((F.col("r") % tall) * F.least(F.lit(wide), F.col("cols") - F.floor(F.col("c") / wide) * wide) + F.col("c") % wide).cast("int")
    placed = lambda t: _points(t).join(inside, "map_id").where(on_map).select("map_id", *_tile(tall, wide), (F.col("r").cast("long") * F.col("cols") + F.col("c")).alias("s"), place.alias("place"))
    many = placed(sources).withColumn("n", F.lit(1))
    count = many.groupBy("map_id").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    seeds = many.join(count, "map_id").select("map_id", "ty", "tx", F.pmod(F.xxhash64("s"), "chunks").alias("chunk"), "s", F.lit(SEED).alias("kind"), F.lit(0).alias("low"), F.expr("unhex(lpad(hex(place), 8, '0'))").alias("X"))
    goals = placed(targets).groupBy("map_id", "ty", "tx").agg(F.array_sort(F.collect_list("place")).alias("goals"))  # different cells of a tile
    tiles = tile_rows(cells, layer, tall, wide).join(goals, ["map_id", "ty", "tx"], "left")
    step = _stepper(tall, wide, weighted, np.int32(far))
    tile = KEY[:3]
    if rows <= tall and cols <= wide:
        now = _round(seeds, tiles, step)
    else:
        tiles = stored(tiles, "tiles")
        width = max(1, int(BUCKET * max(tall, wide) * (float(shape["mean"] or 1) if weighted else 1)))
        now = stored(seeds, "seeds")
        while (low := now.where(F.col("kind") != STATE).agg(F.min("low")).first()[0]) is not None:
            due = now.where((F.col("kind") != STATE) & (F.col("low") < low + width)).select(*KEY).distinct()
            done = _round(now.join(due, KEY, "left_semi"), tiles.join(due.select(*tile).distinct(), tile, "left_semi"), step)
            now = stored(now.join(due, KEY, "left_anti").select(*ROUND.names).union(done), "round")
    known = now.where(F.col("kind") == STATE).join(tiles.select(*tile, "cols", "rows", "goals"), tile)
    out = pa.schema([("map_id", pa.string()), ("sr", pa.int32()), ("sc", pa.int32()), ("r", pa.int32()), ("c", pa.int32()), ("d", pa.int32())])

    def spell(batches):
        for batch in batches:
            for k, x in enumerate(batch.drop_columns(["goals"]).to_pylist()):
                goals = _list(batch.column("goals")[k])
                h, w = min(tall, x["rows"] - x["ty"] * tall), min(wide, x["cols"] - x["tx"] * wide)
                d = np.frombuffer(x["X"], "<i4")[2 * (h + w) :]
                on = np.flatnonzero(d < far)
                r, c = goals[on] // w + x["ty"] * tall, goals[on] % w + x["tx"] * wide
                yield pa.RecordBatch.from_arrays([pa.array([x["map_id"]] * len(on), pa.string()), *(pa.array(np.full(len(on), v, np.int32)) for v in divmod(x["s"], x["cols"])), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(d[on])], schema=out)

    slim = known.where("goals is not null").select("map_id", "ty", "tx", "rows", "cols", "s", "X", "goals")
    return slim.mapInArrow(spell, "map_id string, sr int, sc int, r int, c int, d int")


def _list(cell: pa.ListScalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).astype(np.int64) if cell.is_valid else np.zeros(0, np.int64)


def _round(rows: DataFrame, tiles: DataFrame, step) -> DataFrame:
    """What each tile's searches know after they took the rows in, and what they send."""
    chunks = rows.select(*KEY).distinct()
    met = tiles.join(chunks, KEY[:3])
    met = met.select(*(F.col(c).alias(c) for c in met.columns))  # columns of its own, for the cogroup
    return rows.groupBy(*KEY).cogroup(met.groupBy(*KEY)).applyInArrow(step, ROUND_DDL)


def _stepper(tall: int, wide: int, weighted: bool, far: np.int32):
    """far: where the search ends."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return ROUND.empty_table()  # no cell of the tile is passable
        name, ty, tx, rows, cols = (right.column(c)[0].as_py() for c in ("map_id", "ty", "tx", "rows", "cols"))
        chunk = left.column("chunk")[0].as_py()
        h, w = min(tall, rows - ty * tall), min(wide, cols - tx * wide)
        weights = np.zeros((h + 2, w + 2), np.int32)
        weights[1:-1, 1:-1] = np.frombuffer(right.column("grid")[0].as_py(), "<i4").reshape(h, w)
        weights = weights.ravel()
        edges = border(h, w)
        goals = _list(right.column("goals")[0])
        goals = (goals // w + 1) * (w + 2) + goals % w + 1
        sources = sorted(set(left.column("s").to_pylist()))
        known = np.full((len(sources), 2 * (h + w) + len(goals)), far, np.int32)
        dist = np.full((len(sources), len(weights)), far, np.int32)
        news = []
        for s, kind, blob in zip(*(left.column(c).to_pylist() for c in ("s", "kind", "X"))):
            k = sources.index(s)
            if kind == STATE:
                known[k] = np.frombuffer(blob, "<i4")
            elif kind == SEED:
                at = int.from_bytes(blob, "big")
                at = np.array([(at // w + 1) * (w + 2) + at % w + 1])
                news.append((k, at[weights[at] > 0], np.zeros(1, np.int32)))
            else:
                value, heavy = np.frombuffer(blob, "<i4").reshape(2, -1)
                at = edges[kind - SIDES[0]]
                on = np.flatnonzero((value < far) & (weights[at] > 0))
                cost = np.maximum(1, (heavy[on] + weights[at[on]]) // 2) if weighted else 1
                news.append((k, at[on], value[on] + cost))
        places = np.concatenate([*edges, goals])
        for k in range(len(sources)):  # known distances bar what is no nearer
            dist[k, places] = known[k]
        dist = dist.ravel()
        waves = [np.zeros(0, np.int64)]
        for k, at, value in news:
            at = at + k * len(weights)
            nearer = value[: len(at)] < dist[at]
            dist[at[nearer]] = value[: len(at)][nearer]
            waves.append(at[nearer])
        relax(dist, np.tile(weights, len(sources)), w + 2, np.unique(np.concatenate(waves)), not weighted)
        new = dist.reshape(len(sources), -1)[:, places]
        out = []
        for k, s in enumerate(sources):
            out.append((name, ty, tx, chunk, s, STATE, INF, new[k].tobytes()))
            at = 0
            for edge, (dy, dx, there) in zip(edges, BEYOND):
                line, old = new[k, at : at + len(edge)], known[k, at : at + len(edge)]
                at += len(edge)
                tell = line < old
                if tell.any() and 0 <= (ty + dy) * tall < rows and 0 <= (tx + dx) * wide < cols:
                    value = np.where(tell, line, far)
                    out.append((name, ty + dy, tx + dx, chunk, s, there, int(value.min()), np.concatenate((value, weights[edge])).astype("<i4").tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ROUND)], schema=ROUND)

    return step


def matrix(cells: DataFrame, viewpoints: DataFrame, weighted: bool = False, zero_diagonal: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """map_id, i, j, d over viewpoints (map_id, i, r, c): the search from every viewpoint, or from `sources`, to all of its map.

    d is INF (60000) where there is no path or it is that long, on the whole row, column and diagonal of an impassable
    viewpoint too, unless zero_diagonal. Viewpoints outside the map are impassable, duplicates are rows of their own, and a
    map without cells gives INF.
    """
    slim = lambda t: t.select(F.col("map_id").cast("string").alias("map_id"), F.col("i").cast("int").alias("i"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    points, starts = slim(viewpoints), slim(viewpoints if sources is None else sources)
    found = distances(cells, starts, points, weighted)
    both = starts.select("map_id", "i", F.col("r").alias("sr"), F.col("c").alias("sc")).join(points.withColumnRenamed("i", "j"), "map_id")
    d = F.coalesce("d", F.lit(INF)).cast("int")
    if zero_diagonal:
        d = F.when(F.col("i") == F.col("j"), 0).otherwise(d)
    return both.join(found, ["map_id", "sr", "sc", "r", "c"], "left").select("map_id", "i", "j", d.alias("d"))


def pairs(cells: DataFrame, wanted: DataFrame, weighted: bool = False) -> DataFrame:
    """wanted (map_id, id, r1, c1, r2, c2) with d: one search for each different source, to the targets of all of its map."""
    end = lambda k: wanted.select("map_id", F.col(f"r{k}").alias("r"), F.col(f"c{k}").alias("c"))
    found = distances(cells, end(1), end(2), weighted).select("map_id", F.col("sr").alias("r1"), F.col("sc").alias("c1"), F.col("r").alias("r2"), F.col("c").alias("c2"), "d")
    return wanted.join(found, ["map_id", "r1", "c1", "r2", "c2"], "left").select(*(wanted[c] for c in wanted.columns), F.coalesce("d", F.lit(INF)).cast("int").alias("d"))


def one_to_many(cells: DataFrame, source: tuple[int, int], targets: DataFrame, weighted: bool = False) -> DataFrame:
    """targets (map_id, j, r, c) with d from one cell of each map, however long the way; INF where there is none."""
    start = targets.select("map_id").distinct().withColumns({"r": F.lit(source[0]), "c": F.lit(source[1])})
    found = distances(cells, start, targets, weighted, far=int(FAR)).select("map_id", "r", "c", "d")
    return targets.select("map_id", "j", "r", "c").join(found, ["map_id", "r", "c"], "left").select("map_id", "j", "r", "c", F.coalesce("d", F.lit(INF)).cast("int").alias("d"))
