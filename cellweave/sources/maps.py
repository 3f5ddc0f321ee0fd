"""Octile map files and generated maps, as tables of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import scans
from cellweave.sources.derived import CELLS

#: The characters of a passable cell.
PASSABLE = (".", "G", "S")


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """cells of all map files below a path or pattern; map_id is the file's name without its ending.

    Files are read as lines, so one huge file is split among tasks by ranges of its bytes; lines are numbered by a scan.
    """
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text(path).select(at[0].alias("map_id"), at[1].alias("block_start"), F.monotonically_increasing_id().alias("within"), F.col("value").alias("line"))
    numbered = scans.running(lines, ["map_id"], [F.col("block_start").asc(), F.col("within").asc()], sums={"n": F.lit(1)})
    name = F.regexp_extract(F.url_decode("map_id"), r"([^/]+?)(\.[^./]*)?$", 1)
    return parse_lines(numbered.select("map_id", "n", "line")).withColumn("map_id", name)


def parse_maps(files: DataFrame) -> DataFrame:
    """cells of map texts (map_id, text); see parse_lines."""
    return parse_lines(files.select("map_id", F.posexplode(F.split("text", "\n")).alias("n", "line")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """cells of maps' lines (map_id, n: rising, one by one, line): everything unknown, weight 1.

    Header lines lose white space at their right; the first that starts with `height` and `width` and a number count, and
    the body begins after the line `map`. Cells that a short or missing line leaves out are obstacles, and more characters
    or lines than the header says are ignored. A text without a positive height and width, or without `map`, has no cells.
    """
    trimmed = F.regexp_replace("line", r"[ \t\r]+$", "")
    number = lambda key: F.regexp_extract(trimmed, rf"^{key}\s+(\d+)", 1).try_cast("int")
    head = lines.where((trimmed == "map") | trimmed.rlike(r"^(height|width)\s+\d")).select("map_id", "n", (trimmed == "map").alias("map"), number("height").alias("rows"), number("width").alias("cols"))
    start = head.where("map").groupBy("map_id").agg(F.min("n").alias("start"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    good = head.join(start, "map_id").where("n < start").groupBy("map_id", "start").agg(first("rows"), first("cols")).where("rows > 0 and cols > 0")
    body = lines.join(good, "map_id").where("n > start and n <= start + rows").select("map_id", (F.col("n") - F.col("start") - 1).cast("int").alias("r"), "line")
    each = good.select("map_id", "rows", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).join(body, ["map_id", "r"], "left")
    cells = each.select("map_id", "rows", "cols", "r", F.coalesce("line", F.lit("")).alias("line"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    free = F.substring("line", F.col("c") + 1, F.lit(1)).isin(*PASSABLE)
    return cells.select("map_id", "rows", "cols", "r", "c", F.when(free, 1).otherwise(2).alias("gt"), F.lit(0).alias("observed"), F.lit(1).alias("weight"))


def revealed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("observed", F.col("gt"))


def grid(spark: SparkSession, map_id: str, rows: int, cols: int, gt: Column | int = 1, observed: Column | int = 0, weight: Column | int = 1) -> DataFrame:
    """A map by expressions over r and c."""
    at = spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("r"), F.expr(f"cast(id % {cols} as int)").alias("c"))
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    out = at.withColumn("gt", as_int(gt)).withColumn("observed", as_int(observed)).withColumn("weight", as_int(weight))
    return out.select(F.lit(map_id).alias("map_id"), F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), "r", "c", "gt", "observed", "weight").select(*CELLS)


def blank(spark: SparkSession, rows: int, cols: int, state: int = 0, map_id: str = "blank") -> DataFrame:
    return grid(spark, map_id, rows, cols, observed=state)


def weighted_walls(spark: SparkSession, n: int = 64, map_id: str = "walls") -> DataFrame:
    """Walls on every 8th row from row 4 but for a gap in every 10th column, and weights from 1 to 20."""
    wall = (F.col("r") % 8 == 4) & (F.col("c") % 10 != 5)
    state = F.when(wall, 2).otherwise(1)
    return grid(spark, map_id, n, n, state, state, 1 + (F.col("r") * 31 + F.col("c") * 17) % 20)


#: The weights of a weighted map of rooms, equally likely.
ROOM_WEIGHTS = (1, 1, 2, 4, 6, 10, 20)


def weighted_rooms(spark: SparkSession, rows: int, cols: int, side: int = 16, seed: int = 42, map_id: str = "rooms") -> DataFrame:
    """Rooms whose passable cells have weights of ROOM_WEIGHTS, chosen by a hash of the cell and the seed."""
    pick = F.pmod((F.col("r").cast("long") * 100_003 + F.col("c")) * 7919 + seed * 31, F.lit(1_000_003)) % len(ROOM_WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, ROOM_WEIGHTS)), (pick + 1).cast("int"))
    return rooms(spark, rows, cols, side, seed, map_id).withColumn("weight", F.when(F.col("gt") == 1, weight).otherwise(F.col("weight")).cast("int"))


def has_weights(cells: DataFrame) -> DataFrame:
    """map_id, has_weights: whether any cell of a map weighs other than 1."""
    return cells.groupBy("map_id").agg(F.bool_or(F.coalesce(F.col("weight"), F.lit(1)) != 1).alias("has_weights"))


def crossed_box(spark: SparkSession, map_id: str = "box") -> DataFrame:
    """64 x 64 within walls, crossed by walls at row and column 32 with gaps at 16 and 48."""
    r, c = F.col("r"), F.col("c")
    edge = (r == 0) | (c == 0) | (r == 63) | (c == 63)
    cross = ((r == 32) & ~c.isin(16, 48)) | ((c == 32) & ~r.isin(16, 48))
    return grid(spark, map_id, 64, 64, F.when(edge | cross, 2).otherwise(1))


class Mersenne64:
    """The 64-bit Mersenne twister of the C++ standard library."""

    #: Fixed values of mt19937_64.
    N, M, UPPER, LOWER = 312, 156, 0xFFFFFFFF80000000, 0x7FFFFFFF
    TWIST, MULTIPLIER = 0xB5026F5AA96619E9, 6364136223846793005

    def __init__(self, seed: int):
        full = (1 << 64) - 1
        self.state = [seed & full]
        while len(self.state) < self.N:
            last = self.state[-1]
            self.state.append((self.MULTIPLIER * (last ^ last >> 62) + len(self.state)) & full)
        self.at = self.N

    def __call__(self) -> int:
        if self.at == self.N:
            for i in range(self.N):
                both = self.state[i] & self.UPPER | self.state[(i + 1) % self.N] & self.LOWER
                self.state[i] = self.state[(i + self.M) % self.N] ^ both >> 1 ^ (self.TWIST if both & 1 else 0)
            self.at = 0
        x = self.state[self.at]
        self.at += 1
        x ^= x >> 29 & 0x5555555555555555
        x ^= x << 17 & 0x71D67FFFEDA60000
        x ^= x << 37 & 0xFFF7EEE000000000
        return x ^ x >> 43


def rooms(spark: SparkSession, rows: int, cols: int, side: int = 16, seed: int = 42, map_id: str = "rooms") -> DataFrame:
    """Rooms of side - 2 cells behind walls two cells thick, each joined to the next in its row and column by one door.

    The doors' places come from the twister in row-major order of the rooms, east before south. Everything is observed.
    """
    side = max(4, side)
    down, across = rows // side, cols // side
    draw = Mersenne64(seed)
    doors = []
    for y in range(down):
        for x in range(across):
            if x + 1 < across:
                place = y * side + 1 + draw() % (side - 2)
                doors += [(place, (x + 1) * side - 1), (place, (x + 1) * side)]
            if y + 1 < down:
                place = x * side + 1 + draw() % (side - 2)
                doors += [((y + 1) * side - 1, place), ((y + 1) * side, place)]
    inner = lambda v, n, whole: (v % side).between(1, side - 2) & (F.floor(v / side) < n) & (v < whole - 1)
    room = inner(F.col("r"), down, rows) & inner(F.col("c"), across, cols)
    base = grid(spark, map_id, rows, cols, F.when(room, 1).otherwise(2))
    if doors:
        holes = spark.createDataFrame(sorted(set(doors)), "r int, c int").withColumn("door", F.lit(True))
        base = base.join(holes, ["r", "c"], "left").withColumn("gt", F.when(F.col("door"), 1).otherwise(F.col("gt"))).select(*CELLS)
    return revealed(base)


def exploration_snapshot(cells: DataFrame, start: tuple[int, int], coverage: float = 0.45, island: float = 0.1, seed: int = 0) -> DataFrame:
    """cells as seen after exploring from start, breadth first, until a share of the free cells is known.

    Walls beside what is known are known. Once 50 cells are, a free cell is passed over for good with the chance `island`.
    A start that is not free is replaced by the first free cell; a map without any is returned as it is. Draws are
    deterministic in the seed, not those of another program. As each draw depends on those before, one task walks a map; it
    gets and gives a few bytes for each cell, in blocks of lines, and no other columns.
    """
    import pyarrow as pa

    block = F.floor(F.col("r") / LINES).cast("int")
    slim = cells.select(F.col("map_id").alias("map_id"), block.alias("block"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.when(F.col("gt").isin(1, 2), F.col("gt")).otherwise(3).cast("byte").alias("gt"))

    def pack(table: pa.Table) -> pa.Table:
        r, c = table.column("r").to_numpy() % LINES, table.column("c").to_numpy()
        width = int(c.max()) + 1
        lines = np.zeros((LINES, width), np.uint8)
        lines[r, c] = table.column("gt").to_numpy()
        return pa.table({"map_id": table.column("map_id")[:1], "block": table.column("block")[:1], "width": pa.array([width], pa.int32()), "lines": pa.array([lines.tobytes()], pa.binary())})

    def walk(table: pa.Table) -> pa.Table:
        blocks, widths = table.column("block").to_pylist(), table.column("width").to_pylist()
        # a border around the map, where nothing is
        truth = np.zeros(((max(blocks) + 1) * LINES + 2, max(widths) + 2), np.uint8)
        for k, (at, width) in enumerate(zip(blocks, widths)):
            truth[at * LINES + 1 : (at + 1) * LINES + 1, 1 : width + 1] = np.frombuffer(table.column("lines")[k].as_buffer(), np.uint8).reshape(LINES, width)
        seen = explored(truth, start, coverage, island, seed)
        if seen is None:
            return pa.table({"map_id": table.column("map_id")[:0], "block": table.column("block")[:0], "width": table.column("width")[:0], "seen": pa.array([], pa.binary())})
        out = [seen[at * LINES + 1 : (at + 1) * LINES + 1, 1 : width + 1].tobytes() for at, width in zip(blocks, widths)]
        return pa.table({"map_id": table.column("map_id"), "block": table.column("block"), "width": table.column("width"), "seen": pa.array(out, pa.binary())})

    packed = slim.groupBy("map_id", "block").applyInArrow(pack, "map_id string, block int, width int, lines binary")
    seen = packed.groupBy("map_id").applyInArrow(walk, "map_id string, block int, width int, seen binary")

    schema = cells.select(*CELLS).schema

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.drop_columns(["block"])
        if not left.num_rows or not right.num_rows:
            return own
        lines = np.frombuffer(right.column("seen")[0].as_buffer(), np.uint8).reshape(LINES, -1)
        at = own.schema.get_field_index("observed")
        states = lines[own.column("r").to_numpy() % LINES, own.column("c").to_numpy()]
        return own.set_column(at, own.schema.field(at), pa.array(states, own.schema.field(at).type, safe=False))

    each = cells.select(*CELLS).withColumn("block", block)
    return each.groupBy("map_id", "block").cogroup(seen.groupBy("map_id", "block")).applyInArrow(mark, schema)


#: Lines of a map that go to the walk of exploration_snapshot as one row.
LINES = 512


def explored(truth: np.ndarray, start: tuple[int, int], coverage: float, island: float, seed: int) -> np.ndarray | None:
    """What is seen (0 nothing, 1 free, 2 wall) of a bordered raster (0 no cell, 1 free, 2 wall, 3 neither); None without a free cell."""
    import random
    from collections import deque

    width = truth.shape[1]
    inside = 0 <= start[0] < len(truth) - 2 and 0 <= start[1] < width - 2
    free = int(np.count_nonzero(truth == 1))
    if not free:
        return None
    cell = truth.tobytes()
    first = (start[0] + 1) * width + start[1] + 1
    if not inside or cell[first] != 1:
        first = cell.index(1)
    want, draw = max(10, int(free * coverage)), random.Random(seed).random
    seen, met, queue, known = bytearray(len(cell)), bytearray(len(cell)), deque([first]), 1
    seen[first] = met[first] = 1
    while queue and known < want:
        at = queue.popleft()
        for near in (at - width, at + width, at - 1, at + 1):
            if met[near] or not cell[near]:
                continue
            met[near] = 1
            if cell[near] == 2:
                seen[near] = 2
            elif not (island > 0 and draw() < island and known > 50):
                seen[near] = 1
                known += 1
                queue.append(near)
                if known >= want:
                    break
    return np.frombuffer(bytes(seen), np.uint8).reshape(truth.shape)


def upscaled(cells: DataFrame, scale: int) -> DataFrame:
    """Each cell as scale x scale cells (1 to 4). The state is what was observed, and the true one where that is unknown."""
    scale = max(1, min(4, scale))
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    state = F.when(F.col("observed") == 0, F.col("gt")).otherwise(F.col("observed"))
    out = cells.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).withColumn("state", state)
    return out.select("map_id", (F.col("rows") * scale).alias("rows"), (F.col("cols") * scale).alias("cols"), (F.col("r") * scale + F.col("dr")).alias("r"), (F.col("c") * scale + F.col("dc")).alias("c"), F.col("state").alias("gt"), F.col("state").alias("observed"), "weight")
