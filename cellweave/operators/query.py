"""Distances through the tile index.

A viewpoint is lifted level by level: its distances to the ports of its tile, then to those of the tile above, and so on. At
every node two lifted viewpoints meet across the node's D; the least meeting over all levels is their distance, since a
shortest path may leave their common tile. Each level is one grouped kernel, keyed by node, that gets the node's D and the
lifts of the viewpoints inside. A few viewpoints climb through all levels in one kernel a root instead, over the nodes that
they pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import search
from cellweave.operators.tiles import FAR, KEY, Index, border, branch, edge_weights, matrix_of, perimeter, places
from cellweave.session import INF, stored

POINT = ["map_id", "query_id", "i"]
LIFT_DDL = "map_id string, lvl int, tx int, ty int, query_id string, i int, j int, d int, X binary"
LIFT = pa.schema([("map_id", pa.string()), ("lvl", pa.int32()), ("tx", pa.int32()), ("ty", pa.int32()), ("query_id", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("d", pa.int32()), ("X", pa.binary())])
#: Products up to which two sides of a min-plus product are compared at once.
BLOCK = 1 << 22
#: Viewpoints that climb in one kernel, and bytes of the nodes that they pass, at most.
FEW, MOST_BYTES = 256, 64 << 20


def min_plus_dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """out[i, j] = min over k of a[i, k] + b[k, j], at most FAR; places that no row of a reaches are left out."""
    on = np.flatnonzero((a < FAR).any(axis=0))
    a, b = a[:, on], b[on]
    out = np.full((len(a), b.shape[1]), FAR, np.int32)
    step = max(1, BLOCK // max(1, b.size))
    for k in range(0, len(a), step):
        if len(on):
            out[k : k + step] = np.minimum((a[k : k + step, :, None] + b[None]).min(axis=1), FAR)
    return out


def min_plus(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, d: the min-plus product of sparse matrices a (i, k, w) and b (k, j, w), without entries that reach INF."""
    left, right = a.select("i", "k", F.col("w").alias("w1")), b.select("k", "j", F.col("w").alias("w2"))
    total = F.col("w1") + F.col("w2")
    return left.join(right, "k").where(total < INF).groupBy("i", "j").agg(F.min(total).cast("int").alias("d"))


def rank_one(dist: DataFrame, edges: DataFrame) -> DataFrame:
    """i, j, d after one edge (u, v, w) is added to the full matrix dist (i, j, d), both ways; not shorter edges change nothing."""
    from_u = dist.join(edges, dist["i"] == edges["u"]).select("w", "v", F.col("j").alias("to"), F.col("d").alias("du"))
    from_v = dist.join(edges, dist["i"] == edges["v"]).select(F.col("j").alias("to"), F.col("d").alias("dv"))
    ends = from_u.join(from_v, "to").select("w", "to", "du", "dv")
    a = ends.select("w", F.col("to").alias("i"), F.col("du").alias("iu"), F.col("dv").alias("iv"))
    b = ends.select(F.col("to").alias("j"), F.col("du").alias("ju"), F.col("dv").alias("jv"))
    through = F.least(F.col("iu") + F.col("w") + F.col("jv"), F.col("iv") + F.col("w") + F.col("ju"))
    return dist.join(a, "i").join(b, "j").select("i", "j", F.least("d", through, F.lit(INF)).cast("int").alias("d"))


def summary_decreases(old: DataFrame, new: DataFrame) -> DataFrame:
    """i, j, w of the entries that became smaller, in both directions."""
    return new.join(old.select("i", "j", F.col("d").alias("was")), ["i", "j"]).where("d < was").select("i", "j", F.col("d").alias("w"))


def exploded(rows: DataFrame, what: str = "D") -> DataFrame:
    """map_id, lvl, tx, ty, u, v, d: the finite entries of blobs, for small grids."""
    schema = pa.schema([("map_id", pa.string()), ("lvl", pa.int32()), ("tx", pa.int32()), ("ty", pa.int32()), ("u", pa.int32()), ("v", pa.int32()), ("d", pa.int32())])

    def run(batches):
        for batch in batches:
            for m, k, x, y, blob in zip(*(c.to_pylist() for c in batch.columns)):
                dist = matrix_of(blob)
                u, v = np.nonzero(dist < FAR)
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(u), pa.string()), *(pa.array(np.full(len(u), z, np.int32)) for z in (k, x, y)), *(pa.array(z.astype(np.int32)) for z in (u, v, dist[u, v]))], schema=schema)

    return rows.select(*KEY, what).mapInArrow(run, "map_id string, lvl int, tx int, ty int, u int, v int, d int")


def _emit(key: tuple, queries: list, i: np.ndarray, lifted: np.ndarray, dist: np.ndarray) -> pa.Table:
    """The lifts of a tile's viewpoints, and the finite distances between those of one query."""
    rows = [(*key, q, int(k), None, None, np.ascontiguousarray(x, "<i4").tobytes()) for q, k, x in zip(queries, i, lifted)]
    by: dict[str, list[int]] = {}
    for n, q in enumerate(queries):
        by.setdefault(q, []).append(n)
    for q, mine in by.items():
        part = dist[np.ix_(mine, mine)]
        a, b = np.nonzero(part < FAR)
        rows += [(*key, q, x, y, d, None) for x, y, d in zip(i[np.array(mine)[a]].tolist(), i[np.array(mine)[b]].tolist(), part[a, b].tolist())]
    columns = list(zip(*rows)) if rows else [()] * len(LIFT)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LIFT)], schema=LIFT)


def _leaf_step(points: DataFrame, leaves: DataFrame, b: int) -> DataFrame:
    ports = _ports(b)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return LIFT.empty_table()
        dist = matrix_of(right.column("D")[0].as_py())
        at = (left.column("r").to_numpy() % b) * b + left.column("c").to_numpy() % b
        own = ports[np.frombuffer(right.column("E")[0].as_py(), "<i4")]
        key = (left.column("map_id")[0].as_py(), 0, left.column("tx")[0].as_py(), left.column("ty")[0].as_py())
        return _emit(key, left.column("query_id").to_pylist(), left.column("i").to_numpy(), dist[np.ix_(at, own)], dist[np.ix_(at, at)])

    own = points.withColumn("tx", F.floor(F.col("r") / b).cast("int")).withColumn("ty", F.floor(F.col("c") / b).cast("int"))
    return own.groupBy("map_id", "tx", "ty").cogroup(leaves.groupBy("map_id", "tx", "ty")).applyInArrow(run, LIFT_DDL)


def _ports(b: int) -> np.ndarray:
    from cellweave.operators.tiles import perimeter

    r, c = perimeter(b)
    return r * b + c


def _node_step(lifts: DataFrame, nodes: DataFrame, level: int, side: int, g: int) -> DataFrame:
    """side: of the level below."""
    n = 4 * side - 4

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return LIFT.empty_table()
        dist = matrix_of(right.column("D")[0].as_py())
        active = np.frombuffer(right.column("A")[0].as_py(), "<i4")
        ext, child = border(active, side, g)[1], active // n
        a = np.full((left.num_rows, len(dist)), FAR, np.int32)
        for row, (x, y, blob) in enumerate(zip(*(left.column(c).to_pylist() for c in ("cx", "cy", "X")))):
            q = (x % g) * g + y % g
            a[row, child == q] = np.frombuffer(blob, "<i4")
        through = min_plus_dense(a, dist)
        key = (left.column("map_id")[0].as_py(), level, left.column("tx")[0].as_py(), left.column("ty")[0].as_py())
        return _emit(key, left.column("query_id").to_pylist(), left.column("i").to_numpy(), through[:, ext], min_plus_dense(through, np.ascontiguousarray(a.T)))

    up = lifts.select("map_id", F.floor(F.col("tx") / g).cast("int").alias("tx"), F.floor(F.col("ty") / g).cast("int").alias("ty"), F.col("tx").alias("cx"), F.col("ty").alias("cy"), "query_id", "i", "X")
    return up.groupBy("map_id", "tx", "ty").cogroup(nodes.select("map_id", "tx", "ty", "D", "A").groupBy("map_id", "tx", "ty")).applyInArrow(run, LIFT_DDL)


ROUND_DDL = "map_id string, tx int, ty int, query_id string, i int, kind int, X binary"
ROUND = pa.schema([("map_id", pa.string()), ("tx", pa.int32()), ("ty", pa.int32()), ("query_id", pa.string()), ("i", pa.int32()), ("kind", pa.int32()), ("X", pa.binary())])
#: What a row of a round is: distances to a tile's ports, the same when they are first seen, or what comes over its top, bottom, left or right side.
STATE, FIRST, SIDES = 0, 1, (2, 3, 4, 5)
#: For each side, the neighbour beyond it and the side of that one where it arrives.
BEYOND = ((-1, 0, 1), (1, 0, 0), (0, -1, 3), (0, 1, 2))


def side_ports(side: int) -> list[np.ndarray]:
    """For each side of a tile the places of its cells in perimeter()."""
    inner = np.arange(side - 2)
    left = np.concatenate(([0], 2 * side + inner, [side]))
    right = np.concatenate(([side - 1], 2 * side + side - 2 + inner, [2 * side - 1]))
    return [np.arange(side), side + np.arange(side), left, right]


def spread(index: Index, tops: DataFrame, far: int = INF, within: int | None = None) -> DataFrame:
    """map_id, tx, ty, query_id, i, X: the distances under `far` to the ports of the tiles of the top level; tops: the lifts there.

    Distances spread from tile to tile, and with `within` on none but those in the same square of so many tiles a side. In a
    round every tile takes what comes over its sides, carries it on to its other ports, and sends what became shorter to its
    neighbours; there are about as many rounds as a shortest path meets tiles.
    """
    inside = lambda a, b: within is None or a // within == b // within
    side = index.config.side(index.height)
    edges = side_ports(side)
    tiles = index.at().where(F.col("lvl") == index.height).select("map_id", "tx", "ty", "S", "E", "P")
    own = tops.select("map_id", "tx", "ty", "query_id", "i", "X")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return ROUND.empty_table()
        short, weight = matrix_of(right.column("S")[0].as_py()), np.frombuffer(right.column("P")[0].as_py(), "<i4")
        place = places(np.frombuffer(right.column("E")[0].as_py(), "<i4"), 4 * side - 4)
        name, x, y = (left.column(c)[0].as_py() for c in ("map_id", "tx", "ty"))
        numbers: dict[tuple, int] = {}
        for key in zip(left.column("query_id").to_pylist(), left.column("i").to_pylist()):
            numbers.setdefault(key, len(numbers))
        known, come = (np.full((len(numbers), len(weight)), FAR, np.int32) for _ in range(2))
        tell = np.zeros(len(numbers), bool)
        for q, i, kind, blob in zip(*(left.column(c).to_pylist() for c in ("query_id", "i", "kind", "X"))):
            row, value = numbers[q, i], np.frombuffer(blob, "<i4")
            if kind in (STATE, FIRST):
                known[row] = np.minimum(known[row], value)
                tell[row] |= kind == FIRST
                continue
            at = place[edges[kind - SIDES[0]]]
            on = np.flatnonzero((at >= 0) & (value[:side] < FAR))
            at = at[on]
            np.minimum.at(come[row], at, np.minimum(FAR, value[:side][on] + edge_weights(value[side:][on], weight[at])))
        come[(come >= known) | (come >= far)] = FAR
        better = np.flatnonzero((come < FAR).any(axis=1))
        if len(better):
            through = min_plus_dense(come[better], short)
            tell[better] |= (through < known[better]).any(axis=1)
            known[better] = np.minimum(known[better], through)
        known[known >= far] = FAR
        rows = []
        for (q, i), row in numbers.items():
            rows.append((name, x, y, q, i, STATE, known[row].tobytes()))
            for k, (dx, dy, there) in enumerate(BEYOND if tell[row] else ()):
                at = place[edges[k]]
                value, heavy = np.where(at >= 0, known[row][at], FAR), np.where(at >= 0, weight[at], 0)
                if (value < FAR).any() and inside(x, x + dx) and inside(y, y + dy):
                    rows.append((name, x + dx, y + dy, q, i, SIDES[there], np.concatenate((value, heavy)).astype("<i4").tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROUND)], schema=ROUND)

    tile = ["map_id", "tx", "ty"]
    at_tiles = tiles.select(F.col("map_id").alias("map_id"), "tx", "ty", "S", "E", "P")
    state = own.select(*tile, "query_id", "i", F.lit(FIRST).alias("kind"), "X")
    while True:
        near = at_tiles.join(F.broadcast(state.select(*tile).distinct()), tile, "left_semi")
        near = near.select(*(F.col(c).alias(c) for c in near.columns))  # columns of its own, for the cogroup
        state = stored(state.groupBy(*tile).cogroup(near.groupBy(*tile)).applyInArrow(run, ROUND_DDL), "round")
        if not state.where(F.col("kind") != STATE).head(1):
            break
    return state.select(*tile, "query_id", "i", "X")


def across(index: Index, tops: DataFrame) -> DataFrame:
    """map_id, query_id, i, j, d: the distances under INF by ways through several tiles of the top level; tops: the lifts there."""
    tile = ["map_id", "tx", "ty"]
    state = spread(index, tops)
    met = pa.schema([("map_id", pa.string()), ("query_id", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("d", pa.int32())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return met.empty_table()
        rows = []
        for q in sorted(set(right.column("query_id").to_pylist())):
            sides = [[(i, np.frombuffer(x, "<i4")) for p, i, x in zip(*(t.column(c).to_pylist() for c in ("query_id", "i", "X"))) if p == q] for t in (left, right)]
            if not sides[0]:
                continue
            a, b = (np.array([x for _, x in s], np.int32).reshape(len(s), -1) for s in sides)
            dist = min_plus_dense(a, np.ascontiguousarray(b.T))
            u, v = np.nonzero(dist < INF)
            rows += [(left.column("map_id")[0].as_py(), q, sides[0][m][0], sides[1][n][0], int(dist[m, n])) for m, n in zip(u.tolist(), v.tolist())]
        columns = list(zip(*rows)) if rows else [()] * len(met)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, met)], schema=met)

    ends = tops.select(F.col("map_id").alias("map_id"), "tx", "ty", "query_id", "i", "X")
    return state.groupBy(*tile).cogroup(ends.groupBy(*tile)).applyInArrow(meet, "map_id string, query_id string, i int, j int, d int")


WIDE_DDL = "map_id string, lvl int, tx int, ty int, query_id string, i int, X binary, E binary"
WIDE = pa.schema([("map_id", pa.string()), ("lvl", pa.int32()), ("tx", pa.int32()), ("ty", pa.int32()), ("query_id", pa.string()), ("i", pa.int32()), ("X", pa.binary()), ("E", pa.binary())])


def wide_lifts(index: Index, state: DataFrame, level: int) -> DataFrame:
    """The lifts to a level that is not kept, with the passable ports that they are of; state: what spread() found in its tiles."""
    below, side = index.config.side(index.height), index.config.side(level)
    w = side // below

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return WIDE.empty_table()
        name, px, py = (left.column(c)[0].as_py() for c in ("map_id", "px", "py"))
        pr, pc = perimeter(below)
        spots, held, upto = [np.zeros(0, np.int64)], {}, 0
        for x, y, e in zip(*(right.column(c).to_pylist() for c in ("tx", "ty", "E"))):
            e = np.frombuffer(e, "<i4")
            r, c = pr[e] + x % w * below, pc[e] + y % w * below
            # places in perimeter(side): top, bottom, left and right
            spot = np.select([r == 0, r == side - 1, c == 0, c == side - 1], [c, side + c, 2 * side + r - 1, 3 * side - 2 + r - 1], -1)
            on = np.flatnonzero(spot >= 0)
            held[x, y] = on, np.arange(upto, upto + len(on))
            upto += len(on)
            spots.append(spot[on])
        spots = np.concatenate(spots)
        order = np.argsort(spots)
        lifts: dict[tuple, np.ndarray] = {}
        for x, y, q, i, blob in zip(*(left.column(c).to_pylist() for c in ("tx", "ty", "query_id", "i", "X"))):
            lift = lifts.setdefault((q, i), np.full(upto, FAR, np.int32))
            if (x, y) in held:
                on, at = held[x, y]
                lift[at] = np.frombuffer(blob, "<i4")[on]
        e = spots[order].astype("<i4").tobytes()
        rows = [(name, level, px, py, q, i, np.ascontiguousarray(x[order], "<i4").tobytes(), e) for (q, i), x in lifts.items()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), WIDE)], schema=WIDE)

    up = [F.floor(F.col(x) / w).cast("int").alias(p) for x, p in (("tx", "px"), ("ty", "py"))]
    by = ["map_id", "px", "py"]
    found = state.select("map_id", *up, "tx", "ty", "query_id", "i", "X")
    edge = (F.col("tx") % w).isin(0, w - 1) | (F.col("ty") % w).isin(0, w - 1)
    near = index.at().where(F.col("lvl") == index.height).where(edge).select(F.col("map_id").alias("map_id"), *up, "tx", "ty", "E")
    return found.groupBy(*by).cogroup(near.groupBy(*by)).applyInArrow(run, WIDE_DDL)


class Answer:
    """The distances between viewpoints (map_id, query_id, i, r, c) at a version, kept by tile so that they can be refreshed."""

    def __init__(self, index: Index, viewpoints: DataFrame, levels: list[DataFrame]):
        self.index, self.viewpoints, self.levels = index, viewpoints, levels

    def refresh(self, index: Index) -> Answer:
        """At a newer version of the index: only tiles rebuilt since and all their ancestors are met again."""
        if index.ver == self.index.ver:
            return self
        if index.height != self.index.height:
            return ask(index, self.viewpoints)
        changed = branch(index.rows.where(F.col("ver") > self.index.ver).select(*KEY), index.config.g, index.height)
        return Answer(index, self.viewpoints, _levels(index, self.viewpoints, self.levels, stored(changed, "changed")))

    def _lifted(self, most: int | None = None) -> DataFrame:
        """WIDE_DDL: the lifts of all levels up to the root or level `most`, also of those that are too wide to be kept."""
        index, top = self.index, self.index.root()
        top = top if most is None else min(top, most)
        tiles = index.at().select(*KEY, "E")
        names = [f.name for f in WIDE]
        out = _union(self.levels).where("X is not null").where(F.col("lvl") <= top).select(*KEY, "query_id", "i", "X").join(tiles, KEY).select(*names)
        state = self.levels[-1].where("X is not null")
        for level in range(index.height + 1, top + 1):  # each goes on from the one below
            state = spread(index, state, int(FAR), index.config.g ** (level - index.height))
            out = out.union(wide_lifts(index, state, level).select(*names))
        return out

    def lifts(self, most: int | None = None) -> DataFrame:
        """map_id, query_id, i, lvl, X: distances to the passable ports, INF where there is none, up to the root or level `most`."""

        def close(batches):
            for batch in batches:
                x = [np.where((d := np.frombuffer(b, "<i4")) < FAR, d, INF).astype("<i4").tobytes() for b in batch.column("X").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*POINT, "lvl")), pa.array(x, pa.binary())], names=[*POINT, "lvl", "X"])

        return self._lifted(most).select(*POINT, "lvl", "X").mapInArrow(close, "map_id string, query_id string, i int, lvl int, X binary")

    def ports(self, most: int | None = None) -> DataFrame:
        """map_id, query_id, i, lvl, r, c, d: the lifts as finite distances to the ports' cells."""
        side = self.index.config.side
        known = self._lifted(most).select(*POINT, "lvl", "tx", "ty", "X", "E")
        out = pa.schema([("map_id", pa.string()), ("query_id", pa.string()), ("i", pa.int32()), ("lvl", pa.int32()), ("r", pa.int32()), ("c", pa.int32()), ("d", pa.int32())])

        def spell(batches):
            for batch in batches:
                for x in batch.to_pylist():
                    d, at = np.frombuffer(x["X"], "<i4"), np.frombuffer(x["E"], "<i4")
                    pr, pc = perimeter(side(x["lvl"]))
                    on = np.flatnonzero(d < FAR)
                    r, c = pr[at[on]] + x["tx"] * side(x["lvl"]), pc[at[on]] + x["ty"] * side(x["lvl"])
                    head = [pa.array([x[k]] * len(on), out.field(k).type) for k in ("map_id", "query_id", "i", "lvl")]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(d[on])], schema=out)

        return known.mapInArrow(spell, "map_id string, query_id string, i int, lvl int, r int, c int, d int")

    def matrix(self) -> DataFrame:
        """map_id, query_id, i, j, d: INF where there is no path, on the diagonal too if the viewpoint is impassable."""
        found = _union(self.levels).where("d is not null").select(*POINT, "j", "d")
        if not self.index.whole:
            found = found.unionByName(across(self.index, self.levels[-1].where("X is not null")))
        found = found.groupBy(*POINT, "j").agg(F.min("d").alias("d"))
        a = self.viewpoints.select(F.col("map_id").cast("string").alias("map_id"), "query_id", F.col("i").cast("int").alias("i"))
        both = a.join(a.withColumnRenamed("i", "j"), ["map_id", "query_id"])
        return both.join(found, [*POINT, "j"], "left").select(*POINT, "j", F.coalesce(F.least("d", F.lit(INF)), F.lit(INF)).cast("int").alias("d"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _levels(index: Index, viewpoints: DataFrame, before: list[DataFrame] | None = None, changed: DataFrame | None = None) -> list[DataFrame]:
    config, rows = index.config, index.at()
    free = index.cells.where((F.col("observed") == 1) & (F.col("weight") < INF)).select(F.col("map_id").cast("string").alias("map_id"), "r", "c")
    points = viewpoints.select(F.col("map_id").cast("string").alias("map_id"), F.col("query_id").cast("string").alias("query_id"), F.col("i").cast("int").alias("i"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).join(free, ["map_id", "r", "c"], "left_semi")
    keys = _passed(index, viewpoints)
    if keys is not None:
        if before is None and (found := _climbed(index, keys, points)) is not None:
            return [found.where(F.col("lvl") == k) for k in range(index.height + 1)]
        rows = index.rows_of(keys, *KEY, "D", "E", "A")  # of all others not a byte is moved
    out: list[DataFrame] = []
    for k in range(index.height + 1):
        own = rows.where(F.col("lvl") == k)
        dirty = changed.where(F.col("lvl") == k) if changed is not None else None
        if dirty is not None:
            own = own.join(dirty, KEY, "left_semi")
        made = _leaf_step(points, own, config.b) if k == 0 else _node_step(out[k - 1].where("X is not null"), own, k, config.side(k - 1), config.g)
        if dirty is not None:
            made = made.union(before[k].join(dirty, KEY, "left_anti").select(*made.columns))
        out.append(stored(made, f"lifts-{k}"))
    return out


def _passed(index: Index, viewpoints: DataFrame) -> DataFrame | None:
    """The leaves of some viewpoints and their ancestors; None if the viewpoints are too many to list them."""
    b = index.config.b
    some = viewpoints.select(F.col("map_id").cast("string"), F.floor(F.col("r") / b).cast("int"), F.floor(F.col("c") / b).cast("int")).limit(FEW + 1).collect()
    return index.branches({tuple(x) for x in some}) if 0 < len(some) <= FEW else None


def _climbed(index: Index, keys: DataFrame, points: DataFrame) -> DataFrame | None:
    """The lifts of all levels from one kernel a root; None if the viewpoints pass too much. keys: what _passed gives."""
    config, height = index.config, index.height
    b, g = config.b, config.g
    ports = F.when(F.col("lvl") == 0, F.lit(b * b)).otherwise(F.octet_length("A") / 4)
    if (index.rows_of(keys, (ports * ports * 4).alias("n")).agg(F.sum("n")).first()[0] or 0) > MOST_BYTES:
        return None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return LIFT.empty_table()
        name = left.column("map_id")[0].as_py()
        at = {key: n for n, key in enumerate(zip(*(right.column(c).to_pylist() for c in ("lvl", "tx", "ty"))))}
        ints = lambda key, c: np.frombuffer(right.column(c)[at[key]].as_buffer() or b"", "<i4")
        queries, i, r, c = left.column("query_id").to_pylist(), *(left.column(x).to_numpy() for x in ("i", "r", "c"))
        out, held = [], [(n, (0, x, y)) for n, (x, y) in enumerate(zip((r // b).tolist(), (c // b).tolist()))]
        lifts: dict[int, np.ndarray] = {}
        for k in range(height + 1):
            groups: dict[tuple, list[int]] = {}
            for n, key in held:
                if key in at:
                    groups.setdefault(key, []).append(n)
            fresh = {}
            for key, mine in groups.items():
                dist = matrix_of(right.column("D")[at[key]].as_py())
                if k == 0:
                    place = (r[mine] % b) * b + c[mine] % b
                    lifted, met = dist[np.ix_(place, _ports(b)[ints(key, "E")])], dist[np.ix_(place, place)]
                else:
                    side = config.side(k - 1)
                    active = ints(key, "A")
                    child, ext = active // (4 * side - 4), border(active, side, g)[1]
                    a = np.full((len(mine), len(dist)), FAR, np.int32)
                    for row, n in enumerate(mine):
                        x, y = (z[n] // side for z in (r, c))
                        a[row, child == (x % g) * g + y % g] = lifts[n]
                    through = min_plus_dense(a, dist)
                    lifted, met = through[:, ext], min_plus_dense(through, np.ascontiguousarray(a.T))
                out.append(_emit((name, *key), [queries[n] for n in mine], i[mine], lifted, met))
                fresh |= dict(zip(mine, lifted))
            lifts = fresh
            held = [(n, (k + 1, x // g, y // g)) for n, (_, x, y) in held if n in fresh]
        return pa.concat_tables(out) if out else LIFT.empty_table()

    top = index.config.side(height)
    tile = [F.floor(F.col(x) / top).cast("int").alias(y) for x, y in (("r", "rx"), ("c", "ry"))]
    nodes = index.rows_of(keys, "map_id", "rx", "ry", "lvl", "tx", "ty", "D", "E", "A")
    by = ["map_id", "rx", "ry"]
    return stored(points.select("*", *tile).groupBy(*by).cogroup(nodes.groupBy(*by)).applyInArrow(run, LIFT_DDL), "lifts")


def ask(index: Index, viewpoints: DataFrame) -> Answer:
    return Answer(index, viewpoints, _levels(index, viewpoints))


def matrix(index: Index, viewpoints: DataFrame, k: int | None = None) -> DataFrame:
    """map_id, query_id, i, j, d; k, the number of viewpoints of a query, if it is known: small ones are searched without the index."""
    if k is not None and 0 < k <= index.config.hybrid_k:
        one = viewpoints.withColumn("map", F.col("map_id")).withColumn("map_id", F.concat_ws("\u0001", "map_id", "query_id"))
        cells = index.cells.join(viewpoints.select("map_id", "query_id").distinct(), "map_id").withColumn("map_id", F.concat_ws("\u0001", "map_id", "query_id"))
        named = search.matrix(cells, one, weighted=True)
        parts = F.split("map_id", "\u0001")
        return named.select(parts[0].alias("map_id"), parts[1].alias("query_id"), "i", "j", "d")
    return ask(index, viewpoints).matrix()


def pairs(index: Index, wanted: DataFrame) -> DataFrame:
    """wanted (map_id, id, r1, c1, r2, c2) with d."""
    ends = F.array(F.struct(F.lit(0).alias("i"), F.col("r1").alias("r"), F.col("c1").alias("c")), F.struct(F.lit(1).alias("i"), F.col("r2").alias("r"), F.col("c2").alias("c")))
    points = wanted.select("map_id", F.col("id").cast("string").alias("query_id"), F.inline(ends))
    found = matrix(index, points).where("i = 0 and j = 1").select("map_id", F.col("query_id").alias("id"), "d")
    return wanted.join(found, (wanted["map_id"] == found["map_id"]) & (wanted["id"].cast("string") == found["id"])).select(*(wanted[c] for c in wanted.columns), "d")
