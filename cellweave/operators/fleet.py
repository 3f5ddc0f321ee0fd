"""Assignment of targets to a fleet, tours, and the choice of fallback goals.

The greedy rules depend on order, so a plan is one kernel; plans are independent and spread over tasks.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators import raster, sampling
from cellweave.operators.neighbourhood import scatter
from cellweave.session import INF, stored

#: What a leg without a path counts while tours are compared.
NO_PATH = 1_000_000
SWEEPS = 20


def assign(to: list[list[int]], cap: int) -> list[list[int]]:
    """Targets, in order, each to the nearest robot with room (to[robot][target], the lowest robot of equals), or to the nearest of all."""
    robots = range(len(to))
    own: list[list[int]] = [[] for _ in robots]
    for f in range(len(to[0]) if to else 0):
        near = [(to[r][f], r) for r in robots if to[r][f] < INF]
        choice = min((x for x in near if len(own[x[1]]) < cap), default=min(near, default=None))
        if choice:
            own[choice[1]].append(f)
    return own


def fill_idle(own: list[list[int]], to: list[list[int]], squares: list[list[int]]) -> None:
    """Robots without a target share the least loaded one they reach, the nearest of those; else the least loaded, nearest as the crow flies."""
    n = len(to[0]) if to else 0
    load = [0] * n
    for f in (f for x in own for f in x):
        load[f] += 1
    for r, mine in enumerate(own):
        if not mine and n:
            reach = [(load[f], to[r][f], f) for f in range(n) if to[r][f] < INF]
            f = min(reach or [(load[f], squares[r][f], f) for f in range(n)])[2]
            mine.append(f)
            load[f] += 1


def tour(start: list[int], between: list[list[int]], own: list[int]) -> list[int]:
    """An open tour: nearest neighbours, then reversals of stretches while they help, for at most SWEEPS sweeps.

    start[f]: from the robot; between[f][g]: from target to target. Ties go to the target listed first.
    """
    left, order, here = list(own), [], start
    while left:
        nearest = min(range(len(left)), key=lambda k: (min(here[left[k]], INF), k))
        order.append(left.pop(nearest))
        here = between[order[-1]]
    if len(order) <= 2:
        return order

    def leg(d: int) -> int:
        return d if d < INF else NO_PATH

    def cost(t: list[int]) -> int:
        return leg(start[t[0]]) + sum(leg(between[a][b]) for a, b in zip(t, t[1:]))

    best = cost(order)
    for _ in range(SWEEPS):
        before = best
        for i in range(len(order)):
            for j in range(i + 1, len(order)):
                other = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if (c := cost(other)) < best:
                    order, best = other, c
        if best == before:
            break
    return order


def plan(robots: list[tuple[int, int]], targets: list[tuple[int, int]], dist: list[list[int]], most: int = 32) -> list[tuple[list[int], int]]:
    """The tour (targets in order) and its cost for each robot; dist is over robots, then targets. A matrix that is too small gives empty tours."""
    n, k = len(robots), len(targets)
    if not n or not k or len(dist) < n + k or any(len(row) < n + k for row in dist[: n + k]):
        return [([], 0)] * n
    to = [[dist[r][n + f] for f in range(k)] for r in range(n)]
    between = [[dist[n + a][n + b] for b in range(k)] for a in range(k)]
    own = assign(to, min(most, max(1, -(-k // n) + 4)))
    fill_idle(own, to, [[(a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 for b in targets] for a in robots])
    out = []
    for r in range(n):
        order = tour(to[r], between, own[r]) if own[r] else []
        legs = [to[r][order[0]], *(between[a][b] for a, b in zip(order, order[1:]))] if order else []
        out.append((order, sum(d for d in legs if d < INF)))
    return out


def plan_fleet(points: DataFrame, dist: DataFrame, most: int = 32) -> DataFrame:
    """plan_id, robot_id, waypoints (an array of (target, r, c)), cost.

    points (plan_id, kind, idx, r, c): kind 'robot' or 'target', idx from 0 in each kind; dist (plan_id, i, j, d): robots
    first, then targets; missing entries are INF.
    """
    ddl = "plan_id string, robot_id int, waypoints array<struct<target: int, r: int, c: int>>, cost long"
    stop = pa.struct([("target", pa.int32()), ("r", pa.int32()), ("c", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"plan_id": pa.array([], pa.string()), "robot_id": pa.array([], pa.int32()), "waypoints": pa.array([], pa.list_(stop)), "cost": pa.array([], pa.int64())})
        rows = sorted(zip(*(left.column(c).to_pylist() for c in ("kind", "idx", "r", "c"))))
        robots, targets = ([(r, c) for kind, _, r, c in rows if kind == k] for k in ("robot", "target"))
        n = len(robots) + len(targets)
        matrix = [[INF] * n for _ in range(n)] if right.num_rows else []
        for i, j, d in zip(*(right.column(c).to_pylist() for c in ("i", "j", "d"))):
            matrix[i][j] = d
        tours = plan(robots, targets, matrix, most)
        name = left.column("plan_id")[0].as_py()
        way = [[{"target": f, "r": targets[f][0], "c": targets[f][1]} for f in order] for order, _ in tours]
        return pa.table({"plan_id": pa.array([name] * len(tours), pa.string()), "robot_id": pa.array(range(len(tours)), pa.int32()), "waypoints": pa.array(way, pa.list_(stop)), "cost": pa.array([c for _, c in tours], pa.int64())})

    return points.groupBy("plan_id").cogroup(dist.groupBy("plan_id")).applyInArrow(run, ddl)


def tour_cost(stops: DataFrame, dist: DataFrame) -> DataFrame:
    """plan_id, robot_id, cost: the sum of the finite legs of tours (plan_id, robot_id, ord, point), the robot itself at ord 0."""
    w = W.partitionBy("plan_id", "robot_id").orderBy("ord")
    legs = stops.withColumn("i", F.lag("point").over(w)).withColumnRenamed("point", "j")
    met = legs.join(dist, ["plan_id", "i", "j"], "left")
    return met.groupBy("plan_id", "robot_id").agg(F.coalesce(F.sum(F.when(F.col("d") < INF, F.col("d"))), F.lit(0)).alias("cost"))


def adopt(robots: DataFrame, tours: DataFrame, near_goal: DataFrame, patience: int = 8) -> DataFrame:
    """robots (map_id, robot_id, goal_r, goal_c, persistence, stuck, explored) with the goals they follow next, as `goals`.

    A robot keeps its goal, put before the rest of its tour, if it has one that is not explored, a viewpoint is near it
    (near_goal: map_id, robot_id) or its persistence lasts, and it is not stuck for `patience` ticks; else it takes the tour
    (map_id, robot_id, waypoints of (r, c)).
    """
    keys = ["map_id", "robot_id"]
    r = robots.join(tours, keys, "left").join(near_goal.select(*keys).distinct().withColumn("near", F.lit(True)), keys, "left")
    goal = F.struct(F.col("goal_r").alias("r"), F.col("goal_c").alias("c"))
    keep = F.col("goal_r").isNotNull() & ~F.coalesce("explored", F.lit(False)) & (F.col("near").isNotNull() | (F.col("persistence") > 0)) & (F.col("stuck") < patience)
    way = F.coalesce("waypoints", F.array().cast("array<struct<r:int,c:int>>"))
    pinned = F.concat(F.array(goal), F.filter(way, lambda p: (p["r"] != F.col("goal_r")) | (p["c"] != F.col("goal_c"))))
    return r.withColumn("kept", F.coalesce(keep, F.lit(False))).withColumn("goals", F.when(F.col("kept"), pinned).otherwise(way)).drop("near", "waypoints")


def fallback_goals(robots: DataFrame, viewpoints: DataFrame, cells: DataFrame, apart: int = 6) -> DataFrame:
    """map_id, robot_id, i, r, c: for each robot (r, c, goal_r, goal_c) the viewpoint to go to: in its own component, those not
    within `apart` of another robot's goal first, then the nearest by squared distance, then the first."""
    comp = stored(raster.components(cells, "observed").select("map_id", "r", "c", "comp"), "components")
    at = robots.select("map_id", "robot_id", "r", "c").join(comp, ["map_id", "r", "c"])
    box = tuple((a, b) for a in range(-apart, apart + 1) for b in range(-apart, apart + 1))
    goals = robots.where("goal_r is not null").select("map_id", F.col("goal_r").alias("r"), F.col("goal_c").alias("c"), F.col("robot_id").alias("other"))
    taken = scatter(goals, box, "other").groupBy("map_id", "r", "c").agg(F.min("other").alias("one"), F.max("other").alias("two"))
    to = stored(viewpoints.select("map_id", "i", "r", "c").join(comp, ["map_id", "r", "c"]).join(taken, ["map_id", "r", "c"], "left"), "viewpoints")
    key = ["map_id", "comp"]
    free = nearest(at, to.where("one is null"), key, "robot_id")
    own = at.join(to.where("one = two").withColumnsRenamed({"one": "robot_id", "r": "r2", "c": "c2"}), [*key, "robot_id"])
    own = own.select("map_id", "robot_id", _d2("r", "c", "r2", "c2").alias("d2"), "i", F.col("r2").alias("r"), F.col("c2").alias("c"))
    first = stored(free.unionByName(own), "unshared")
    rest = at.join(first, ["map_id", "robot_id"], "left_anti")
    found = first.withColumn("shared", F.lit(0)).unionByName(nearest(rest, to, key, "robot_id").withColumn("shared", F.lit(1)))
    return found.groupBy("map_id", "robot_id").agg(F.min(F.struct("shared", "d2", "i", "r", "c")).alias("m")).select("map_id", "robot_id", "m.i", "m.r", "m.c")


def _d2(r: str, c: str, r2: str, c2: str):
    dr, dc = F.col(r).cast("long") - F.col(r2), F.col(c).cast("long") - F.col(c2)
    return dr * dr + dc * dc


#: Side of the squares in which the nearest are first looked for.
NEAR = 32


def nearest(points: DataFrame, others: DataFrame, key: list[str], id_col: str, side: int = NEAR) -> DataFrame:
    """map_id, id_col, d2, i, r, c: of the others (key, i, r, c) with a point's key the nearest by squared distance, then the first i.

    A point meets the others in the 3 x 3 squares around it; whoever is found within a square's side is settled, and the rest
    look again in squares four times as wide, until one covers all. Points without any other have no row.
    """
    others = others.select(*key, "i", "r", "c")
    every = points.select("r", "c").union(others.select("r", "c"))
    reach = every.agg(F.greatest(F.max("r") - F.min("r"), F.max("c") - F.min("c"))).first()[0] or 0
    left, out = points.select(*key, id_col, "r", "c").join(others.select(*key).distinct(), key, "left_semi"), None
    while True:
        square = lambda x: F.floor(F.col(x) / side)
        there = others.select(*key, square("r").alias("y"), square("c").alias("x"), "i", F.col("r").alias("r2"), F.col("c").alias("c2"))
        here = left.select("*", square("r").alias("y0"), square("c").alias("x0")).withColumn("y", F.explode(F.array(*(F.col("y0") + k for k in (-1, 0, 1))))).withColumn("x", F.explode(F.array(*(F.col("x0") + k for k in (-1, 0, 1)))))
        met = here.join(there, [*key, "y", "x"]).groupBy(*key, id_col, "r", "c").agg(F.min(F.struct(_d2("r", "c", "r2", "c2").alias("d2"), "i", F.col("r2").alias("r"), F.col("c2").alias("c"))).alias("m"))
        last = side > reach  # the squares around a point hold all others
        if not last:
            met = stored(met.where(F.col("m.d2") <= side * side), "nearest")
        rows = met.select("map_id", id_col, "m.d2", "m.i", "m.r", "m.c")
        out = rows if out is None else out.unionByName(rows)
        if last:
            return out
        left = stored(left.join(met, [*key, id_col], "left_anti"), "left")
        if not left.head(1):
            return out
        side *= 4


#: Cells within which a robot visits a target, and that lie between two targets at least.
VISIT, APART = 6, 16


def patrol_targets(cells: DataFrame, n: int, divisions: int = 4, seed: int = 0) -> DataFrame:
    """map_id, i, r, c: n free cells, one from each sector in turn, in the order of a hash within the sector."""
    sector = F.floor(F.col("r") * divisions / F.col("rows")) * divisions + F.floor(F.col("c") * divisions / F.col("cols"))
    free = cells.where("observed = 1").withColumn("sector", sector.cast("int"))
    dealt = free.withColumn("turn", F.row_number().over(W.partitionBy("map_id", "sector").orderBy(sampling.shuffled(seed), "r", "c"))).where(F.col("turn") <= n)
    return sampling.first_of_each_map(dealt, F.row_number().over(W.partitionBy("map_id").orderBy("turn", "sector")), n)


def unvisited(targets: DataFrame, robots: DataFrame) -> DataFrame:
    """The targets (map_id, i, r, c) that no robot (map_id, r, c) has come within VISIT cells of."""
    seen = scatter(robots, _disc(VISIT * VISIT)).select("map_id", "r", "c").distinct()
    return targets.join(seen, ["map_id", "r", "c"], "left_anti")


def _disc(d2: int) -> tuple[tuple[int, int], ...]:
    """The offsets of cells within a squared distance."""
    k = math.isqrt(d2)
    return tuple((a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= d2)


def replenished(targets: DataFrame, cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """map_id, i, r, c: the targets, and free cells in the order of a hash, none within APART of another, until a map has n.

    A taken cell rules out those around it, of which there are fewer than its square, so the first n such squares of
    candidates are enough, whatever the map's size.
    """
    ahead = n * (2 * APART - 1) ** 2
    kept = targets.select("map_id", "i", "r", "c")
    order = F.row_number().over(W.partitionBy("map_id").orderBy(sampling.shuffled(seed), "r", "c"))
    around = scatter(kept, _disc(APART * APART - 1)).select("map_id", "r", "c").distinct()
    free = cells.where("gt = 1").select("map_id", "r", "c").join(around, ["map_id", "r", "c"], "left_anti")
    rows = sampling.first_of_each_map(free, order, ahead).select("map_id", F.lit(1).alias("new"), "i", "r", "c").unionByName(kept.withColumn("new", F.lit(0)))

    def run(table: pa.Table) -> pa.Table:
        points = sorted(zip(*(table.column(x).to_pylist() for x in ("new", "i", "r", "c"))))
        out = [(i, r, c) for new, i, r, c in points if not new]
        fresh = []
        for new, _, r, c in points:
            if new and len(out) + len(fresh) < n and all((r - y) ** 2 + (c - x) ** 2 >= APART * APART for _, y, x in fresh):
                fresh.append((max([k for k, _, _ in out + fresh], default=-1) + 1, r, c))
        i, r, c = zip(*(out + fresh)) if out or fresh else ((), (), ())
        return pa.table({"map_id": pa.array([table.column("map_id")[0].as_py()] * len(i), pa.string()), **{k: pa.array(v, pa.int32()) for k, v in zip("irc", (i, r, c))}})

    return rows.select(F.col("map_id").cast("string").alias("map_id"), "new", "i", "r", "c").groupBy("map_id").applyInArrow(run, "map_id string, i int, r int, c int")
