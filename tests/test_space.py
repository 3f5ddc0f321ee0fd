"""Neighbourhoods, frontiers, samples, plans, statistics and records on small fixtures."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import scalar
from cellweave.operators import cache, fleet, frontier, neighbourhood, raster, sampling, search, stats
from cellweave.plans import space
from cellweave.session import INF
from cellweave.sources import maps, records
from cellweave.streaming import mission, recovery
from tests.grids import as_matrix, table, updates, viewpoints


def tiers(spark, states):
    rows = neighbourhood.clearance(table(spark, states)).orderBy("r", "c").collect()
    n = len(states[0])
    return [[x["clr"] for x in rows[k : k + n]] for k in range(0, len(rows), n)]


def test_clearance(spark):
    assert tiers(spark, [[1] * 5] * 5) == [[1] * 5, [1, 2, 2, 2, 1], [1, 2, 3, 2, 1], [1, 2, 2, 2, 1], [1] * 5]
    hole = [[0 if (r, c) == (2, 2) else 1 for c in range(5)] for r in range(5)]
    got = tiers(spark, hole)
    assert got[1][1] == got[2][1] == 2 and got[2][2] == 0


def half(rows):
    return [[1] * 6 + [0] * 6 for _ in range(rows)]


def test_frontier_cluster(spark):
    cells = table(spark, half(12))
    assert {(x["r"], x["c"]) for x in neighbourhood.frontier_cells(cells).collect()} == {(r, 5) for r in range(1, 11)}
    [one] = frontier.frontier_clusters(cells).collect()
    assert (one["id"], tuple(one["rep"]), len(one["cells"])) == (0, (5, 5), 10)


@pytest.mark.parametrize(("rows", "expected"), [(40, [(1, 16, 8), (2, 16, 24), (3, 6, 35)]), (35, [(1, 16, 8), (2, 16, 24)])])
def test_frontier_partition(spark, rows, expected):
    got = frontier.frontier_clusters(table(spark, half(rows))).orderBy("id").collect()
    assert [(x["id"], len(x["cells"]), x["rep"]["r"]) for x in got] == expected
    assert all(x["rep"]["c"] == 5 for x in got)


def test_no_frontier(spark):
    assert frontier.frontier_clusters(table(spark, [[1] * 6] * 6)).count() == 0
    assert neighbourhood.clearance(table(spark, [[1]]).limit(0)).count() == 0


def matrix_of(n, value):
    return [[value(i, j) if i != j else 0 for j in range(n)] for i in range(n)]


def test_plans():
    def one(n, k, near, far):
        d = matrix_of(n + k, lambda i, j: INF if min(i, j) >= n or max(i, j) < n else near if min(i, j) == 0 else far + min(i, j))
        return fleet.plan([(0, 0)] * n, [(0, f) for f in range(k)], d)

    assert one(8, 3, 5, 50) == [([0, 1, 2], 5), ([0], 51), ([1], 52), ([2], 53), ([0], 54), ([1], 55), ([2], 56), ([0], 57)]
    assert one(4, 10, 3, 30) == [([0, 1, 2, 3, 4, 5, 6], 3), ([7, 8, 9], 31), ([0], 32), ([1], 33)]
    at = [0, 100, 10, 40, 20, 90, 70]
    line = matrix_of(7, lambda i, j: abs(at[i] - at[j]))
    assert fleet.plan([(0, 0), (0, 100)], [(0, x) for x in at[2:]], line) == [([0, 2, 1], 40), ([3, 4], 30)]
    assert fleet.plan([(0, 0)], [(0, 1)], [[0]]) == [([], 0)]
    assert fleet.plan([], [], []) == []


def test_plan_without_a_way_goes_as_the_crow_flies():
    d = matrix_of(3, lambda i, j: INF)
    assert fleet.plan([(0, 0)], [(5, 5), (1, 1)], d) == [([1], 0)]


def test_plan_fleet(spark):
    points = spark.createDataFrame([("p", "robot", 0, 0, 0), ("p", "target", 0, 0, 3), ("p", "target", 1, 0, 1), ("q", "robot", 0, 0, 0)], "plan_id string, kind string, idx int, r int, c int")
    at = [0, 3, 1]
    dist = spark.createDataFrame([("p", i, j, abs(at[i] - at[j])) for i in range(3) for j in range(3)], "plan_id string, i int, j int, d int")
    rows = {x["plan_id"]: x for x in fleet.plan_fleet(points, dist).collect()}
    assert [w["target"] for w in rows["p"]["waypoints"]] == [1, 0] and rows["p"]["cost"] == 3
    assert rows["q"]["waypoints"] == []


def test_stale_cache(spark):
    def walls(door):
        inside = lambda r, c: (4 <= r <= 16 and 2 <= c <= 14) or (4 <= r <= 16 and 17 <= c <= 29) or (c == 4 and 16 <= r <= 28) or (r == 28 and 4 <= c <= 26) or (c == 26 and 16 <= r <= 28) or (door and r == 10 and c in (15, 16))
        return [[1 if inside(r, c) else 2 for c in range(32)] for r in range(32)]

    points = viewpoints(spark, [(10, 4), (10, 26)]).drop("query_id")
    before, after = table(spark, walls(False)), table(spark, walls(True))
    cached = cache.build(before, points)
    assert as_matrix(cached.select("i", "j", "d"), 2)[0][1] == 58
    kept = cache.refresh(cached, after, points, (10, 15), 5)
    truth = search.matrix(after, points)
    assert as_matrix(kept.select("i", "j", "d"), 2)[0][1] == 58 and as_matrix(truth.select("i", "j", "d"), 2)[0][1] == 22
    report = cache.staleness(kept, truth).first()
    assert (report["stale_pairs"], report["max_absolute_error"], round(report["max_relative_error"], 3)) == (2, 36, 1.636)
    moved = viewpoints(spark, [(10, 26), (5, 5)]).drop("query_id")
    new = as_matrix(cache.refresh(cached, after, moved, (0, 0), 0).select("i", "j", "d"), 2)
    assert new[0][0] == 0 and new[0][1] == 21 + 5


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    s = stats.summary(df, "x").first()
    assert (s["median"], s["q1"], s["q3"]) == (3.0, 1.75, 5.5)
    assert round(stats.median_p95(df, "x").first()["p95"], 9) == 9.1
    assert stats.upper_median(df, "x").first()["upper_median"] == 4.0
    assert stats.summary(df.limit(0), "x").first()["n"] == 0
    a = spark.createDataFrame([(0, 0, 5), (0, 1, INF)], "i int, j int, d int")
    b = spark.createDataFrame([(0, 0, 7)], "i int, j int, d int")
    assert tuple(stats.compare_matrices(a, b).first()) == (2, 3, 2, 7)


def test_samples(spark):
    cells = table(spark, [[1] * 16] * 16)
    comp = raster.largest_component(cells).join(cells.select("map_id", "rows", "cols").distinct(), "map_id")
    far = [(x["r"], x["c"]) for x in sampling.farthest(comp, 3, 1).orderBy("i").collect()]
    assert len(set(far)) == 3 and abs(far[1][0] - far[0][0]) + abs(far[1][1] - far[0][1]) >= 15
    assert sampling.geometry(comp, "sector", 70).count() == 70
    held = sampling.withheld(comp, 9, 4, sampling.uniform(comp, 5))
    assert held.count() == 9 and held.select(F.floor(F.col("r") / 4), F.floor(F.col("c") / 4)).distinct().count() == 1


def test_scanner(spark):
    walls = [[2 if c == 20 else 1 for c in range(40)] for _ in range(32)]
    pose = spark.createDataFrame([("m", 0, 1.0, 1.6, 0.0)], "map_id string, robot_id int, x double, y double, theta double")
    hits, seen = mission.scan(pose, table(spark, walls), mission.Scanner(5.0, 1.0, 1), 0.1)
    hit = hits.first()
    assert hit["hit"] and abs(hit["distance"] - 1.0) <= 0.15
    assert {x["c"] for x in seen.where("gt = 1").collect()} == set(range(10, 20))
    assert mission.Scanner(5, 360, 360).step_degrees == mission.Scanner(5, 180, 181).step_degrees == 1.0


def test_map_files(spark, tmp_path):
    (tmp_path / "small.map").write_bytes(b"type octile\r\nheight 3\r\nwidth 4\r\nmap\n.GS@\n.\nT..TT....\n....\n")
    (tmp_path / "bad.map").write_text("type octile\nheight 0\nwidth 4\nmap\n....\n")
    cells = maps.read_maps(spark, f"{tmp_path}/*.map")
    rows = cells.orderBy("r", "c").collect()
    assert {x["map_id"] for x in rows} == {"small"}
    assert [x["gt"] for x in rows] == [1, 1, 1, 2, 1, 2, 2, 2, 2, 1, 1, 2]
    assert {x["observed"] for x in rows} == {0} and {x["gt"] - x["observed"] for x in maps.revealed(cells).collect()} == {0}


def test_exploration_snapshot(spark):
    cells = maps.exploration_snapshot(maps.rooms(spark, 32, 32, 16, 42), (8, 8), 0.5, 0.0).collect()
    assert sum(x["observed"] == 1 for x in cells) == 396
    assert all(x["observed"] in (0, x["gt"]) for x in cells)


def test_snapshots_in_blocks_of_lines(spark, monkeypatch):
    """Maps with holes, of several blocks, with and without free cells, as a walk over single cells sees them; a few bytes a cell."""
    import tracemalloc
    from collections import deque

    import numpy as np

    def walked(truth, start, coverage, island, seed):
        free = sorted(p for p, s in truth.items() if s == 1)
        if not free:
            return None
        first = start if truth.get(start) == 1 else free[0]
        want, draw = max(10, int(len(free) * coverage)), random.Random(seed)
        seen, met, queue, known = {first: 1}, {first}, deque([first]), 1
        while queue and known < want:
            y, x = queue.popleft()
            for near in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if near in met or near not in truth:
                    continue
                met.add(near)
                if truth[near] == 2:
                    seen[near] = 2
                elif not (draw.random() < island and known > 50):
                    seen[near] = 1
                    known += 1
                    queue.append(near)
                    if known >= want:
                        break
        return seen

    monkeypatch.setattr(maps, "LINES", 4)
    draw = random.Random(8)
    truths = {f"m{k}": {(r, c): draw.choice([1, 1, 1, 2]) for r in range(13) for c in range(17 + k) if draw.random() < 0.95} for k in range(3)}
    truths["walls"] = {(r, c): 2 for r in range(3) for c in range(3)}
    rows = [(name, 13, 20, r, c, gt, 7, 1) for name, truth in truths.items() for (r, c), gt in truth.items()]
    cells = spark.createDataFrame(rows, "map_id string, rows int, cols int, r int, c int, gt int, observed int, weight int")
    got = {(x["map_id"], x["r"], x["c"]): x["observed"] for x in maps.exploration_snapshot(cells, (2, 30), 0.6, 0.2, 5).collect()}
    want = {(name, *p): 7 if seen is None else seen.get(p, 0) for name, truth in truths.items() for seen in [walked(truth, (2, 30), 0.6, 0.2, 5)] for p in truth}
    assert got == want
    raster = np.pad(np.ones((400, 400), np.uint8), 1)
    tracemalloc.start()
    assert (maps.explored(raster, (0, 0), 0.45, 0.1, 0) > 0).sum() == 72_000
    assert tracemalloc.get_traced_memory()[1] < 8 * raster.size
    tracemalloc.stop()


def test_cell_updates_take_the_last(spark):
    cells = table(spark, [[1, 2]])
    out = neighbourhood.update_cells(cells, updates(spark, [(0, 0, "block", None), (0, 0, "open", None), (0, 1, "reweight", 5), (0, 1, "reweight", 7), (9, 9, "open", None)])).orderBy("c").collect()
    assert [(x["observed"], x["weight"]) for x in out] == [(1, 1), (2, 7)]


def test_scalars(spark):
    row = spark.range(1).select(scalar.add_dist(F.lit(59999), F.lit(5)).alias("a"), scalar.edge_weight(F.lit(60000), F.lit(1)).alias("b"), scalar.lca_level(F.lit(0), F.lit(0), F.lit(9), F.lit(0), 8, 2, 1).alias("c"), scalar.lca_level(F.lit(0), F.lit(0), F.lit(99), F.lit(0), 8, 2, 1).alias("d"), scalar.join_ints(scalar.parse_ints(F.lit("1, 2,x,,-7z"))).alias("e")).first()
    assert tuple(row) == (60000, 60000, 1, 2, "1,2,0,-7")


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([("m", 8, 1.5)], "map_id string, b int, median_ms double")
    for _ in range(2):
        records.append_csv(rows, f"{tmp_path}/q", "query_vs_k")
    back = records.read_csv(spark, f"{tmp_path}/q", "query_vs_k").collect()
    assert len(back) == 2 and back[0]["median_ms"] == 1.5 and back[0]["g"] is None
    assert json.loads(records.manifest({"b": 8}, "running"))["status"] == "running"
    assert records.json_escape('a"\n\x01') == 'a\\"\\n\\u0001'
    assert records.file_hashes(spark, f"{tmp_path}/q/*.csv").count() >= 1
    with pytest.raises(ValueError):
        records.manifest({}, "other")


def test_update_stream(spark, tmp_path):
    from cellweave.operators import query, tiles

    states = [[1] * 16 for _ in range(16)]
    for r in range(16):
        states[r][8] = 2
    writer = mission.IndexWriter(tiles.Index.build(table(spark, states), tiles.Config(b=8)))
    pinned = writer.front
    updates(spark, [(3, 8, "open", None)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = writer.follow(mission.update_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/checkpoint")
    stream.processAllAvailable()
    stream.stop()
    vp = viewpoints(spark, [(3, 7), (3, 9)])
    assert as_matrix(query.matrix(writer.front, vp), 2)[0][1] == 2
    assert as_matrix(query.matrix(pinned, vp), 2)[0][1] == INF
    ver = writer.front.ver
    writer(updates(spark, [(3, 8, "block", None)]), 0)  # the same epoch again
    assert writer.front.ver == ver


def test_goal_persistence(spark, tmp_path):
    rows = [(1, t, "a" if t < 5 else "b") for t in range(8)]
    spark.createDataFrame(rows, "robot_id int, tick long, goal string").coalesce(1).write.parquet(f"{tmp_path}/in")
    goals = spark.readStream.schema("robot_id int, tick long, goal string").parquet(f"{tmp_path}/in")
    stream = mission.goal_persistence(goals, 3).writeStream.format("memory").queryName("kept").outputMode("append").start()
    stream.processAllAvailable()
    stream.stop()
    assert [x["left"] for x in spark.sql("select * from kept order by tick").collect()] == [3, 2, 1, 0, 0, 3, 2, 1]


def test_telemetry_sink(spark, tmp_path):
    rows = [("mission_telemetry", json.dumps({"tick": 1, "coverage_pct": 2.5})), ("frontier_events", json.dumps({"tick": 4, "frontier_id": 7})), ("frontier_events", json.dumps({"tick": 5, "frontier_id": 8}))]
    batch = spark.createDataFrame(rows, "table string, row string")
    sink = records.telemetry_sink(str(tmp_path))
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/mission_telemetry").count() == 1
    assert [x["frontier_id"] for x in spark.read.parquet(f"{tmp_path}/frontier_events").collect()] == [7]


def test_clear_path():
    clr = {(r, c): 3 for r in range(3) for c in range(3) if (r, c) != (1, 1)}
    path, cost = mission.shortest(clr, (0, 0), (2, 2))
    assert len(path) == 5 and cost == 4.0  # no corner is cut
    assert mission.shortest(clr, (0, 0), (1, 1)) == ([], float("inf"))


def test_mission_explores(spark):
    from cellweave.operators import tiles

    cells = maps.exploration_snapshot(maps.rooms(spark, 16, 32, 16, 42), (8, 8), 0.3, 0.0)
    run = mission.Mission(tiles.Index.build(cells, tiles.Config(b=16)), [(0, 8, 8)], scanner=mission.Scanner(1.0, 360.0, 24))
    first, second = run.step(), run.step()
    assert second["explored_cells"] >= first["explored_cells"] > 0 and second["tick"] == 1


def test_a_segment_asks_once_for_a_cell(spark, monkeypatch):
    """And for every cell under it: along a row, down a column, slanting, on the spot, off the map, and without a width."""
    draw = random.Random(3)
    states = [[2 if draw.random() < 0.2 else 1 for _ in range(12)] for _ in range(9)]
    ways = [(k, *(draw.random() * 12 * 0.25 for _ in range(4)), draw.choice([0.0, 0.02, 0.05, 0.3])) for k in range(60)]
    ways += [(60, 0.3, 0.3, 2.9, 0.3, 0.05), (61, 0.3, 0.3, 0.3, 2.2, 0.05), (62, 1.1, 1.1, 1.1, 1.1, 0.05), (63, 1.0, 1.0, -0.5, 1.0, 0.05)]
    table_of = spark.createDataFrame([("m", *w) for w in ways], "map_id string, id int, x1 double, y1 double, x2 double, y2 double, radius double")
    want, asked = {}, {}
    for k, x1, y1, x2, y2, radius in ways:
        n = max(1, math.ceil(math.hypot(x2 - x1, y2 - y1) / 0.035))
        eff, cells = min(radius, 0.38 * 0.25), set()
        for x, y in ((x1 + i / n * (x2 - x1), y1 + i / n * (y2 - y1)) for i in range(n + 1)):
            for r, c in itertools.product(range(math.floor((y - eff) / 0.25), math.floor((y + eff) / 0.25) + 1), range(math.floor((x - eff) / 0.25), math.floor((x + eff) / 0.25) + 1)):
                if max(c * 0.25 - x, x - (c + 1) * 0.25, 0) ** 2 + max(r * 0.25 - y, y - (r + 1) * 0.25, 0) ** 2 < eff * eff:
                    cells.add((r, c))
        asked[k] = sorted(cells)
        want[k] = all(0 <= r < 9 and 0 <= c < 12 and states[r][c] == 1 for r, c in cells)
    sent = []
    inner = neighbourhood._all_passable
    monkeypatch.setattr(neighbourhood, "_all_passable", lambda under, cells: sent.append(under.select("id", "r", "c").collect()) or inner(under, cells))
    got = neighbourhood.segment_clear(table_of, table(spark, states), 0.25).collect()
    assert {x["id"]: x["clear"] for x in got} == want and len(got) == len(ways)
    assert sorted(map(tuple, sent[0])) == [(k, r, c) for k in sorted(asked) for r, c in asked[k]]


def test_every_segment_is_asked(spark, monkeypatch):
    """Those that leave the map at its right side are not clear."""
    states = [[2 if (r * 7 + c * 3) % 11 == 0 else 1 for c in range(100)] for r in range(3)]
    monkeypatch.setattr(space, "cells", lambda *_: table(spark, states))
    got = {x["id"]: x["clear"] for x in space.segment_clear(spark, "").collect()}
    at = lambda r, c: c < 100 and states[r][c] == 1
    assert got == {r * 100 + c: at(r, c + 1) and at(r, c + 2) for r in range(3) for c in range(100) if at(r, c)}


def test_medoids_of_large_clusters_have_costs(spark, monkeypatch):
    own = table(spark, [[1] * 200 for _ in range(6)] + [[0] * 200 for _ in range(6)])
    monkeypatch.setattr(space.derived, "explored_cells", lambda *_: own)
    got = [(x["size"], x["cost"]) for x in space.frontier_medoids(spark, "").collect()]
    front = neighbourhood.frontier_cells(own).collect()
    n = len(front)
    r, c = sum(x["r"] for x in front) / n, sum(x["c"] for x in front) / n
    assert n > frontier.EXACT
    assert got == [(n, pytest.approx(min((x["r"] - r) ** 2 + (x["c"] - c) ** 2 + (200 if x["clr"] <= 1 else 20 if x["clr"] == 2 else 0) for x in front)))]


def test_paths_cost_what_they_say(spark):
    own = table(spark, [[2 if (r * 5 + c * 3) % 9 == 0 else 1 for c in range(14)] for r in range(10)])
    clr = {(x["r"], x["c"]): x["clr"] for x in neighbourhood.clearance(own).where("observed = 1").collect()}
    ends = sorted(clr)
    wanted = spark.createDataFrame([("m", k, *ends[k], *ends[-1 - k]) for k in range(8)], "map_id string, id long, r1 int, c1 int, r2 int, c2 int")
    for x in mission.clear_paths(own, wanted).collect():
        path = [(p["r"], p["c"]) for p in x["path"]]
        assert (path[0], path[-1]) == (ends[x["id"]], ends[-1 - x["id"]])
        cost = 0.0
        for a, b in zip(path, path[1:]):
            assert max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 and b in clr
            cost += (1.4142 if a[0] != b[0] and a[1] != b[1] else 1.0) + (35 if clr[b] <= 1 else 8 if clr[b] == 2 else 0)
        assert cost == pytest.approx(x["cost"])


def test_paths_are_found_in_the_tiles_around_them(spark):
    states = [[2 if (r * 7 + c * 11) % 13 == 0 or r % 8 == 7 and c != (r * 5) % 23 else 1 for c in range(23)] for r in range(60)]
    for r, c in ((29, 11), (31, 11), (30, 10), (30, 12)):
        states[r][c] = 2
    states[30][11] = 1  # closed in
    own = table(spark, states)
    clr = {(x["r"], x["c"]): x["clr"] for x in neighbourhood.clearance(own).where("observed = 1").collect()}
    ends = sorted(clr)
    pairs = [(ends[k * 13], ends[-1 - k * 29]) for k in range(12)] + [((0, 1), (1, 3)), ((0, 1), (30, 11)), ((30, 11), (0, 1)), ((0, 1), (99, 99)), ((-5, 0), (0, 1)), ((0, 0), (0, 1))]
    wanted = spark.createDataFrame([("m", k, *a, *b) for k, (a, b) in enumerate(pairs)] + [("none", 99, 0, 0, 1, 1)], "map_id string, id long, r1 int, c1 int, r2 int, c2 int")
    whole = {k: mission.shortest(clr, a, b) for k, (a, b) in enumerate(pairs)} | {99: ([], float("inf"))}
    for side in (4, 16, 256):
        got = {x["id"]: ([(p["r"], p["c"]) for p in x["path"]], float("inf") if x["cost"] is None else x["cost"]) for x in mission.clear_paths(own, wanted, side).collect()}
        assert got == whole
    assert whole[13] == ([], float("inf")) and whole[12][0]


def test_a_search_ends_where_its_raster_does():
    beyond = np.full((5, 9), 3, np.uint8)
    beyond[[0, -1]] = beyond[:, 0] = 0
    beyond[:, -1] = mission.BEYOND
    assert mission.within(beyond, 10, 12) == ([10, 11, 12], 2.0)
    assert mission.within(beyond, 16, 10) is None
    beyond[:, 5] = 0
    assert mission.within(beyond, 16, 10) == ([], float("inf"))


def test_weighted_rooms_have_the_weights(spark):
    rows = maps.weighted_rooms(spark, 48, 48).collect()
    free = [x["weight"] for x in rows if x["gt"] == 1]
    assert set(free) == set(maps.ROOM_WEIGHTS) and {x["weight"] for x in rows if x["gt"] != 1} == {1}
    plain = maps.rooms(spark, 48, 48)
    assert sorted((x["r"], x["c"], x["gt"]) for x in rows) == sorted((x["r"], x["c"], x["gt"]) for x in plain.collect())
    got = {x["map_id"]: x["has_weights"] for x in maps.has_weights(plain.withColumn("map_id", F.lit("even")).unionByName(maps.weighted_rooms(spark, 48, 48))).collect()}
    assert got == {"even": False, "rooms": True}


def test_targets_are_visited_and_replenished(spark):
    own = table(spark, [[1] * 60 for _ in range(40)])
    targets = fleet.patrol_targets(own, 4)
    at = {x["i"]: (x["r"], x["c"]) for x in targets.collect()}
    robots = spark.createDataFrame([("m", at[2][0], min(59, at[2][1] + 6) if at[2][1] < 54 else at[2][1] - 6)], "map_id string, r int, c int")
    left = fleet.unvisited(targets, robots)
    kept = {x["i"]: (x["r"], x["c"]) for x in left.collect()}
    assert 2 not in kept
    got = {x["i"]: (x["r"], x["c"]) for x in fleet.replenished(left, own, 7).collect()}
    fresh = {i: p for i, p in got.items() if i not in kept}
    assert {i: got[i] for i in kept} == kept and len(got) <= 7 and fresh
    for i, p in fresh.items():
        assert all((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 >= 16**2 for k, q in got.items() if k != i)
    # no other cell could have been added while there was room
    if len(got) < 7:
        assert all(any((r - q[0]) ** 2 + (c - q[1]) ** 2 < 16**2 for q in got.values()) for r in range(40) for c in range(60))


def test_a_stuck_robot_recovers(spark):
    """It is nudged after 6 ticks, backs up after 14 where there is room, spins, and is placed anew after 100 ticks in one place."""
    rows = [(1, t, 0.0, 0.0, True, False, True, 1.0) for t in range(130)] + [(2, t, 0.05 * t, 0.0, True, False, True, 1.0) for t in range(130)] + [(3, t, 0.0, 0.0, True, False, True, 0.0) for t in range(20)]
    out = recovery.recovery(spark.createDataFrame(rows, recovery.INPUT)).collect()
    phases = {k: [x["phase"] for x in sorted(out, key=lambda x: x["tick"]) if x["robot_id"] == k] for k in (1, 2, 3)}
    assert set(phases[2]) == {"none"} and "spin" in phases[3] and "back up" not in phases[3]
    first = {p: phases[1].index(p) for p in ("nudge", "back up", "spin")}
    assert first == {"nudge": 6, "back up": 13, "spin": 27}
    again = [x["tick"] for x in out if x["robot_id"] == 1 and x["respawned"]]
    assert again == [99] and any(x["skipped"] for x in out if x["robot_id"] == 1) is False


def test_a_patrol_needs_no_fog(spark):
    from cellweave.operators import tiles

    cells = maps.revealed(maps.rooms(spark, 32, 32, 16, 42))
    run = mission.Mission(tiles.Index.build(cells, tiles.Config(b=16)), [(0, 8, 8)], scanner=mission.Scanner(1.0, 360.0, 8), modes=mission.Modes(fog=False, queued=True, targets=3))
    row = run.step()
    assert row["active_viewpoints"] > 0 and row["newly_opened_cells"] == 0 and isinstance(run.writer, mission.QueuedWriter)


def test_manifest_says_what_it_was_made_with():
    made = json.loads(records.manifest({"b": 8}, "running"))
    assert made["status"] == "running" and made["build"]["pyspark"] and set(made["build"]) == {"pyspark", "git_sha", "git_branch", "git_dirty"}


def test_components_of_a_map_larger_than_a_square(spark, monkeypatch):
    monkeypatch.setattr(raster, "SQUARE", 8)
    states = [[2 if (r * 7 + c * 5) % 3 == 0 or (r == 9 and c != 20) else 1 for c in range(30)] for r in range(25)]
    own = table(spark, states)
    got = {(x["r"], x["c"]): (x["comp"], x["size"]) for x in raster.components(own).collect()}
    monkeypatch.undo()
    assert got == {(x["r"], x["c"]): (x["comp"], x["size"]) for x in raster.components(own).collect()}
    left, comp = {p for p in got}, {}
    for p in sorted(left):
        if p in comp:
            continue
        stack, number = [p], len(set(comp.values()))
        while stack:
            q = stack.pop()
            if q in left and q not in comp:
                comp[q] = number
                stack += [(q[0] + 1, q[1]), (q[0] - 1, q[1]), (q[0], q[1] + 1), (q[0], q[1] - 1)]
    assert {p: x[0] for p, x in got.items()} == comp


def test_frontiers_over_squares(spark, monkeypatch):
    """The same clusters, in the same visit and with the same numbers, when components reach over many squares."""
    draw = random.Random(6)
    states = [[0 if (r // 9 + c // 8) % 2 and draw.random() < 0.9 else 2 if draw.random() < 0.08 else 1 for c in range(60)] for r in range(50)]
    cells = table(spark, states).union(table(spark, states[:20], name="n"))
    key = lambda: sorted(map(tuple, frontier.cluster_cells(cells).collect()))
    whole = key()
    monkeypatch.setattr(raster, "SQUARE", 7)
    assert len(whole) > 100 and key() == whole


def test_nearest_by_rings(spark):
    draw = random.Random(7)
    points = [("m", 0, k, draw.randrange(500), draw.randrange(500)) for k in range(40)] + [("m", 1, 99, 3, 3), ("n", 0, 5, 1, 1)]
    others = [("m", 0, i, draw.randrange(60), draw.randrange(60)) for i in range(30)] + [("m", 0, 31, 499, 499), ("m", 0, 32, 499, 499), ("n", 0, 1, 400, 2)]
    a = spark.createDataFrame(points, "map_id string, comp int, robot_id int, r int, c int")
    b = spark.createDataFrame(others, "map_id string, comp int, i int, r int, c int")
    got = {(x["map_id"], x["robot_id"]): (x["d2"], x["i"]) for x in fleet.nearest(a, b, ["map_id", "comp"], "robot_id", 8).collect()}
    want = {}
    for m, k, n, r, c in points:
        near = [((r - y) ** 2 + (c - x) ** 2, i) for m2, k2, i, y, x in others if (m2, k2) == (m, k)]
        if near:
            want[m, n] = min(near)
    assert got == want
    assert fleet.nearest(a, b.limit(0), ["map_id", "comp"], "robot_id").collect() == []


def test_a_huge_map_file_is_split(spark, tmp_path):
    """Lines of one file read by many tasks, and numbered over ranges, are the cells of the whole text."""
    from cellweave.operators import scans

    draw = random.Random(8)
    body = ["".join(draw.choice(".GST@") for _ in range(draw.choice([40, 40, 30]))) for _ in range(300)]
    text = "type octile\r\nheight 305 \nheight 7\nwidth 40\nmap\n" + "\n".join(body) + "\n"
    (tmp_path / "a map.map").write_text(text)
    (tmp_path / "b.map").write_text("height 2\nwidth 2\nmap\n.@\n")
    (tmp_path / "none.map").write_text("height 2\nmap\n..\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    most = scans.MOST
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        scans.MOST = 0
        got = {(x["map_id"], x["r"], x["c"]): x["gt"] for x in maps.read_maps(spark, f"{tmp_path}/*.map").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        scans.MOST = most
    want = {("a map", r, c): 1 if r < 300 and body[r][c : c + 1] in (".", "G", "S") else 2 for r in range(305) for c in range(40)}
    assert got == want | {("b", 0, 0): 1, ("b", 0, 1): 2, ("b", 1, 0): 2, ("b", 1, 1): 2}


def test_hashes_of_long_maps(spark):
    """Hashes of cells pass an int on maps of some hundred thousand cells."""
    from cellweave.sources import derived

    far = [(3, 7), (2_800, 13), (59_999, 99), (400_000, 5)]
    cells = spark.createDataFrame([("m", 500_000, 100, r, c, 1, 1, 1) for r, c in far], "map_id string, rows int, cols int, r int, c int, gt int, observed int, weight int")
    by = lambda h: [p for _, p in sorted((h(*p), p) for p in far)]
    got = lambda df: [(x["r"], x["c"]) for x in df.orderBy("i").collect()]
    assert got(derived.viewpoints(cells, 4)) == by(lambda r, c: (r * 100 + c) * 7919 % 10007)
    assert got(sampling.uniform(cells, 4)) == by(lambda r, c: (r * 100_003 + c) * 7919 % 1_000_003)


def test_nearest_passable_beside_and_beyond(spark):
    """Against all pairs: points on, beside and far from passable cells, with ties."""
    draw = random.Random(4)
    states = [[1 if draw.random() < (0.5 if c < 12 else 0.01) else 2 for c in range(40)] for _ in range(24)]
    free = [(r, c) for r, line in enumerate(states) for c, s in enumerate(line) if s == 1]
    cells = table(spark, states)
    for radii in ((16, 32), (2,), (1,)):
        got = neighbourhood.nearest_passable(cells.select("map_id", (F.col("r") * 100 + F.col("c")).alias("id"), "r", "c"), cells, radii).collect()
        assert len(got) == 24 * 40
        for x in got:
            p = x["r"], x["c"]
            near = [(max(abs(q[0] - p[0]), abs(q[1] - p[1])) > radii[0], (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, q) for q in free if max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= max(radii)]
            assert (x["snap_r"], x["snap_c"]) == (min(near)[2] if near else p)
