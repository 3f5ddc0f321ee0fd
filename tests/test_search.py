"""Searches spread over tiles, against an independent search."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import search
from cellweave.session import INF
from tests.grids import as_matrix, plain_matrix, table, viewpoints


def maze(draw, rows, cols, walls):
    return [[2 if draw.random() < walls else draw.choice([1, 1, 1, 1, 0]) for _ in range(cols)] for _ in range(rows)]


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("walls", [0.0, 0.3])
def test_matrices_over_many_tiles(spark, monkeypatch, weighted, walls):
    """Tiles of 5 cells on a map of 23 x 17: paths leave tiles and come back; a bucket is narrower than a tile."""
    draw = random.Random(walls)
    states = maze(draw, 23, 17, walls)
    weights = [[draw.randint(1, 20) for _ in line] for line in states]
    monkeypatch.setattr(search, "SIDE", 5)
    monkeypatch.setattr(search, "BUCKET", 0.5)
    points = [(draw.randrange(23), draw.randrange(17)) for _ in range(9)] + [(0, 0), (0, 0)]
    got = search.matrix(table(spark, states, weights), viewpoints(spark, points).drop("query_id"), weighted)
    assert as_matrix(got, len(points)) == plain_matrix(states, points, weights if weighted else None)


def test_a_snake_crosses_every_tile_often(spark, monkeypatch):
    states = [[1] * 16 if r % 2 == 0 else [2] * 16 for r in range(16)]
    for r in range(1, 15, 2):
        states[r][0 if r % 4 == 3 else 15] = 1
    monkeypatch.setattr(search, "SIDE", 8)
    points = [(0, 0), (14, 0), (14, 15), (6, 7)]
    assert as_matrix(search.matrix(table(spark, states), viewpoints(spark, points).drop("query_id")), 4) == plain_matrix(states, points)


def test_one_to_many_and_pairs_over_tiles(spark, monkeypatch):
    draw = random.Random(9)
    states = maze(draw, 20, 30, 0.2)
    states[3][4] = 1
    monkeypatch.setattr(search, "SIDE", 7)
    cells = table(spark, states)
    got = search.one_to_many(cells, (3, 4), cells.select("map_id", (F.col("r") * 30 + F.col("c")).alias("j"), "r", "c"))
    every = [(r, c) for r in range(20) for c in range(30)]
    want = plain_matrix(states, [(3, 4), *every])[0][1:]
    assert [x["d"] for x in got.orderBy("j").collect()] == want
    wanted = spark.createDataFrame([("m", k, 3, 4, r, c) for k, (r, c) in enumerate(every[::17])] + [("none", 99, 0, 0, 1, 1), ("m", 98, -1, 0, 50, 50)], "map_id string, id long, r1 int, c1 int, r2 int, c2 int")
    got = {x["id"]: x["d"] for x in search.pairs(cells, wanted).collect()}
    assert got == {**{k: want[every.index(p)] for k, p in enumerate(every[::17])}, 99: INF, 98: INF}


def test_several_maps_of_different_sizes(spark, monkeypatch):
    monkeypatch.setattr(search, "SIDE", 6)
    draw = random.Random(4)
    maps = {name: maze(draw, r, c, 0.2) for name, r, c in (("a", 5, 4), ("b", 14, 9), ("c", 6, 13))}
    cells = None
    points = [(0, 0), (4, 3), (2, 2)]
    for name, states in maps.items():
        one = table(spark, states, name=name)
        cells = one if cells is None else cells.union(one)
    views = spark.createDataFrame([(name, i, r, c) for name in maps for i, (r, c) in enumerate(points)], "map_id string, i int, r int, c int")
    got = search.matrix(cells, views)
    for name, states in maps.items():
        assert as_matrix(got.where(F.col("map_id") == name), 3) == plain_matrix(states, points)


def test_a_large_map_takes_tiles_in_turn(spark):
    """4096 x 4096 cells, 16 tiles: streets every 32 cells. Distances between crossings are known, around a wall too."""
    n = 4096
    place = spark.range(n * n).select((F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"))
    free = (F.col("r") % 32 == 0) | (F.col("c") % 32 == 0)
    wall = (F.col("c") == 2048) & (F.col("r") < 4000) | (F.col("r") % 32 == 0) & (F.col("c") == 2047) & (F.col("r") < 4000)
    state = F.when(free & ~wall, 1).otherwise(2)
    cells = place.select(F.lit("m").alias("map_id"), F.lit(n).alias("rows"), F.lit(n).alias("cols"), "r", "c", state.alias("gt"), state.alias("observed"), F.lit(1).alias("weight"))
    points = [(0, 0), (0, 4064), (4064, 4064), (64, 1024), (2016, 32)]
    got = as_matrix(search.matrix(cells, viewpoints(spark, points).drop("query_id")), len(points))
    around = lambda a, b: min(abs(a[0] - g) + abs(b[0] - g) + abs(a[1] - b[1]) for g in (4000, 4032, 4064))
    far = lambda a, b: around(a, b) if (a[1] < 2048) != (b[1] < 2048) else abs(a[0] - b[0]) + abs(a[1] - b[1])
    assert got == [[far(a, b) for b in points] for a in points]


def test_long_narrow_maps_take_few_tiles(spark, monkeypatch):
    """A tile has as many cells as a square one: maps narrower than a side are cut into strips across, flat ones down."""
    assert search.extent(60_000, 100, 1024) == (10_485, 1024) and search.extent(100, 60_000, 1024) == (1024, 10_485)
    assert search.extent(4096, 4096, 1024) == (1024, 1024)
    draw = random.Random(6)
    states = maze(draw, 70, 4, 0.2)
    points = [(draw.randrange(70), draw.randrange(4)) for _ in range(7)]
    monkeypatch.setattr(search, "SIDE", 8)
    rounds, inner = [], search._round
    monkeypatch.setattr(search, "_round", lambda *a: rounds.append(1) or inner(*a))
    for turned in (False, True):
        own = [list(x) for x in zip(*states)] if turned else states
        at = [(c, r) for r, c in points] if turned else points
        rounds.clear()
        got = search.matrix(table(spark, own), viewpoints(spark, at).drop("query_id"))
        assert as_matrix(got, 7) == plain_matrix(own, at) and len(rounds) <= 5  # 5 tiles; squares of 8 would be 9
