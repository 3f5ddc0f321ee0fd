"""The tile index against independent searches, on the scenarios and random scripts."""

import random

import numpy as np
import pytest

from cellweave.operators import query, raster, search, tiles
from cellweave.session import INF
from cellweave.sources import maps
from tests.grids import as_matrix, opened, plain_matrix, table, updates, viewpoints


def check(spark, states, points, config, weights=None, script=()):
    """Build, apply each batch of the script, and compare full, refreshed and pairwise answers with plain searches."""
    index = tiles.Index.build(table(spark, states, weights), config)
    vp = viewpoints(spark, points)
    answer = query.ask(index, vp)
    out = [as_matrix(answer.matrix(), len(points))]
    assert out[0] == plain_matrix(states, points, weights)
    states, weights = [list(x) for x in states], [list(x) for x in weights] if weights else [[1] * len(x) for x in states]
    for batch in script:
        index = index.update(updates(spark, batch))
        for r, c, op, w in batch:
            if op == "reweight":
                weights[r][c] = w
            else:
                states[r][c] = 1 if op == "open" else 2
        answer = answer.refresh(index)
        expected = plain_matrix(states, points, weights)
        assert as_matrix(answer.matrix(), len(points)) == expected
        out.append(expected)
    assert as_matrix(query.matrix(index, vp), len(points)) == out[-1]
    return out


def test_seams_at_two_levels(spark):
    before, after = check(spark, opened(32, 32, [(4, 16)]), [(4, 15), (4, 16)], tiles.Config(b=8), script=[[(4, 15, "open", None), *((4, c, "open", None) for c in range(10, 21))]])
    assert before[0][1] == INF and after[0][1] == 1
    _, after = check(spark, opened(32, 32, [(16, 8)]), [(15, 8), (16, 8)], tiles.Config(b=8), script=[[(r, 8, "open", None) for r in range(10, 23)]])
    assert after[0][1] == 1


def test_pending_seam_above_an_unchanged_summary(spark):
    states = opened(32, 32, [*((7, c) for c in range(8, 15)), *((r, 8) for r in range(3, 7)), (7, 16), (7, 17)])
    assert check(spark, states, [(7, 10), (7, 16)], tiles.Config(b=8), script=[[(7, 15, "open", None)]])[1][0][1] == 6


def test_block_on_an_outer_seam(spark):
    states = [[1] * 32 for _ in range(32)]
    for r, c in [(14, 15), (15, 14), (16, 16), *((15, c) for c in range(17, 32)), *((r, 15) for r in range(17, 32))]:
        states[r][c] = 2
    before, after = check(spark, states, [(16, 15), (15, 16)], tiles.Config(b=8), script=[[(15, 15, "block", None)]])
    assert (before[0][1], after[0][1]) == (2, 10)


def test_weighted_reopening(spark):
    out = check(spark, [[1] * 8 for _ in range(8)], [(0, 0), (0, 5)], tiles.Config(b=2), [[5] * 8 for _ in range(8)], [[(0, 3, "block", None)], [(0, 3, "open", None)]])
    assert out[0][0][1] == out[2][0][1] == 25


def test_two_halves_and_a_blocked_viewpoint(spark):
    states = [[2 if c == 16 else 1 for c in range(32)] for _ in range(32)]
    points = [(4, 4), (8, 12), (4, 20), (8, 28), (20, 16)]
    _, after = check(spark, states, points, tiles.Config(b=16), script=[[(8, 16, "open", None)]])
    assert after[0] == [0, 12, 24, 28, INF] and after[4] == [INF] * 5


def test_choke_weight_up_and_down(spark):
    states = [[2 if r == 8 and c != 5 else 1 for c in range(16)] for r in range(16)]
    weights = [[30 if (r, c) == (8, 5) else 2 for c in range(16)] for r in range(16)]
    out = check(spark, states, [(2, 2), (13, 13)], tiles.Config(b=4), weights, [[(8, 5, "reweight", 1)], [(8, 5, "reweight", 60), (0, 0, "block", None)]])
    assert out[1][0][1] < out[0][0][1] < out[2][0][1]


@pytest.mark.parametrize(("seed", "b", "g"), [(1, 4, 2), (2, 8, 2), (3, 4, 3)])
def test_random_scripts(spark, seed, b, g):
    draw = random.Random(seed)
    rows, cols = 20, 27
    states = [[2 if draw.random() < 0.3 else 1 for _ in range(cols)] for _ in range(rows)]
    weights = [[draw.randint(1, 20) for _ in range(cols)] for _ in range(rows)]
    points = [(draw.randrange(rows), draw.randrange(cols)) for _ in range(7)]
    points.append(points[0])
    script = [[(draw.randrange(rows), draw.randrange(cols), draw.choice(["open", "open", "block", "reweight"]), draw.randint(1, 30)) for _ in range(12)] for _ in range(2)]
    last = {}
    for batch in script:  # one state and one weight change a cell, so that their order does not matter here
        batch[:] = list({(r, c, op == "reweight"): (r, c, op, w) for r, c, op, w in batch}.values())
        last.update({(r, c): op for r, c, op, _ in batch})
    matrices = check(spark, states, points, tiles.Config(b=b, g=g), weights, script)
    for m in matrices:
        m = np.array(m)
        assert (m == m.T).all()


@pytest.mark.parametrize(("seed", "b", "g"), [(4, 4, 2), (5, 3, 3)])
def test_few_openings_climb_to_the_rows_of_a_build(spark, seed, b, g):
    """Openings one by one and together, in tiles that had no passable cell too: every summary equals a new build's."""
    draw = random.Random(seed)
    rows, cols = 22, 25
    states = [[1 if draw.random() < 0.45 and not (r < 8 and c < 8) else 2 for c in range(cols)] for r in range(rows)]
    weights = [[draw.randint(1, 20) for _ in range(cols)] for _ in range(rows)]
    points = [(draw.randrange(rows), draw.randrange(cols)) for _ in range(6)]
    script = [[(draw.randrange(rows), draw.randrange(cols), "open", None) for _ in range(n)] for n in (1, 1, 9, 40)]
    script[0].append((-1, 99, "open", None))  # outside the map
    matrices = check(spark, states, points, tiles.Config(b=b, g=g), weights, [[u for u in batch if u[0] >= 0] for batch in script])
    assert len(matrices) == 5
    index = tiles.Index.build(table(spark, states, weights), tiles.Config(b=b, g=g))
    for batch in script:
        index = index.update(updates(spark, batch))
        for r, c, *_ in batch:
            if r >= 0:
                states[r][c] = 1
    new = tiles.Index.build(table(spark, states, weights), index.config)
    key = lambda t: {(x["lvl"], x["tx"], x["ty"]): tuple(bytes(x[k]) for k in ("S", "P", "E", "A")) for x in t.at().collect()}
    assert key(index) == key(new)
    truth = {(x["lvl"], x["tx"], x["ty"]): tiles.matrix_of(x["D"]) for x in new.at().where("lvl > 0").collect()}
    assert all((tiles.matrix_of(x["D"]) == truth[x["lvl"], x["tx"], x["ty"]]).all() for x in index.at().where("lvl > 0").collect())


def test_a_branch_ends_where_nothing_changes(spark):
    """A blind alley renews its leaf alone; readers of lifts still meet its ancestors."""
    states = [[1] * 32 for _ in range(32)]
    for r, c in ((3, 3), (2, 3), (4, 3), (3, 2)):
        states[r][c] = 2
    index = tiles.Index.build(table(spark, states), tiles.Config(b=8))
    newer = index.update(updates(spark, [(3, 3, "open", None)]))
    assert [(x["lvl"], x["tx"], x["ty"]) for x in newer.rows.where("ver = 1").collect()] == [(0, 0, 0)]
    assert tuple(newer.batch_stats().first())[1:3] == (1, 2)
    answer = query.ask(index, viewpoints(spark, [(3, 3), (30, 30)])).refresh(newer)
    assert as_matrix(answer.matrix(), 2) == [[0, 54], [54, 0]]


def test_a_map_that_no_root_can_hold(spark):
    """Open maps whose upper levels would have too many ports: paths through many tiles of the top level, before and after updates."""
    draw = random.Random(11)
    states = [[2 if draw.random() < 0.15 or (c == 13 and r > 2) else 1 for c in range(27)] for r in range(20)]
    weights = [[draw.randint(1, 9) for _ in range(27)] for _ in range(20)]
    points = [(0, 0), (19, 26), (18, 1), (3, 20), (13, 13), (0, 26), (18, 1)]
    config = tiles.Config(b=4, max_ports=20)
    index = tiles.Index.build(table(spark, states, weights), config)
    assert index.height == 0 and not index.whole
    script = [[(r, 13, "open", None) for r in (8, 9)], [(0, 13, "block", None), (1, 13, "block", None), (5, 5, "reweight", 30)]]
    check(spark, states, points, config, weights, script)


def test_sizes_have_levels_that_are_not_kept(spark):
    """They are counted, and as large as an index that keeps them says."""
    draw = random.Random(12)
    states = [[2 if draw.random() < 0.2 else 1 for _ in range(27)] for _ in range(50)]
    read = lambda index: sorted(map(tuple, index.sizes().collect()))
    whole, cut = (tiles.Index.build(table(spark, states), tiles.Config(b=4, max_ports=m)) for m in (8192, 60))
    assert whole.whole and whole.height == 4 and cut.height == 1
    assert read(cut) == read(whole) and len(read(whole)) == 5
    batch = updates(spark, [(r, 9, "open", None) for r in range(50)] + [(30, c, "block", None) for c in range(27)])
    assert read(cut.update(batch)) == read(whole.update(batch))


def test_an_opening_makes_a_level_too_wide(spark):
    """The index goes on without the level above."""
    states = [[1 if r in (3, 4) or c in (3, 4) else 2 for c in range(16)] for r in range(16)]
    index = tiles.Index.build(table(spark, states), tiles.Config(b=4, max_ports=40))
    assert index.whole and index.height == 2
    batch = [(r, c, "open", None) for r in range(8) for c in range(8)]
    newer = index.update(updates(spark, batch))
    assert not newer.whole and newer.height < 2
    for r, c, *_ in batch:
        states[r][c] = 1
    points = [(0, 0), (15, 4), (4, 15), (7, 7)]
    assert as_matrix(query.matrix(newer, viewpoints(spark, points)), 4) == plain_matrix(states, points)


def test_growth_keeps_the_old_tree(spark):
    draw = random.Random(5)
    states = [[2 if draw.random() < 0.25 else 1 for _ in range(32)] for _ in range(32)]
    points = [(1, 1), (12, 14), (20, 3), (30, 30)]
    small = [[s if r < 16 and c < 16 else 2 for c, s in enumerate(line)] for r, line in enumerate(states)]
    index = tiles.Index.build(table(spark, [line[:16] for line in states[:16]]), tiles.Config(b=8))
    assert index.height == 1
    grown = index.grow(table(spark, states))
    assert grown.height == 2
    assert as_matrix(query.matrix(grown, viewpoints(spark, points)), 4) == plain_matrix(states, points)
    assert small[0][:16] == states[0][:16]


def test_growth_from_no_cells_and_over_wide_nodes(spark):
    """The quarter that growth begins with may have no cells, and new nodes may be too wide: the index covers the new map all the same."""
    draw = random.Random(6)
    states = [[2 if draw.random() < 0.25 else 1 for _ in range(16)] for _ in range(16)]
    points = [(1, 1), (14, 5), (3, 12), (15, 15)]
    expected = plain_matrix(states, points)
    own = table(spark, states)
    for start, config, height in ((own.where("false"), tiles.Config(b=4), 2), (table(spark, [line[:8] for line in states[:8]]), tiles.Config(b=4, max_ports=20), 0)):
        grown = tiles.Index.build(start, config).grow(own)
        assert grown.height == height
        assert as_matrix(query.matrix(grown, viewpoints(spark, points)), 4) == expected


def test_hybrid_and_pairs(spark):
    states = [[2 if (r + c) % 7 == 3 else 1 for c in range(16)] for r in range(16)]
    points = [(0, 0), (15, 15), (5, 9)]
    index = tiles.Index.build(table(spark, states), tiles.Config(b=8, hybrid_k=3))
    expected = plain_matrix(states, points)
    assert as_matrix(query.matrix(index, viewpoints(spark, points), 3), 3) == expected
    wanted = spark.createDataFrame([("m", 1, 0, 0, 15, 15), ("m", 2, 5, 9, 0, 0)], "map_id string, id long, r1 int, c1 int, r2 int, c2 int")
    assert {x["id"]: x["d"] for x in query.pairs(index, wanted).collect()} == {1: expected[0][1], 2: expected[2][0]}


def test_leaf_kernels_agree():
    draw = np.random.default_rng(0)
    for _ in range(20):
        weight = draw.integers(1, 9, (6, 6)) * (draw.random((6, 6)) < 0.6)
        weight = weight.astype(np.int32)
        shut = np.flatnonzero(weight.ravel() == 0)
        opened_ = draw.choice(shut, min(3, len(shut)), replace=False)
        dist = tiles.leaf_distances(weight)
        after = weight.copy()
        after.ravel()[opened_] = 4
        grown, _ = tiles.open_cells(dist.copy(), after, opened_)
        assert (grown == tiles.leaf_distances(after)).all()


def test_sizes_follow_the_closed_form():
    assert round(tiles.dense_bytes(256, 16, 2) / 2**20, 1) == 87.0
    assert round(tiles.dense_bytes(512, 16, 2) / 2**20, 1) == 403.6
    with pytest.raises(ValueError):
        tiles.Config(b=1)


def test_rooms(spark):
    cells = maps.rooms(spark, 64, 64, 16, 42)
    assert cells.where("observed = 1").count() == 3184
    assert raster.components(cells, "observed").select("comp").distinct().count() == 1
    wanted = spark.createDataFrame([("rooms", 1, 8, 8, 56, 56)], "map_id string, id long, r1 int, c1 int, r2 int, c2 int")
    assert search.pairs(cells, wanted).first()["d"] == 100
    assert maps.rooms(spark, 32, 32, 16, 42).where("observed = 1").count() == 792


def test_twister():
    draw = maps.Mersenne64(5489)
    assert [draw() for _ in range(10000)][-1] == 9981545732273789042


def test_long_ways_are_no_ways(spark):
    weights = [[30000] * 4]
    cells = table(spark, [[1] * 4], weights)
    m = as_matrix(search.matrix(cells, viewpoints(spark, [(0, 0), (0, 1), (0, 2)]).drop("query_id"), weighted=True), 3)
    assert m == [[0, 30000, INF], [30000, 0, 30000], [INF, 30000, 0]]


def test_outside_empty_and_duplicate_viewpoints(spark):
    cells = table(spark, [[1, 1], [1, 2]])
    m = as_matrix(search.matrix(cells, viewpoints(spark, [(0, 0), (5, 5), (0, 0), (1, 1)]).drop("query_id")), 4)
    assert m == [[0, INF, 0, INF], [INF] * 4, [0, INF, 0, INF], [INF] * 4]
    other = search.matrix(cells, viewpoints(spark, [(0, 0)], "no such map").drop("query_id"))
    assert [x["d"] for x in other.collect()] == [INF]
    assert search.matrix(cells.limit(0), viewpoints(spark, [(0, 0)]).drop("query_id")).first()["d"] == INF


def test_wide_nodes_take_few_copies():
    """Passing places of a wide node and making its row take no further copies of its matrix."""
    import tracemalloc

    draw = np.random.default_rng(3)
    n = 1500
    dist = draw.integers(1, 1000, (n, n)).astype(np.int32)
    dist = np.minimum(dist, dist.T)
    np.fill_diagonal(dist, 0)
    want = dist.copy()
    for k in range(0, n, 300):
        np.minimum(want, want[:, k, None] + want[None, k, :], out=want)
    tiles._row("m", 0, 1, 0, 0, 0, *[dist[0]] * 5)  # what a first array imports
    tracemalloc.start()
    tiles.relax(dist, np.arange(0, n, 300))
    row = tiles._row("m", 0, 1, 0, 0, 0, dist, dist, dist[0], dist[0], dist[0, :0])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < dist.nbytes / 2 and (dist == want).all()
    assert row.column("D")[0].as_py() == want.tobytes() and row.column("A")[0].as_py() == b""
