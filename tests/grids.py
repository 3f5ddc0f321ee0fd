"""Small maps and an independent search."""

import heapq

from cellweave.session import INF

COLUMNS = "map_id string, rows int, cols int, r int, c int, gt int, observed int, weight int"


def table(spark, states, weights=None, name="m"):
    """states: rows of 0, 1, 2."""
    rows, cols = len(states), len(states[0])
    data = [(name, rows, cols, r, c, s or 1, s, weights[r][c] if weights else 1) for r, line in enumerate(states) for c, s in enumerate(line)]
    return spark.createDataFrame(data, COLUMNS)


def opened(rows, cols, cells):
    """A blocked map with some free cells."""
    out = [[2] * cols for _ in range(rows)]
    for r, c in cells:
        out[r][c] = 1
    return out


def plain_matrix(states, points, weights=None):
    """Dijkstra from each point, cell by cell."""
    def search(start):
        if states[start[0]][start[1]] != 1:
            return {}
        best, heap = {start: 0}, [(0, start)]
        while heap:
            d, (r, c) = heapq.heappop(heap)
            if d > best[r, c]:
                continue
            for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= y < len(states) and 0 <= x < len(states[0]) and states[y][x] == 1:
                    new = d + (max(1, (weights[r][c] + weights[y][x]) // 2) if weights else 1)
                    if new < best.get((y, x), INF):
                        best[y, x] = new
                        heapq.heappush(heap, (new, (y, x)))
        return best

    found = [search(p) for p in points]
    return [[f.get(tuple(q), INF) if states[q[0]][q[1]] == 1 else INF for q in points] for f in found]


def viewpoints(spark, points, name="m", query="q"):
    return spark.createDataFrame([(name, query, i, r, c) for i, (r, c) in enumerate(points)], "map_id string, query_id string, i int, r int, c int")


def as_matrix(df, n):
    out = [[None] * n for _ in range(n)]
    for row in df.collect():
        assert out[row["i"]][row["j"]] is None
        out[row["i"]][row["j"]] = row["d"]
    return out


def updates(spark, rows, name="m"):
    """rows: (r, c, op, weight) in order."""
    return spark.createDataFrame([(name, r, c, k, op, w) for k, (r, c, op, w) in enumerate(rows)], "map_id string, r int, c int, seq long, op string, weight int")
