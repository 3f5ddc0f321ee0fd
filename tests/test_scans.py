"""Running values and quantiles, in one task a key and over ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cellweave.operators import scans, stats
from cellweave.sources import records
from cellweave.streaming import mission


@pytest.fixture(params=[1 << 20, 0], ids=["windows", "ranges"])
def most(request, monkeypatch):
    monkeypatch.setattr(scans, "MOST", request.param)


def rows(seed):
    """One key has most of the rows, and some keys and values are null."""
    draw = random.Random(seed)
    return [(draw.choice(["hot"] * 6 + ["a", "b", None]), n, draw.choice([None, 1, 2, 3]), draw.random()) for n in range(600)]


@pytest.mark.parametrize("by", [["k"], []])
def test_running(spark, most, by):
    data = rows(1)
    df = spark.createDataFrame(data, "k string, n long, v long, x double").repartition(5)
    got = scans.running(df, by, [F.col("n").asc()], sums={"s": F.col("v")}, lasts={"l": F.col("v")}, before={"p": F.col("v")}).orderBy("n").collect()
    total, last, prev = {}, {}, {}
    for (k, n, v, _), x in zip(data, got):
        k = k if by else 0
        total[k] = total.get(k, 0) + (v or 0)
        last[k] = last.get(k) if v is None else v
        assert (x["n"], x["s"], x["l"], x["p"]) == (n, total[k], last[k], prev.get(k))
        prev[k] = v


def test_quantiles(spark, most):
    data = rows(2) + [("one", 9, 1, 0.5), ("none", 9, 1, None)]
    df = spark.createDataFrame(data, "k string, n long, v long, x double").repartition(5)
    got = {x["k"]: x for x in stats.summary(df, "x", "k").collect()}
    tails = {x["k"]: x for x in stats.median_p95(df, "x", "k").collect()}
    upper = {x["k"]: x["upper_median"] for x in stats.upper_median(df, "x", "k").collect()}
    assert got["none"]["median"] is None and got["one"]["q1"] == 0.5 and "none" not in upper
    for k in ("hot", "a", "b", None):
        own = sorted(x for key, _, _, x in data if key == k)
        q = statistics.quantiles(own, n=20, method="inclusive")
        assert [got[k][c] for c in ("q1", "median", "q3")] == pytest.approx([q[4], q[9], q[14]])
        assert (tails[k]["median"], tails[k]["p95"]) == pytest.approx((q[9], q[18]))
        assert upper[k] == own[len(own) // 2]
    assert stats.summary(df, "x").first()["median"] == pytest.approx(statistics.median(x for *_, x in data if x is not None))
    assert stats.summary(df.limit(0), "x").first()["median"] is None


def test_tracks_averages_and_logs(spark, most):
    draw = random.Random(3)
    track = [(1, n, float(n // 4), 0.0) for n in range(200)] + [(2, n, draw.random(), draw.random()) for n in range(50)]
    df = spark.createDataFrame(track, "id long, tick long, x double, y double").repartition(4)
    assert {x["id"]: x["distance"] for x in stats.distance_travelled(df, "id", "tick").collect()}[1] == 49
    runs = stats.stuck_runs(df, "id", "tick", 4).where("id = 1").collect()
    assert sorted((x["first"], x["last"], x["ticks"]) for x in runs) == [(k, k + 3, 4) for k in range(0, 200, 4)]
    ema = None
    for _, _, x, _ in track[200:]:
        ema = x if ema is None else 0.85 * ema + 0.15 * x
    assert {x["id"]: x["ema"] for x in stats.moving_average(df, "id", "tick", "x").collect()}[2] == pytest.approx(ema)
    lines = ["before", "=== a ===", *["Queries: 3, Matches: 2"] * 90, "=== b ===", *["MaxDiff: 7", "verifications=5, openings=2"] * 60]
    log = spark.createDataFrame([("log", n, x) for n, x in enumerate(lines)], "log string, n long, line string").repartition(3)
    assert sorted(map(tuple, records.scrape_logs(log).collect())) == [("log", "a", 270, 180, 0), ("log", "b", 300, 300, 7)]


def test_lag_gauges_between_ticks(spark, most):
    offered = spark.createDataFrame([(t, t % 5) for t in range(0, 90, 3)], "tick long, n long")
    applied = spark.createDataFrame([(t, t - t % 7) for t in range(95)], "tick long, upto long")
    got = {x["tick"]: (x["pending"], x["lag"]) for x in mission.lag_gauges(offered, applied).collect()}
    assert got == {t: (sum(s % 5 for s in range(0, 90, 3) if t - t % 7 < s <= t), t % 7) for t in range(95)}
