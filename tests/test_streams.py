"""Durable versions, paired streams and timers."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from cellweave.operators import query, tiles
from cellweave.streaming import mission, timers, versions
from tests.grids import as_matrix, plain_matrix, table, updates, viewpoints


def scene(seed):
    draw = random.Random(seed)
    states = [[2 if draw.random() < 0.35 else 1 for _ in range(20)] for _ in range(18)]
    points = [(draw.randrange(18), draw.randrange(20)) for _ in range(5)]
    batches = [[(draw.randrange(18), draw.randrange(20), draw.choice(["open", "open", "block"]), None) for _ in range(4)] for _ in range(5)]
    return states, points, [list({u[:2]: u for u in b}.values()) for b in batches]


def after(states, batches):
    states = [list(x) for x in states]
    for batch in batches:
        for r, c, op, _ in batch:
            states[r][c] = 1 if op == "open" else 2
    return states


def answer(spark, index, points):
    return as_matrix(query.matrix(index, viewpoints(spark, points)), len(points))


def test_a_writer_that_dies_between_epochs(spark, tmp_path, monkeypatch):
    """One dies before it publishes, one after it has and before the stream notes it; the third goes on. Readers keep their pin."""
    states, points, batches = scene(1)
    monkeypatch.setattr(versions, "COMPACT", 3)
    log = versions.VersionLog(spark, f"file://{tmp_path}/log")
    assert log.index() is None
    versions.LoggedWriter(log, tiles.Index.build(table(spark, states), tiles.Config(b=4)))
    name, pinned = log.pin()
    put, calls = versions.VersionLog._put, []

    def dying(self, file, text):
        calls.append(file)
        if len(calls) == 2:
            raise RuntimeError("stopped before publishing")
        put(self, file, text)
        if len(calls) == 4:
            raise RuntimeError("stopped after publishing")

    monkeypatch.setattr(versions.VersionLog, "_put", dying)
    for k, batch in enumerate(batches):
        updates(spark, batch).withColumn("seq", F.lit(k).cast("long")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    failures = 0
    for _ in range(3):
        stream = versions.LoggedWriter(versions.VersionLog(spark, f"file://{tmp_path}/log")).follow(mission.update_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/checkpoint")
        try:
            stream.processAllAvailable()
        except Exception:
            failures += 1
        stream.stop()
    assert failures == 2 and log.manifest()["epoch"] == 4
    assert answer(spark, log.index(), points) == plain_matrix(after(states, batches), points)
    assert len(log.numbers()) == 6
    gone = log.clean(keep=1)
    assert any(x.startswith("rows/") for x in gone) and len(log.numbers()) == 2
    assert answer(spark, pinned, points) == plain_matrix(states, points)
    log.unpin(name)
    log.clean(keep=1)
    assert len(log.numbers()) == 1 and not (tmp_path / "log" / "rows").joinpath("none").exists()
    assert answer(spark, log.index(), points) == plain_matrix(after(states, batches), points)


def test_two_writers_cannot_publish_one_number(spark, tmp_path):
    log = versions.VersionLog(spark, f"file://{tmp_path}/log")
    log._put("log/0000000001.json", "{}")
    with pytest.raises(Exception, match="exist"):
        log._put("log/0000000001.json", "{}")


def test_offers_wait_while_a_version_is_made(spark, tmp_path, monkeypatch):
    """Offers return at once; those that come meanwhile make one version; a writer that is not closed leaves them for the next."""
    states, points, batches = scene(2)
    log = versions.VersionLog(spark, f"file://{tmp_path}/log")
    started, go = threading.Event(), threading.Event()
    apply = versions.LoggedWriter.apply

    def slow(self, batch, epochs):
        started.set()
        assert go.wait(120)
        apply(self, batch, epochs)

    monkeypatch.setattr(versions.LoggedWriter, "apply", slow)
    writer = versions.AsyncWriter(log, tiles.Index.build(table(spark, states), tiles.Config(b=4)))
    writer(updates(spark, batches[0]), 0)
    assert started.wait(60)
    for k in (1, 2, 3):
        writer(updates(spark, batches[k]), k)
    writer(updates(spark, batches[3]), 3)  # offered again
    assert len(log.numbers()) == 1 and answer(spark, log.index(), points) == plain_matrix(states, points)
    go.set()
    writer.close()
    assert [log.manifest(n)["epoch"] for n in log.numbers()] == [-1, 0, 3]
    assert answer(spark, log.index(), points) == plain_matrix(after(states, batches[:4]), points)
    left = versions.AsyncWriter.__new__(versions.AsyncWriter)  # one that took an offer and stopped
    left.log, left._change, left.error = log, threading.Condition(), None
    left(updates(spark, batches[4]), 4)
    versions.AsyncWriter(log).close()
    assert answer(spark, log.index(), points) == plain_matrix(after(states, batches), points)


def test_pairs_of_two_streams(spark, tmp_path):
    """A half that comes too late, or in time but a batch later; state does not keep what can't be paired any more."""
    ddl = "job_id long, us double, at long"
    def put(name, rows):
        spark.createDataFrame(rows, ddl).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    put("a", [(1, 2.0, 100), (2, 0.0, 100), (3, 5.0, 100)])
    put("b", [(1, 4.0, 130), (9, 1.0, 99)])
    read = lambda name: spark.readStream.schema("job_id long, us double, at timestamp").parquet(f"{tmp_path}/{name}")
    stream = mission.paired_stream(read("a"), read("b")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").start(f"{tmp_path}/out")
    stream.processAllAvailable()
    put("b", [(2, 3.0, 160), (3, 7.0, 161)])
    stream.processAllAvailable()
    put("a", [(50, 1.0, 100_000)])
    put("b", [(50, 1.0, 100_001)])
    stream.processAllAvailable()
    stream.processAllAvailable()
    state = stream.lastProgress.stateOperators[0].numRowsTotal
    stream.stop()
    got = sorted((x["job_id"], x["speedup"]) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 2.0), (2, None), (50, 1.0)] and state <= 2


def test_a_silent_goal_expires(spark, tmp_path):
    ddl = "robot_id int, tick long, goal string"
    put = lambda rows: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, 0, "a"), (2, 0, "x"), (1, 3, "a"), (2, 5, "y"), (3, 1, "q"), (3, 40, "r")])
    stream = timers.expiries(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), kept=10, late=2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").start(f"{tmp_path}/out")
    stream.processAllAvailable()
    read = lambda: sorted(map(tuple, spark.read.schema(timers.OUTPUT).parquet(f"{tmp_path}/out").collect()))
    assert read() == [(1, "a", 0, 10), (2, "y", 5, 15), (3, "q", 1, 11)]
    put([(1, 45, "a"), (1, 60, None)])  # the same goal again is not a new one; robot 3 says nothing
    stream.processAllAvailable()
    stream.stop()
    assert read() == [(1, "a", 0, 10), (2, "y", 5, 15), (3, "q", 1, 11), (3, "r", 40, 50)]


def test_state_is_read_and_written_once_a_batch():
    """However many rows a robot has in it: every call is a message to the JVM."""
    import pandas as pd

    calls = []

    class State:
        value = None
        exists = lambda self: calls.append("exists") or self.value is not None
        get = lambda self: calls.append("get") or self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        getValueState = lambda self, *_: State()
        listTimers = lambda self: iter([])
        registerTimer = lambda self, at: calls.append(at)

    expiry = timers.Expiry(10)
    expiry.init(Handle())
    rows = pd.DataFrame({"tick": range(300), "goal": [str(t // 30) for t in range(300)]})
    (out,) = expiry.handleInputRows((7,), iter([rows[:200], rows[200:]]), None)
    assert [tuple(x) for x in out.itertuples(index=False)] == [(7, str(k), 30 * k, 30 * k + 10) for k in range(10)]
    assert calls == ["exists", "update"]  # the last goal has run out too, so there is no timer
