"""Queries of fleet plans, stale caches and the exploration stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import cache, fleet, search, tiles
from cellweave.operators import query as lifted
from cellweave.operators.neighbourhood import update_cells
from cellweave.plans.distances import K, _matrix, _points, _vp
from cellweave.plans.registry import query
from cellweave.plans.scalars import UPDATED, cells, updates
from cellweave.session import shared_dir
from cellweave.sources import derived
from cellweave.sources.sql import CELLS, EXPLORED, FOUR, distances, viewpoints
from cellweave.streaming import mission, recovery, timers, versions

ROBOTS = 4


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The viewpoints as a plan: the first are robots, the rest targets."""
    own, points = _points(spark, sf_dir)
    dist = search.matrix(own, points).select(F.lit("p").alias("plan_id"), "i", "j", "d")
    kind = F.when(F.col("i") < ROBOTS, "robot").otherwise("target")
    idx = F.when(F.col("i") < ROBOTS, F.col("i")).otherwise(F.col("i") - ROBOTS)
    return points.select(F.lit("p").alias("plan_id"), kind.alias("kind"), idx.alias("idx"), "r", "c"), dist


@query()
def fleet_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fleet.plan_fleet(*_plan(spark, sf_dir))
    return out.select("robot_id", F.posexplode_outer("waypoints").alias("ord", "w"), "cost").select("robot_id", "ord", "w.target", "w.r", "w.c", "cost")


@query(f"""with recursive {CELLS}, {_vp()}, {FOUR}, {distances("cells", "vp", False)}, m as (select a.i, b.i as j, coalesce(d, 60000) as d from vp a cross join vp b left join dist on dist.s = a.i and dist.r = b.r and dist.c = b.c),
  leg as (select i % {ROBOTS} as robot, i as j, lag(i) over (partition by i % {ROBOTS} order by i) as i from vp)
  select cast(robot as int) as robot_id, cast(coalesce(sum(case when d < 60000 then d end), 0) as bigint) as cost from leg left join m using (i, j) group by 1""")
def tour_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of given tours: each robot visits every fourth viewpoint in order."""
    own, points = _points(spark, sf_dir)
    dist = search.matrix(own, points).select(F.lit("p").alias("plan_id"), "i", "j", "d")
    stops = points.select(F.lit("p").alias("plan_id"), (F.col("i") % ROBOTS).cast("int").alias("robot_id"), F.col("i").alias("ord"), F.col("i").alias("point"))
    return fleet.tour_cost(stops, dist).select("robot_id", "cost")


_REACH = f"""{_vp()}, {FOUR}, {{dist}},
  met as (select rb.i as robot_id, t.i, t.r, t.c, exists (select 1 from vp o where o.i < {ROBOTS} and o.i <> rb.i and abs(t.r - (o.r + 5)) <= 6 and abs(t.c - (o.c + 5)) <= 6) as shared, (t.r - rb.r) * (t.r - rb.r) + (t.c - rb.c) * (t.c - rb.c) as d2
    from vp rb join vp t on rb.i < {ROBOTS} and t.i >= {ROBOTS} join dist on dist.s = rb.i and dist.r = t.r and dist.c = t.c)"""


@query(f"""with recursive {CELLS}, {_REACH.format(dist=distances("cells", "vp", False))}
  select robot_id, i, r, c from (select *, row_number() over (partition by robot_id order by shared, d2, i) as n from met) where n = 1""")
def fallback_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots whose goals are 5 cells on: the viewpoint that each falls back to."""
    own, points = _points(spark, sf_dir)
    robots = points.where(F.col("i") < ROBOTS).select("map_id", F.col("i").alias("robot_id"), "r", "c", (F.col("r") + 5).alias("goal_r"), (F.col("c") + 5).alias("goal_c"))
    return fleet.fallback_goals(robots, points.where(F.col("i") >= ROBOTS), own).select("robot_id", "i", "r", "c")


@query(f"""with {CELLS}, f as (select r, c, (r * 4 // rows) * 4 + c * 4 // cols as sector, ((r * 100003 + c)::bigint * 7919) % 1000003 as h from cells where observed = 1),
  t as (select *, row_number() over (partition by sector order by h, r, c) as turn from f)
  select cast(row_number() over (order by turn, sector) - 1 as int) as i, r, c from t qualify i < 40""")
def patrol_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.patrol_targets(cells(spark, sf_dir), 40).select("i", "r", "c")


_TARGETS = """f as (select r, c, (r * 4 // rows) * 4 + c * 4 // cols as sector, ((r * 100003 + c)::bigint * 7919) % 1000003 as h from cells where observed = 1),
  t as (select *, row_number() over (partition by sector order by h, r, c) as turn from f),
  target as (select cast(row_number() over (order by turn, sector) - 1 as int) as i, r, c from t qualify i < 40)"""


@query(f"""with {CELLS}, {_TARGETS}, {viewpoints("cells", 60)} select i, r, c from target where not exists (select 1 from vp where (vp.r - target.r) * (vp.r - target.r) + (vp.c - target.c) * (vp.c - target.c) <= 36)""")
def targets_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patrol targets that 60 robots have not come near."""
    own = cells(spark, sf_dir)
    return fleet.unvisited(fleet.patrol_targets(own, 40), derived.viewpoints(own, 60)).select("i", "r", "c")


@query()
def replenished_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    left = fleet.unvisited(fleet.patrol_targets(own, 10), derived.viewpoints(own, 60))
    return fleet.replenished(left, own, 20).select("i", "r", "c")


@query()
def recovery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks of their users."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = e.select(F.col("user_id").cast("int").alias("robot_id"), F.col("event_id").alias("tick"), F.floor(F.col("value") / 60).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("commanded"), F.lit(False).alias("rotating"), F.lit(True).alias("has_goal"), (F.col("value") % 1).alias("rear_m"))
    return recovery.recovery(ticks)


@query("""with rb as (select cast(event_id as int) as robot_id, case when event_id % 3 > 0 then cast(event_id % 90 as int) end as goal_r, event_id % 5 as persistence, event_id % 11 as stuck, event_id % 13 = 0 as explored, event_id % 7 = 0 as near from events)
  select robot_id, coalesce(goal_r is not null and not explored and (near or persistence > 0) and stuck < 8, false) as kept from rb""")
def adopted_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    goal = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 90).cast("int"))
    robots = e.select(F.lit("m").alias("map_id"), F.col("event_id").cast("int").alias("robot_id"), goal.alias("goal_r"), goal.alias("goal_c"), (F.col("event_id") % 5).alias("persistence"), (F.col("event_id") % 11).alias("stuck"), (F.col("event_id") % 13 == 0).alias("explored"))
    tours = e.where("event_id % 2 = 0").select(F.lit("m").alias("map_id"), F.col("event_id").cast("int").alias("robot_id"), F.array(F.struct(F.lit(1).alias("r"), F.lit(2).alias("c"))).alias("waypoints"))
    near = e.where("event_id % 7 = 0").select(F.lit("m").alias("map_id"), F.col("event_id").cast("int").alias("robot_id"))
    return fleet.adopt(robots, tours, near).select("robot_id", "kept")


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cache after all updates, refreshed around cell (40, 40), and the true matrix."""
    own, points = _points(spark, sf_dir)
    after = update_cells(own, updates(spark, sf_dir))
    return cache.refresh(cache.build(own, points), after, points, (40, 40)), search.matrix(after, points)


_CACHED = f"""{UPDATED}, {_vp()}, {FOUR}, {distances("cells", "vp", False)},
  was as (select a.i, b.i as j, coalesce(d, 60000) as d from vp a cross join vp b left join dist on dist.s = a.i and dist.r = b.r and dist.c = b.c),
  {distances("updated", "vp", False).replace("free as", "free2 as").replace("free f", "free2 f").replace("free n", "free2 n").replace("edge", "edge2").replace("dist", "dist2")},
  truth as (select a.i, b.i as j, coalesce(d, 60000) as d from vp a cross join vp b left join dist2 on dist2.s = a.i and dist2.r = b.r and dist2.c = b.c),
  moved as (select i from vp where abs(r - 40) <= 12 and abs(c - 40) <= 12),
  cached as (select i, j, case when i in (from moved) or j in (from moved) then truth.d else was.d end as d from was join truth using (i, j))"""


@query(_matrix(False))
def cache_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.build(*_points(spark, sf_dir)).select("i", "j", "d")


@query(f"with recursive {_CACHED} select i, j, cast(d as int) as d, (i in (from moved) or j in (from moved)) as fresh from cached")
def cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[0].select("i", "j", "d", "fresh")


@query(f"with recursive {_CACHED} select cast(a.x as int) as i, cast(b.x as int) as j, cast(coalesce(d, 60000) as int) as d from range({K + 4}) a(x) cross join range({K + 4}) b(x) left join cached on i = a.x and j = b.x")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: spark.range(K + 4).select(F.col("id").cast("int").alias(name))
    wanted = one("i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(K + 3)))).withColumn("map_id", F.lit("events"))
    return cache.lookup(_refreshed(spark, sf_dir)[0], wanted).select("i", "j", "d")


@query(f"""with recursive {_CACHED}, p as (select cached.d as d, truth.d as gt from cached join truth using (i, j) where i <> j)
  select count(*) as total_pairs, count(*) filter (d > gt and gt < 60000) as stale_pairs, round(count(*) filter (d > gt and gt < 60000) / count(*), 9) as stale_pair_fraction,
    cast(coalesce(max(d - gt) filter (d > gt and gt < 60000), 0) as int) as max_absolute_error, round(coalesce(max((d - gt) / gt) filter (d > gt and gt < 60000 and gt > 0), 0), 9) as max_relative_error,
    round(coalesce(sum((d - gt) / gt) filter (d > gt and gt < 60000 and gt > 0), 0) / count(*), 9) as mean_relative_error from p""")
def cache_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cache.staleness(*_refreshed(spark, sf_dir)).drop("map_id")
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"""with recursive {CELLS}, {viewpoints("cells", 20)}, ray(dr, dc, k) as (values (0, 1, 0), (1, 0, 1), (0, -1, 2), (-1, 0, 3)), step as (select x + 1 as s from range(20) a(x)),
  way as (select i, k, s, cast(greatest(0, least(rows - 1, floor(r + 0.5 + dr * s * 0.5 + case when dr = 0 then 0 else 0.001 end))) as int) as r, cast(greatest(0, least(cols - 1, floor(c + 0.5 + dc * s * 0.5 + case when dc = 0 then 0 else 0.001 end))) as int) as c from vp, ray, step, (select any_value(rows) as rows, any_value(cols) as cols from cells)),
  ends as (select i, k, min(s) filter (gt = 2) as s from way join cells using (r, c) group by all)
  select i as robot_id, cast(k as int) as ray, s is not null as hit, case when s is null then 1.0 else s * 0.05 end as distance from ends""")
def scan_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rays from 20 poses, just off the middle of their cells so that no sample lies on an edge."""
    own = cells(spark, sf_dir)
    poses = derived.viewpoints(own, 20).select("map_id", F.col("i").alias("robot_id"), ((F.col("c") + 0.501) * 0.1).alias("x"), ((F.col("r") + 0.501) * 0.1).alias("y"), F.lit(0.0).alias("theta"))
    hits, _ = mission.scan(poses, own, mission.Scanner(1.0, 360.0, 4), 0.1)
    return hits.select("robot_id", "ray", "hit", F.round("distance", 9).alias("distance"))


@query(f"""with {EXPLORED}, {viewpoints("cells", 20)}, size as (select any_value(rows) as rows, any_value(cols) as cols from cells), turn as (select k, radians(k * 6.0::double) as a from range(60) x(k)), step as (select s from range(1, 21) x(s)),
  way as (select i, k, s, cast(greatest(0, least(rows - 1, floor(((r + 0.501::double) * 0.1::double + s * 0.5::double * 0.1::double * sin(a)) / 0.1::double))) as int) as r, cast(greatest(0, least(cols - 1, floor(((c + 0.501::double) * 0.1::double + s * 0.5::double * 0.1::double * cos(a)) / 0.1::double))) as int) as c from vp, turn, step, size),
  met as (select way.*, gt, min(case when gt = 2 then s end) over (partition by i, k) as stop from way join cells using (r, c)),
  seen as (select distinct r, c, gt from met where stop is null or s <= stop)
  select seen.r, seen.c, case when seen.gt = 2 then 'block' else 'open' end as op from seen join cells using (r, c) where observed = 0""")
def scan_reveals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.explored_cells(spark, sf_dir)
    poses = derived.viewpoints(own, 20).select("map_id", F.col("i").alias("robot_id"), ((F.col("c") + 0.501) * 0.1).alias("x"), ((F.col("r") + 0.501) * 0.1).alias("y"), F.lit(0.0).alias("theta"))
    _, seen = mission.scan(poses, own, mission.Scanner(1.0, 360.0, 60), 0.1)
    return mission.reveals(seen, own, 0).select("r", "c", "op")


@query(f"with {UPDATED} select distinct cast(r // 8 as int) as tx, cast(c // 8 as int) as ty from u")
def touched_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mission.touched_tiles(updates(spark, sf_dir), 8).select("tx", "ty")


@query("""with a as (select event_id as job_id, value as us from events where event_id % 2 = 0), b as (select event_id as job_id, value * 3 + 1 as us from events where event_id % 3 = 0)
  select job_id, a.us as index_us, b.us as search_us, round(case when a.us > 0 then b.us / a.us end, 9) as speedup from a join b using (job_id)""")
def paired_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("job_id"), F.col("value").alias("us"))
    out = mission.paired_latencies(e.where("job_id % 2 = 0"), e.where("job_id % 3 = 0").withColumn("us", F.col("us") * 3 + 1))
    return out.withColumn("speedup", F.round("speedup", 9))


@query("""with a as (select event_id as job_id, value as us, ts as at from events where event_id % 2 = 0), b as (select event_id as job_id, value * 3 + 1 as us, ts + interval 1 second * (event_id % 90) as at from events where event_id % 3 = 0)
  select job_id, a.us as index_us, b.us as search_us, round(case when a.us > 0 then b.us / a.us end, 9) as speedup from a join b using (job_id) where b.at between a.at and a.at + interval 60 second""")
def paired_latency_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of measurements, of which the second comes up to 89 seconds later: pairs within a minute, by a join whose
    state is dropped as the watermarks pass."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder, out = shared_dir(spark, "measured"), shared_dir(spark, "pairs")
    own = e.where("event_id % 2 = 0").select(F.col("event_id").alias("job_id"), F.col("value").alias("us"), F.col("ts").cast("timestamp").alias("at"))
    base = e.where("event_id % 3 = 0").select(F.col("event_id").alias("job_id"), (F.col("value") * 3 + 1).alias("us"), (F.col("ts").cast("timestamp") + F.make_interval(secs=F.col("event_id") % 90)).alias("at"))
    for name, table in (("own", own), ("base", base)):
        table.repartitionByRange(4, "at").sortWithinPartitions("at").write.parquet(f"{folder}/{name}")
    read = lambda name: spark.readStream.schema("job_id long, us double, at timestamp").parquet(f"{folder}/{name}")
    stream = mission.paired_stream(read("own"), read("base")).writeStream.format("parquet").option("checkpointLocation", shared_dir(spark, "stream")).outputMode("append").start(out)
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(out).select("job_id", "index_us", "search_us", F.round("speedup", 9).alias("speedup"))


@query("""with t as (select event_id // 100 as tick, count(*) as n from events group by 1), a as (select tick, tick - tick % 4 as upto from t)
  select a.tick, cast(coalesce(sum(t.n), 0) as bigint) as pending, any_value(a.tick - a.upto) as lag from a left join t on t.tick <= a.tick and t.tick > a.upto group by a.tick""")
def lag_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    offered = e.groupBy(F.expr("event_id div 100").alias("tick")).agg(F.count("*").alias("n"))
    applied = offered.select("tick", (F.col("tick") - F.col("tick") % 4).alias("upto"))
    return mission.lag_gauges(offered, applied)


@query(_matrix(True, UPDATED, "updated"))
def streamed_index_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates as a stream of files, each batch a version in a log; the writer is stopped between them, and another goes on."""
    own, points = _points(spark, sf_dir)
    folder, checkpoint = shared_dir(spark, "updates"), shared_dir(spark, "stream")
    log = versions.VersionLog(spark, shared_dir(spark, "versions"))
    batch = updates(spark, sf_dir)
    half = batch.agg(F.max("seq")).first()[0] // 2
    for part in (batch.where(F.col("seq") <= half), batch.where(F.col("seq") > half)):
        part.write.mode("append").parquet(folder)
        start = tiles.Index.build(own, tiles.Config(b=16)) if log.manifest() is None else None
        stream = versions.LoggedWriter(log, start).follow(mission.update_stream(spark, folder, 1000), checkpoint)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
    return lifted.matrix(log.index(), points.withColumn("query_id", F.lit("q"))).select("i", "j", "d")


@query(_matrix(True, UPDATED, "updated"))
def queued_index_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches offered to a writer that applies them on a thread of its own; what waits goes into one version."""
    own, points = _points(spark, sf_dir)
    log = versions.VersionLog(spark, shared_dir(spark, "versions"))
    writer = versions.AsyncWriter(log, tiles.Index.build(own, tiles.Config(b=16)))
    batch = updates(spark, sf_dir)
    last = batch.agg(F.max("seq")).first()[0] + 1
    for epoch in range(3):
        writer(batch.where(F.floor(F.col("seq") * 3 / last) == epoch), epoch)
    writer.close()
    return lifted.matrix(log.index(), points.withColumn("query_id", F.lit("q"))).select("i", "j", "d")


@query("""with e as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as was from events),
  g as (select *, max(case when was is null or was <> event_type then event_id end) over (partition by user_id order by event_id rows unbounded preceding) as since from e)
  select cast(user_id as int) as robot_id, event_id as tick, cast(greatest(0, 50 - (event_id - since)) as int) as left from g""".replace("as left", 'as "left"'))
def goal_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as goals of users: how long each is still kept, by a stateful stream."""
    folder = shared_dir(spark, "goals")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.select(F.col("user_id").cast("int").alias("robot_id"), F.col("event_id").alias("tick"), F.col("event_type").alias("goal")).coalesce(1).write.parquet(folder)
    goals = spark.readStream.schema("robot_id int, tick long, goal string").parquet(folder)
    out = shared_dir(spark, "kept")
    stream = mission.goal_persistence(goals).writeStream.format("parquet").option("checkpointLocation", shared_dir(spark, "stream")).outputMode("append").start(out)
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(out)


@query("""with e as (select cast(user_id as int) as robot_id, event_id as tick, event_type as goal, lag(event_type) over (partition by user_id order by event_id) as was, lead(event_id) over (partition by user_id order by event_id) as next from events),
  g as (select *, count(*) filter (was is null or was <> goal) over (partition by robot_id order by tick rows unbounded preceding) as run from e),
  r as (select robot_id, any_value(goal) as goal, min(tick) as since, max(tick) as seen from g group by robot_id, run), n as (select *, lead(since) over (partition by robot_id order by since) as dropped from r),
  now as (select max(tick) as t from e)
  select robot_id, goal, since, since + 50 as until from n, now where since + 50 <= coalesce(dropped - 1, t)""")
def expired_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as goals of users: those that run out before another is chosen, told by timers, without a new row of theirs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    goals = e.select(F.col("user_id").cast("int").alias("robot_id"), F.col("event_id").alias("tick"), F.col("event_type").alias("goal"))
    folder, out = shared_dir(spark, "goals"), shared_dir(spark, "expired")
    goals.repartitionByRange(4, "tick").sortWithinPartitions("tick").write.parquet(folder)
    last = goals.agg(F.max("tick")).first()[0]
    stream = timers.expiries(spark.readStream.schema(goals.schema).parquet(folder)).writeStream.format("parquet").option("checkpointLocation", shared_dir(spark, "stream")).outputMode("append").start(out)
    try:
        stream.processAllAvailable()
        goals.limit(1).select(F.lit(-1).alias("robot_id"), F.lit(last + timers.LATE).cast("long").alias("tick"), F.lit(None).cast("string").alias("goal")).write.mode("append").parquet(folder)  # the clock goes on
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(out)
