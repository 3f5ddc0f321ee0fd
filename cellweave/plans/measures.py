"""Queries of statistics, telemetry and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import raster, search, stats, tiles
from cellweave.plans.distances import _matrix, _points
from cellweave.plans.registry import query
from cellweave.plans.scalars import UPDATED, cells, updates
from cellweave.operators.neighbourhood import update_cells
from cellweave.session import shared_dir
from cellweave.sources import maps, records
from cellweave.sources.sql import CELLS


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""select event_type, count(value) as n, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean,
  round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3 from events group by 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summary(events(spark, sf_dir), "value", "event_type"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def median_and_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.median_p95(events(spark, sf_dir), "value", "event_type"))


@query("select event_type, list_sort(list(value))[count(*) // 2 + 1] as upper_median from events group by 1")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.upper_median(events(spark, sf_dir), "value", "event_type")


_BOTH = f"""a as ({_matrix(False)}), b as ({_matrix(False, UPDATED, "updated")})"""


@query(f"""with {_BOTH} select count(*) as entries, count(*) filter (a.d <> b.d) as mismatches, cast(max(abs(a.d - b.d)) filter (a.d <> b.d) as int) as max_abs_diff,
  cast(greatest(max(a.d) filter (a.d < 60000), max(b.d) filter (b.d < 60000)) as int) as max_finite from a join b using (i, j)""")
def matrix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices before and after the updates."""
    own, points = _points(spark, sf_dir)
    return stats.compare_matrices(search.matrix(own, points), search.matrix(update_cells(own, updates(spark, sf_dir)), points), none=None)


@query(f"with {CELLS} select count(*) filter (gt = 1) as free, count(*) filter (gt = 1 and observed = 1) as explored, count(*) filter (gt = 1 and observed = 1) / count(*) filter (gt = 1) as fraction from cells")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage(cells(spark, sf_dir)).drop("map_id")


@query("""select event_type, count(*) as pairs, round(avg(value * 3 + user_id % 5), 6) as mean_base, round(avg(value), 6) as mean_ours, round(avg(case when value > 0 then (value * 3 + user_id % 5) / value end), 6) as mean_speedup,
  round(max(case when value > 0 then (value * 3 + user_id % 5) / value end), 6) as max_speedup from events group by 1""")
def speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_type", F.col("value").alias("ours"), (F.col("value") * 3 + F.col("user_id") % 5).alias("base"))
    return rounded(stats.speedups(e, "base", "ours", "event_type"))


@query("""with recursive s as (select user_id, value, row_number() over (partition by user_id order by event_id) as n from events),
  f(user_id, n, ema) as (select user_id, n, value from s where n = 1 union all select s.user_id, s.n, 0.85 * f.ema + 0.15 * s.value from f join s on s.user_id = f.user_id and s.n = f.n + 1)
  select user_id, round(max_by(ema, n), 6) as ema from f group by 1""")
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.moving_average(events(spark, sf_dir), "user_id", "event_id", "value"))


@query("select event_id, round(value * pow(0.96, greatest(0, event_id % 90 - 40)), 6) as rate from events")
def idle_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(stats.idle_decay(F.col("value"), F.col("event_id") % 90), 6).alias("rate"))


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positions of their users."""
    return events(spark, sf_dir).select("user_id", "event_id", (F.col("value") % 2).alias("x"), (F.floor(F.col("value") / 10) % 2).cast("double").alias("y"))


@query("""with t as (select user_id, event_id, value % 2 as x, floor(value / 10) % 2 as y from events),
  s as (select user_id, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from t window w as (partition by user_id order by event_id))
  select user_id, round(coalesce(sum(step) filter (step < 1.5), 0), 6) as distance from s group by 1""")
def distance_travelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.distance_travelled(_track(spark, sf_dir), "user_id", "event_id"))


@query("""with t as (select user_id, event_id, floor(value / 40) as x, 0.0 as y from events), s as (select *, coalesce(abs(x - lag(x) over (partition by user_id order by event_id)) < 0.001, false) as still from t),
  g as (select *, sum(case when still then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as run from s)
  select user_id, min(event_id) as first, max(event_id) as last, count(*) as ticks from g group by user_id, run having count(*) >= 3""")
def stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = events(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("value") / 40).cast("double").alias("x"), F.lit(0.0).alias("y"))
    return stats.stuck_runs(track, "user_id", "event_id", 3)


@query("select event_type, quantile_cont(user_id % 9, 0.95) as p95, cast(max(user_id % 9) as bigint) as max, round(avg(case when user_id % 9 > 0 then 1.0 else 0.0 end), 6) as busy from events group by 1")
def lag_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.lag_profile(events(spark, sf_dir).withColumn("lag", F.col("user_id") % 9), "lag", "event_type"))


@query("""with b as (select event_type as map_id, sum(value) as build_ms, cast(count(*) * 1000 as bigint) as index_bytes from events group by 1), q as (select event_type as map_id, max(value) as search_ms, median(value) as index_ms from events group by 1)
  select map_id, cast(case when search_ms > index_ms then ceil(build_ms / (search_ms - index_ms)) end as bigint) as break_even, round(index_bytes / 1048576, 6) as index_mib, round(search_ms / index_ms, 6) as speedup from b join q using (map_id)""")
def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("event_type", "map_id")
    build = e.groupBy("map_id").agg(F.sum("value").alias("build_ms"), (F.count("*") * 1000).alias("index_bytes"))
    return rounded(stats.break_even(build, e.groupBy("map_id").agg(F.max("value").alias("search_ms"), F.percentile("value", 0.5).alias("index_ms"))))


@query("""with p as (select event_id, cast(user_id % 4 as int) as lvl, row_number() over (partition by user_id % 4 order by event_id) as n, count(*) over (partition by user_id % 4) as size from events),
  s as (select lvl, any_value(size) as size from p group by 1), t as (select lvl, case lvl when 0 then least(size, 4) when 1 then least(size, 5) when 2 then least(size, 5) else least(size, 6) end as take from s)
  select event_id, lvl from p join t using (lvl) where n <= take""")
def stratified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir).select("event_id", (F.col("user_id") % 4).cast("int").alias("lvl"))
    return stats.stratified_pairs(p, "lvl", (4, 9, 14, 20), "event_id")


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: a session for each type, a tick for each event."""
    e = events(spark, sf_dir)
    return e.select(F.col("event_type").alias("session"), F.col("event_id").alias("tick"), (F.col("event_id") / 1000).alias("coverage_pct"), (F.col("user_id") % 12).cast("int").alias("newly_opened_cells"), (F.col("user_id") % 30).cast("int").alias("active_frontiers"), (F.col("value") * 2).alias("index_update_us"), F.col("value").alias("index_query_us"))


@query("""select event_type as session, count(*) as ticks, max(event_id) as last_tick, max_by(event_id / 1000, event_id) as final_coverage_pct, cast(sum(user_id % 12) as bigint) as opened,
  round(quantile_cont(value, 0.5), 6) as query_median_us, round(quantile_cont(value, 0.95), 6) as query_p95_us, round(quantile_cont(value * 2, 0.5), 6) as update_median_us, round(quantile_cont(value * 2, 0.95), 6) as update_p95_us from events group by 1""")
def mission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.mission_summary(_telemetry(spark, sf_dir)))


@query("select event_id as tick, round(event_id / 1000 / 100, 9) as explored_fraction, cast(user_id % 30 as int) as frontiers_k, value * 2 as update_us, value as query_us from events")
def per_step_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.per_step(_telemetry(spark, sf_dir)), 9)


@query(f"""with {CELLS}, t as (select event_type as session, event_id as tick, user_id, value from events), w as (select session, user_id % 8 as robot, max_by(value * 2, tick) as m from t group by all), f as (select session, count(*) as robots, sum(m) as way from w group by 1),
  g as (select any_value(rows) as rows, any_value(cols) as cols, count(*) filter (gt = 1) as free, count(*) filter (gt = 1 and observed = 1) as seen from cells),
  h as (select cast(ceil(log2(greatest(rows, cols) / 8.0)) as int) + 1 as depth, cast(ceil(rows / 8) * ceil(cols / 8) as int) as leaves from g),
  c as (select session, count(*) as n, avg(value) as ours, avg(value * 3 + 1) as base, avg(case when value > 0 then (value * 3 + 1) / value end) as up from t where user_id % 2 = 0 group by 1)
  select session, max(tick) as total_ticks, round(max(tick) * 0.05, 6) as total_sim_time_s, count(*) as logged_steps, any_value(g.rows) as grid_rows, any_value(g.cols) as grid_cols, any_value(free) as total_free_cells, any_value(seen) as explored_free_cells,
    round(max_by(tick / 1000, tick), 6) as final_coverage_pct, any_value(depth) as tree_depth, any_value(leaves) as total_leaves, any_value(f.robots) as robot_count, cast(max(user_id % 4) as int) as total_respawns, round(any_value(way), 6) as total_fleet_distance_m,
    round(avg(value), 6) as query_mean_us, round(quantile_cont(value * 2, 0.95), 6) as update_p95_us, cast(max(user_id % 9) as bigint) as replica_lag_max_ticks, round(avg(case when user_id % 9 > 0 then 1.0 else 0.0 end), 6) as replica_lag_busy_frac,
    any_value(c.n) as compare_count, round(any_value(c.ours), 6) as paired_query_mean_us, round(any_value(c.base), 6) as bfs_query_mean_us, round(any_value(c.up), 6) as mean_speedup_vs_bfs
  from t join f using (session) join c using (session), g, h group by session""")
def mission_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each session, its parts side by side; settings and per-robot lists are left to the JSON form."""
    e = events(spark, sf_dir)
    telemetry = _telemetry(spark, sf_dir).join(e.select(F.col("event_id").alias("tick"), "user_id"), "tick")
    telemetry = telemetry.select("*", (F.col("tick") * 0.05).alias("sim_time_s"), (F.col("tick") * 0.05).alias("wall_time_s"), (F.col("user_id") % 4).cast("int").alias("total_respawns"), (F.col("user_id") % 9).cast("long").alias("replica_lag_ticks"))
    own = e.select(F.col("event_type").alias("session"), F.col("event_id").alias("tick"), (F.col("user_id") % 8).cast("int").alias("robot_id"), (F.col("value") * 2).alias("distance_traveled_m"), "user_id", F.col("value").alias("index_query_us"), (F.col("value") * 3 + 1).alias("bfs_query_us"))
    compared = own.where("user_id % 2 = 0").withColumn("speedup", F.when(F.col("index_query_us") > 0, F.col("bfs_query_us") / F.col("index_query_us")))
    out = records.mission_report(telemetry, own, compared, cells(spark, sf_dir), tiles.Config(b=8), {"seed": 42})
    wanted = {"mission_metadata": ("total_ticks", "total_sim_time_s", "logged_steps"), "environment": ("grid_rows", "grid_cols", "total_free_cells", "explored_free_cells", "final_coverage_pct"), "hierarchy": ("tree_depth", "total_leaves"), "fleet": ("robot_count", "total_respawns", "total_fleet_distance_m"), "performance_metrics": ("query_mean_us", "update_p95_us", "replica_lag_max_ticks", "replica_lag_busy_frac", "compare_count", "paired_query_mean_us", "bfs_query_mean_us", "mean_speedup_vs_bfs")}
    return rounded(out.select("session", *[f"{part}.{c}" for part, names in wanted.items() for c in names]))


@query(f"with {CELLS}, two as (select 'events' as map_id, weight from cells union all select 'blank', 1 from cells) select map_id, bool_or(weight <> 1) as has_weights from two group by 1")
def weight_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    return maps.has_weights(own.unionByName(own.withColumn("map_id", F.lit("blank")).withColumn("weight", F.lit(1))))


@query("select cast(b as int) as b, cast(g as int) as g, b >= 2 and g between 2 and 16 as valid, b >= 2 and g = 2 as quadtree from range(0, 40) x(b), range(0, 20) y(g)")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tile and group sides an index takes (a tile side of 1 is refused), and which of them make a quadtree."""
    rows = []
    for b in range(40):
        for g in range(20):
            try:
                config = tiles.Config(b=b, g=g)
                rows.append((b, g, True, config.g == 2))
            except ValueError:
                rows.append((b, g, False, False))
    return spark.createDataFrame(rows, "b int, g int, valid boolean, quadtree boolean")


@query("select * from (values ('running', 8, 2, null), ('complete', 8, 2, 95)) t(status, b, g, coverage)")
def trial_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial's manifest as it starts and as it ends, read back."""
    config = {"b": 8, "g": 2}
    rows = [(records.manifest(config, "running"),), (records.manifest(config, "complete", {"coverage": 95}),)]
    at = lambda path: F.get_json_object("value", path)
    return spark.createDataFrame(rows, "value string").select(at("$.status").alias("status"), *[at(f"$.config.{k}").cast("int").alias(k) for k in config], at("$.outcome.coverage").cast("int").alias("coverage"))


@query()
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.file_hashes(spark, f"{sf_dir}/region.parquet").select("length", "sha256")


@query()
def weighted_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.weighted_rooms(spark, 64, 64).select("r", "c", "gt", "weight")


@query()
def mission_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.summary_json(records.mission_summary(_telemetry(spark, sf_dir)), {"engine": "cellweave"})


@query("""with l as (select event_type as log, event_id as n, case event_id % 6 when 0 then '=== suite ' || (event_id // 60) || ' ===' when 1 then 'Queries: ' || user_id || ', Matches: ' || (user_id - user_id % 2) when 2 then 'MaxDiff: ' || (user_id % 17) when 3 then 'verifications=' || (user_id % 50) || ', openings=3' else 'note ' || event_id end as line from events),
  m as (select log, n, line, last_value(case when line like '=== %' then regexp_extract(line, '^=== (.*) ===$', 1) end ignore nulls) over (partition by log order by n rows unbounded preceding) as suite from l),
  x as (select log, suite, try_cast(regexp_extract(line, 'Queries: (\\d+)', 1) as bigint) as q, try_cast(regexp_extract(line, 'Matches: (\\d+)', 1) as bigint) as m, try_cast(regexp_extract(line, 'MaxDiff: (\\d+)', 1) as bigint) as d, try_cast(regexp_extract(line, 'verifications=(\\d+)', 1) as bigint) as v from m where suite is not null)
  select log, suite, cast(coalesce(sum(coalesce(q, v)), 0) as bigint) as entries, cast(coalesce(sum(coalesce(m, v)), 0) as bigint) as matches, coalesce(max(d), 0) as max_diff from x group by 1, 2""")
def scraped_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    kinds = [
        text("=== suite ", F.expr("cast(event_id div 60 as string)"), " ==="),
        text("Queries: ", user.cast("string"), ", Matches: ", (user - user % 2).cast("string")),
        text("MaxDiff: ", (user % 17).cast("string")),
        text("verifications=", (user % 50).cast("string"), ", openings=3"),
    ]
    line = text("note ", F.col("event_id").cast("string"))
    for k, x in enumerate(kinds):
        line = F.when(F.col("event_id") % 6 == k, x).otherwise(line)
    return records.scrape_logs(events(spark, sf_dir).select(F.col("event_type").alias("log"), F.col("event_id").alias("n"), line.alias("line")))


@query(f"""with recursive {CELLS}, four(dr, dc) as (values (-1, 0), (1, 0), (0, -1), (0, 1)), truly as (select r, c from cells where gt = 1),
  link as (select a.r * 100 + a.c as a, b.r * 100 + b.c as b from truly a, four, truly b where b.r = a.r + dr and b.c = a.c + dc),
  label(p, l) using key (p) as (select r * 100 + c, r * 100 + c from truly union
    select q.p, q.l from (select link.b as p, min(label.l) as l from label join link on link.a = label.p group by all) q join recurring.label old on old.p = q.p where q.l < old.l)
  select 'events' as map_id, any_value(rows) as rows, any_value(cols) as cols, count(*) filter (gt = 1) as passable, (select max(n) from (select count(*) as n from label group by l)) as largest from cells""")
def map_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    size = raster.largest_component(own).groupBy("map_id").agg(F.first("size").alias("largest"))
    base = own.groupBy("map_id").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.count_if(F.col("gt") == 1).alias("passable"))
    return base.join(size, "map_id").select("map_id", "rows", "cols", "passable", "largest")


@query("""select event_type as map_id, cast(8 as int) as b, round(quantile_cont(value, 0.5), 6) as median_ms, round(max(value), 6) as max_ms, count(*) as n_pairs from events group by 1""")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended to a table of CSV files in two goes and read back."""
    folder = shared_dir(spark, "results")
    e = events(spark, sf_dir)
    rows = e.groupBy(F.col("event_type").alias("map_id")).agg(F.percentile("value", 0.5).alias("median_ms"), F.max("value").alias("max_ms"), F.count("*").alias("n_pairs")).withColumn("b", F.lit(8))
    for part in (F.col("map_id") < "m", F.col("map_id") >= "m"):
        records.append_csv(rows.where(part), folder, "query_vs_k")
    return rounded(records.read_csv(spark, folder, "query_vs_k").select("map_id", "b", "median_ms", "max_ms", "n_pairs"))


@query("select event_id as tick, cast(user_id as int) as frontier_id, cast(event_id % 50 as int) as cell_count from events where event_id % 4 = 0")
def telemetry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier rows through the telemetry sink, which keeps every fourth tick; a batch offered twice is written once."""
    folder = shared_dir(spark, "telemetry")
    row = F.to_json(F.struct(F.col("event_id").alias("tick"), F.col("user_id").alias("frontier_id"), (F.col("event_id") % 50).alias("cell_count")))
    batch = events(spark, sf_dir).select(F.lit("frontier_events").alias("table"), row.alias("row"))
    sink = records.telemetry_sink(folder)
    for epoch in (0, 0):
        sink(batch, epoch)
    return spark.read.parquet(f"{folder}/frontier_events").select("tick", "frontier_id", "cell_count")
