"""Result tables, telemetry, reports and log files."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import resource
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import scans

#: The columns of the result and telemetry tables, in order.
RESULTS = {
    "query_vs_k": """
        map_id string, b int, g int, geometry string, set_id string, seed bigint, k int, method string, warmup int,
        repeats int, median_ms double, mean_ms double, min_ms double, max_ms double, n_pairs bigint, index_bytes bigint,
        peak_rss_bytes bigint, max_finite_dist bigint, mismatches bigint, binary_sha string, regime string
    """,
    "query_repeats": """
        map_id string, b int, g int, geometry string, set_id string, seed bigint, k int, method string, repeat_idx int,
        ms double, regime string
    """,
    "update_latency": """
        map_id string, b int, g int, pattern string, m int, batch_id string, seed bigint, n_touched_leaves bigint,
        n_dirty_ancestors bigint, n_pivots bigint, index_upd_median_ms double, index_upd_min_ms double,
        index_upd_max_ms double, rebuild_median_ms double, kbfs_dt_median_ms double, k_check int, entries_checked bigint,
        mismatches bigint, peak_rss_bytes bigint, binary_sha string, regime string
    """,
    "full_build": """
        map_id string, b int, g int, set_id string, seed bigint, build_ms double, index_bytes bigint, peak_rss_bytes bigint,
        binary_sha string, regime string
    """,
    "exactness": """
        suite_id string, family string, maps_or_config string, b int, g int, seed bigint, n_openings bigint,
        n_blockages bigint, n_entries bigint, reference string, mismatches bigint, max_abs_diff bigint, max_finite_dist bigint,
        binary_sha string, git_sha string
    """,
    "mission_telemetry": """
        tick bigint, sim_time_s double, wall_time_s double, num_robots int, explored_cells int, total_free_cells int,
        coverage_pct double, newly_opened_cells int, active_frontiers int, active_viewpoints int, index_update_us double,
        index_query_us double, bfs_query_us double, speedup double, mtsp_plan_us double, sim_step_freq_hz double,
        map_update_freq_hz double, query_freq_hz double, total_respawns int, replica_lag_ticks bigint, pending_openings bigint,
        updating int
    """,
    "robot_trajectories": """
        tick bigint, sim_time_s double, robot_id int, x_m double, y_m double, theta_rad double, vx_mps double, w_radps double,
        has_goal int, goal_r int, goal_c int, goal_x_m double, goal_y_m double, tour_waypoints_left int, stuck_ticks int,
        persistence_ticks int, distance_traveled_m double
    """,
    "frontier_events": """
        tick bigint, sim_time_s double, frontier_id int, rep_r int, rep_c int, rep_x_m double, rep_y_m double, cell_count int,
        assigned_robot_id int
    """,
    "bfs_compare": """
        job_id bigint, tick bigint, num_points int, index_query_us double, bfs_query_us double, speedup double,
        astar_query_us double, astar_speedup double
    """,
}


def columns(table: str) -> list[tuple[str, str]]:
    """The names and types of a table's columns."""
    return [tuple(x.split()) for x in RESULTS[table].split(",")]


#: Ticks from one set of frontier rows to the next.
FRONTIER_EVERY = 4


def append_csv(df: DataFrame, path: str, table: str) -> None:
    """Append rows to a table's folder of CSV files; every file has the header, columns that are missing are null."""
    have = set(df.columns)
    df.select(*[(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in columns(table)]).write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(RESULTS[table]).option("header", True).csv(path)


def per_step(telemetry: DataFrame) -> DataFrame:
    """tick, explored_fraction, frontiers_k, update_us, query_us."""
    return telemetry.select("tick", (F.col("coverage_pct") / 100).alias("explored_fraction"), F.col("active_frontiers").alias("frontiers_k"), F.col("index_update_us").alias("update_us"), F.col("index_query_us").alias("query_us"))


def mission_summary(telemetry: DataFrame, by: str = "session") -> DataFrame:
    """One row a session: its length, final coverage, openings, and medians and 95th percentiles of the latencies."""
    out = telemetry.groupBy(by).agg(
        F.count("*").alias("ticks"),
        F.max("tick").alias("last_tick"),
        F.max_by("coverage_pct", "tick").alias("final_coverage_pct"),
        F.sum("newly_opened_cells").alias("opened"),
        F.percentile("index_query_us", [0.5, 0.95]).alias("q"),
        F.percentile("index_update_us", [0.5, 0.95]).alias("u"),
    )
    return out.select(by, "ticks", "last_tick", "final_coverage_pct", "opened", *[F.col(x)[k].alias(f"{n}_{p}_us") for x, n in (("q", "query"), ("u", "update")) for k, p in ((0, "median"), (1, "p95"))])


def mission_report(telemetry: DataFrame, trajectories: DataFrame, compared: DataFrame, cells: DataFrame, config, settings: dict, by: str = "session") -> DataFrame:
    """One row a session with the parts of its report as structs; `to_json` of the row is the document.

    telemetry, trajectories and compared have the columns of their tables and `by`; cells is the one map of all sessions at
    its end, config the index's. settings, what a repetition needs (seed, periods, switches, scanner, speeds), is taken as
    it is. Means, percentiles and counts of nothing are 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    part = lambda df, *aggs: df.groupBy(by).agg(*aggs)
    own = part(
        telemetry,
        F.struct(F.max("tick").alias("total_ticks"), F.max("sim_time_s").alias("total_sim_time_s"), F.max("wall_time_s").alias("total_wall_time_s"), F.count("*").alias("logged_steps")).alias("mission_metadata"),
        F.max_by("coverage_pct", "tick").alias("final_coverage_pct"),
        F.coalesce(F.max("total_respawns"), F.lit(0)).alias("total_respawns"),
        F.struct(
            *[zero(F.avg(c)).alias(f"{n}_mean_us") for c, n in (("index_query_us", "query"), ("index_update_us", "update"))],
            *[zero(F.percentile(c, p)).alias(f"{n}_{x}_us") for c, n in (("index_query_us", "query"), ("index_update_us", "update")) for x, p in (("median", 0.5), ("p95", 0.95))],
            zero(F.percentile("replica_lag_ticks", 0.95)).alias("replica_lag_p95_ticks"),
            F.coalesce(F.max("replica_lag_ticks"), F.lit(0)).alias("replica_lag_max_ticks"),
            zero(F.avg((F.col("replica_lag_ticks") > 0).cast("int"))).alias("replica_lag_busy_frac"),
        ).alias("measured"),
    )
    ways = trajectories.groupBy(by, "robot_id").agg(F.max_by("distance_traveled_m", "tick").alias("m"))
    fleet = part(ways, F.count("*").alias("robot_count"), F.sum("m").alias("total_fleet_distance_m"), F.array_sort(F.collect_list(F.struct("robot_id", "m")))["m"].alias("per_robot_distance_m"))
    pairs = part(compared, F.count("*").alias("n"), F.avg("index_query_us").alias("ours"), F.avg("bfs_query_us").alias("base"), F.percentile("bfs_query_us", 0.5).alias("median"), F.avg("speedup").alias("mean"), F.max("speedup").alias("most"))
    grid = cells.agg(F.first("rows").alias("grid_rows"), F.first("cols").alias("grid_cols"), F.count_if(F.col("gt") == 1).alias("total_free_cells"), F.count_if((F.col("gt") == 1) & (F.col("observed") == 1)).alias("explored_free_cells")).first()
    rows, cols = grid["grid_rows"] or 0, grid["grid_cols"] or 0
    tree = {"tile_side": config.b, "group_side": config.g, "tree_depth": config.height(rows or 1, cols or 1) + 1, "total_leaves": -(-rows // config.b) * -(-cols // config.b)}
    consts = lambda d: [F.lit(v).alias(k) for k, v in d.items()]
    out = own.join(fleet, by, "left").join(pairs, by, "left")
    return out.select(
        by,
        "mission_metadata",
        F.struct(*consts(grid.asDict()), "final_coverage_pct").alias("environment"),
        F.struct(*consts(tree)).alias("hierarchy"),
        F.lit(json.dumps(settings, sort_keys=True)).alias("repeatability"),
        F.struct(F.coalesce("robot_count", F.lit(0)).alias("robot_count"), "total_respawns", zero(F.col("total_fleet_distance_m")).alias("total_fleet_distance_m"), "per_robot_distance_m").alias("fleet"),
        F.struct("measured.*", F.coalesce("n", F.lit(0)).alias("compare_count"), *[zero(F.col(a)).alias(b) for a, b in (("ours", "paired_query_mean_us"), ("base", "bfs_query_mean_us"), ("median", "bfs_query_median_us"), ("mean", "mean_speedup_vs_bfs"), ("most", "max_speedup_vs_bfs"))]).alias("performance_metrics"),
    )


def summary_json(summary: DataFrame, metadata: dict) -> DataFrame:
    """A JSON document for each row of a summary, with the metadata."""
    return summary.select(F.to_json(F.struct(F.lit(json.dumps(metadata, sort_keys=True)).alias("metadata"), F.struct("*").alias("performance_metrics"))).alias("value"))


def manifest(config: dict, status: str, outcome: dict | None = None) -> str:
    """The JSON of a trial: written when it is running and again when it is complete."""
    if status not in ("running", "complete", "failed"):
        raise ValueError(status)
    return json.dumps({"status": status, "config": config, "outcome": outcome or {}, "machine": provenance(), "build": build_record()}, indent=2, sort_keys=True)


def provenance() -> dict:
    """What a result was measured on."""
    return {"system": platform.system(), "machine": platform.machine(), "python": platform.python_version(), "cpus": os.cpu_count(), "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024}


def build_record(folder: str = ".") -> dict:
    """The versions that a result was made with, and the state of the git checkout in a folder (null without one)."""
    import pyspark

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout.strip()
        except (OSError, subprocess.CalledProcessError):
            return None

    changes = git("status", "--porcelain")
    return {"pyspark": pyspark.__version__, "git_sha": git("rev-parse", "HEAD"), "git_branch": git("rev-parse", "--abbrev-ref", "HEAD"), "git_dirty": None if changes is None else bool(changes)}


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of all files below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def scrape_logs(lines: DataFrame) -> DataFrame:
    """log, suite, entries, matches, max_diff from log lines (log, n, line).

    A line `=== name ===` opens a suite; `Queries: q, Matches: m` adds up in it, `MaxDiff: d` is its largest, and
    `verifications=v, openings=o` counts as v entries that all match. Lines before the first suite are left out.
    """
    number = lambda pattern: F.regexp_extract("line", pattern, 1).try_cast("long")
    name = F.when(F.col("line").rlike(r"^=== .* ===$"), F.regexp_extract("line", r"^=== (.*) ===$", 1))
    lines = scans.running(lines.select("log", "n", "line"), ["log"], [F.col("n").asc()], lasts={"suite": name})
    checks = number(r"verifications=(\d+)")
    marked = lines.select("log", "suite", F.coalesce(number(r"Queries: (\d+)"), checks).alias("q"), F.coalesce(number(r"Matches: (\d+)"), checks).alias("m"), number(r"MaxDiff: (\d+)").alias("d"))
    return marked.where("suite is not null").groupBy("log", "suite").agg(F.coalesce(F.sum("q"), F.lit(0)).alias("entries"), F.coalesce(F.sum("m"), F.lit(0)).alias("matches"), F.coalesce(F.max("d"), F.lit(0)).alias("max_diff"))


def json_escape(text: str) -> str:
    """The inside of a JSON string, control characters included."""
    return json.dumps(text, ensure_ascii=False)[1:-1]


def telemetry_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the batch's rows (table, row as JSON) to the four telemetry tables below path.

    A batch that is written again replaces its own folder, so retries do not repeat rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        for name in ("mission_telemetry", "robot_trajectories", "frontier_events", "bfs_compare"):
            rows = batch.where(F.col("table") == name)
            if name == "frontier_events":
                rows = rows.where(F.get_json_object("row", "$.tick").cast("long") % FRONTIER_EVERY == 0)
            rows.select(F.from_json("row", RESULTS[name]).alias("x")).select("x.*").write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")

    return write
