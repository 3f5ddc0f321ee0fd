"""Statistics over latencies, matrices and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators import scans
from cellweave.session import INF


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, min, max, mean and the linearly interpolated quartiles of a column, for each group."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    out = _with(out, scans.quantiles(df, value, [0.25, 0.5, 0.75], [*by]), by)
    return out.select(*by, "n", "min", "max", "mean", *[F.col("q")[k].alias(name) for k, name in enumerate(("q1", "median", "q3"))])


def median_p95(df: DataFrame, value: str, *by: str) -> DataFrame:
    out = _with(df.groupBy(*by).agg(F.lit(0).alias("none")), scans.quantiles(df, value, [0.5, 0.95], [*by]), by)
    return out.select(*by, F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def _with(groups: DataFrame, quantiles: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Groups with their quantiles, null for a group without values."""
    if not by:
        return groups.join(quantiles, F.lit(True), "left")  # one row each
    other = quantiles.select(*(F.col(c).alias(f"q_{c}") for c in by), "q")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    return groups.join(other, same, "left").drop(*(f"q_{c}" for c in by))


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The upper of the two middle values where their number is even."""
    kind = dict(df.dtypes)[value]
    return scans.quantiles(df, value, [0.5], [*by], upper=True).select(*by, F.col("q")[0].cast(kind).alias("upper_median"))


def compare_matrices(a: DataFrame, b: DataFrame, *by: str, none: int | None = 0) -> DataFrame:
    """entries, mismatches, max_abs_diff and max_finite over matrices (..., i, j, d).

    An entry that one side lacks is a mismatch; where the sizes differ, all entries of the larger are counted on top. none:
    what a maximum is where nothing differs, or nothing is finite."""
    key = [*by, "i", "j"]
    both = a.select(*key, F.col("d").alias("da")).join(b.select(*key, F.col("d").alias("db")), key, "full_outer")
    finite = lambda x: F.when(F.col(x) < INF, F.col(x))
    differ = F.col("da") != F.col("db")
    out = both.groupBy(*by).agg(
        F.count("da").alias("na"),
        F.count("db").alias("nb"),
        F.count_if(F.coalesce(differ, F.lit(False))).alias("differing"),
        F.coalesce(F.max(F.when(differ, F.abs(F.col("da") - F.col("db")))), F.lit(none)).cast("int").alias("max_abs_diff"),
        F.coalesce(F.greatest(F.max(finite("da")), F.max(finite("db"))), F.lit(none)).cast("int").alias("max_finite"),
    )
    entries = F.greatest("na", "nb")
    return out.select(*by, entries.alias("entries"), (F.col("differing") + F.when(F.col("na") != F.col("nb"), entries).otherwise(0)).alias("mismatches"), "max_abs_diff", "max_finite")


def coverage(cells: DataFrame) -> DataFrame:
    """map_id, free, explored, fraction: the share of truly free cells that are observed free; 0 without any."""
    free = F.count_if(F.col("gt") == 1)
    seen = F.count_if((F.col("gt") == 1) & (F.col("observed") == 1))
    return cells.groupBy("map_id").agg(free.alias("free"), seen.alias("explored")).withColumn("fraction", F.when(F.col("free") > 0, F.col("explored") / F.col("free")).otherwise(0.0))


def speedups(pairs: DataFrame, base: str, ours: str, *by: str) -> DataFrame:
    """Mean latencies of paired samples, and the mean and largest of base / ours over pairs with a positive time."""
    ratio = F.when(F.col(ours) > 0, F.col(base) / F.col(ours))
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(base).alias(f"mean_{base}"), F.avg(ours).alias(f"mean_{ours}"), F.avg(ratio).alias("mean_speedup"), F.max(ratio).alias("max_speedup"))


def moving_average(df: DataFrame, by: str, order: str, value: str, keep: float = 0.85) -> DataFrame:
    """by, ema: the exponential average after the last value in order; it starts at the first.

    Each value counts with a power of `keep` by its place from the last, so a key's history is summed and never gathered."""
    numbered = scans.running(df.select(by, order, value), [by], [F.col(order).asc()], sums={"place": F.lit(1)})
    size = numbered.groupBy(F.col(by).alias("whose")).agg(F.max("place").alias("size"))
    numbered = numbered.join(size, F.col(by).eqNullSafe(F.col("whose")))
    weight = F.pow(F.lit(keep), F.col("size") - F.col("place"))
    first = F.min_by(F.struct(value, weight.alias("w")), "place")
    return numbered.groupBy(by).agg((F.sum((1 - keep) * weight * F.col(value)) + keep * first[value] * first["w"]).alias("ema"))


def idle_decay(rate: Column, idle_ticks: Column, patience: int = 40, factor: float = 0.96) -> Column:
    """A rate after some ticks without an event: it fades by a factor a tick once patience is over."""
    return rate * F.pow(F.lit(factor), F.greatest(F.lit(0), idle_ticks - patience))


def distance_travelled(track: DataFrame, by: str, order: str, jump: float = 1.5) -> DataFrame:
    """by, distance: the lengths of steps between positions (x, y) in order, leaving out steps of `jump` and more."""
    step = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    return _moves(track, by, order).withColumn("step", step).groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("step") < jump, F.col("step"))), F.lit(0.0)).alias("distance"))


def _moves(track: DataFrame, by: str, order: str) -> DataFrame:
    """Positions with the one before, x0 and y0."""
    return scans.running(track.select(by, order, "x", "y"), [by], [F.col(order).asc()], before={"x0": F.col("x"), "y0": F.col("y")})


def lag_profile(df: DataFrame, lag: str, *by: str) -> DataFrame:
    out = df.groupBy(*by).agg(F.max(lag).alias("max"), F.avg((F.col(lag) > 0).cast("double")).alias("busy"))
    return _with(out, scans.quantiles(df, lag, [0.95], [*by]), by).select(*by, F.col("q")[0].alias("p95"), "max", "busy")


def break_even(build: DataFrame, query: DataFrame) -> DataFrame:
    """By map_id, from build (build_ms, index_bytes) and query (search_ms, index_ms): after how many queries the index has paid for itself."""
    saved = F.col("search_ms") - F.col("index_ms")
    out = build.join(query, "map_id")
    return out.select("map_id", F.when(saved > 0, F.ceil(F.col("build_ms") / saved)).alias("break_even"), (F.col("index_bytes") / 1048576).alias("index_mib"), (F.col("search_ms") / F.col("index_ms")).alias("speedup"))


def stuck_runs(track: DataFrame, by: str, order: str, least: int, moved: float = 1e-3) -> DataFrame:
    """by, first, last, ticks: runs of at least `least` positions in a row without a move."""
    still = F.coalesce(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) < moved, F.lit(False))
    told = _moves(track, by, order).select(by, order, still.alias("still"))
    runs = scans.running(told, [by], [F.col(order).asc()], sums={"run": F.when(F.col("still"), 0).otherwise(1)}).groupBy(by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("ticks"))
    return runs.where(F.col("ticks") >= least).drop("run")


def stratified_pairs(pairs: DataFrame, stratum: str, caps: tuple[int, ...], *order: str) -> DataFrame:
    """The first pairs of each stratum in order until the running totals of `caps` are reached, strata in ascending order.

    A stratum that is short leaves its room to the ones after it."""
    own = F.row_number().over(W.partitionBy(stratum).orderBy(*order))
    ranked = pairs.withColumn("own", own)
    sizes = {row[stratum]: row["n"] for row in pairs.groupBy(stratum).agg(F.count("*").alias("n")).collect()}
    taken, total = {}, 0
    for s, cap in zip(sorted(sizes), caps):
        taken[s] = max(0, min(sizes[s], cap - total))
        total += taken[s]
    limit = F.lit(0)
    for s, n in taken.items():
        limit = F.when(F.col(stratum) == s, n).otherwise(limit)
    return ranked.where(F.col("own") <= limit).drop("own")
