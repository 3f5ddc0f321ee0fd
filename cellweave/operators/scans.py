"""Running values and exact ranks of keys that may hold any share of the rows.

Rows are sorted in ranges of (key, order), so a hot key fills several ranges, and written. Each range is scanned alone; what
it carries over to the next is one aggregated row, and only keys that reach over a range's end have any: at most one a range.
While no key has over MOST rows, a window over the whole key does the same in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.session import stored

#: Rows of a key up to which one task takes it whole.
MOST = 1 << 20


def largest(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def ranges(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with `block`, the range of a row, and `place`, which rises with (by, order)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order, F.col("tie").asc()]
    ordered = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("tie")
    return stored(ordered.withColumns({"block": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ordered")


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums (this row included), last values that were not null (this row included), and values of the row before.

    by may be empty: then all rows are one key. Sums of nothing but nulls are 0; `before` is null in a key's first row.
    """
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    put = {f"__{k}": c for k, c in (*sums.items(), *lasts.items(), *before.items())}
    own = df.withColumns(put)
    if largest(df, by) <= MOST:
        over = W.partitionBy(*by).orderBy(*order)
        upto = over.rowsBetween(W.unboundedPreceding, 0)
        out = {k: F.coalesce(F.sum(f"__{k}").over(upto), F.lit(0)) for k in sums} | {k: F.last(f"__{k}", ignorenulls=True).over(upto) for k in lasts} | {k: F.lag(f"__{k}").over(over) for k in before}
        return own.withColumns(out).drop(*put)
    rows = ranges(own, by, order)
    over = W.partitionBy("block", *by).orderBy("place")
    upto = over.rowsBetween(W.unboundedPreceding, 0)
    local = {k: F.coalesce(F.sum(f"__{k}").over(upto), F.lit(0)) for k in sums} | {k: F.last(f"__{k}", ignorenulls=True).over(upto) for k in lasts} | {k: F.lag(F.struct(f"__{k}")).over(over) for k in before}
    found = [F.sum(f"__{k}").alias(f"c_{k}") for k in sums]
    found += [F.max_by(f"__{k}", F.when(F.col(f"__{k}").isNotNull(), F.col("place"))).alias(f"c_{k}") for k in lasts]
    found += [F.max_by(F.struct(f"__{k}"), "place").alias(f"c_{k}") for k in before]
    earlier = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = rows.groupBy("block", *by).agg(*found)
    carry = carry.select(F.col("block").alias("b_block"), *(F.col(c).alias(f"b_{c}") for c in by), F.count("*").over(earlier).alias("ranges"), *(F.sum(f"c_{k}").over(earlier).alias(f"c_{k}") for k in sums), *(F.last(f"c_{k}", ignorenulls=True).over(earlier).alias(f"c_{k}") for k in (*lasts, *before))).where("ranges > 0")
    same = F.col("block") == F.col("b_block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    met = rows.withColumns(local).join(F.broadcast(carry), same, "left")  # at most one row a range
    out = {k: F.col(k) + F.coalesce(f"c_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(k, f"c_{k}") for k in lasts} | {k: F.coalesce(k, f"c_{k}")[f"__{k}"] for k in before}
    return met.withColumns(out).select(*df.columns, *sums, *lasts, *before)


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str], upper: bool = False) -> DataFrame:
    """by, and q: the exact quantiles of a column as an array of doubles, linearly between the two nearest ranks.

    upper: the value of rank floor(share * n) instead. Nulls are left out. Rows are counted by range, and only the ranks asked
    for are looked up.
    """
    slim = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(f"__{c}") for c in by), F.col(value).cast("double").alias("v"))
    found = _quantiles(slim, shares, [f"__{c}" for c in by], upper)
    return found.select(*(F.col(f"__{c}").alias(c) for c in by), "q")


def _quantiles(slim: DataFrame, shares: list[float], by: list[str], upper: bool) -> DataFrame:
    if not upper and largest(slim, by) <= MOST:
        return slim.groupBy(*by).agg(F.percentile("v", shares).alias("q"))
    rows = ranges(slim, by, [F.col("v").asc()])
    earlier = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    per = rows.groupBy("block", *by).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    per = per.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(W.partitionBy(*by))})
    rank = F.col("share") * F.col("total") if upper else F.col("share") * (F.col("total") - 1)
    asked = per.withColumn("at", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)))))
    asked = asked.select(*by, "first", "before", "n", "at.k", "at.share", "total").withColumn("rank", rank)
    ends = [F.floor("rank")] if upper else [F.floor("rank"), F.ceil("rank")]
    asked = asked.withColumn("end", F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.least(x, F.col("total") - 1).alias("r")) for e, x in enumerate(ends)))))
    here = (F.col("end.r") >= F.col("before")) & (F.col("end.r") < F.col("before") + F.col("n"))
    asked = asked.where(here).select(*by, "k", "rank", F.col("end.e").alias("e"), F.col("end.r").alias("r"), (F.col("first") + F.col("end.r") - F.col("before")).alias("place"))
    got = asked.join(rows.select("place", "v"), "place")
    low, high = (F.max(F.when(F.col("e") == e, F.col("v"))) for e in (0, 1))
    if upper:
        each = got.groupBy(*by, "k").agg(low.alias("v"))
    else:
        floor, ceil = F.floor(F.first("rank")), F.ceil(F.first("rank"))
        each = got.groupBy(*by, "k").agg(F.when((floor == ceil) | (low == high), low).otherwise((ceil - F.first("rank")) * low + (F.first("rank") - floor) * high).alias("v"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("q")).withColumn("q", F.transform("q", lambda x: x["v"]))  # as many as shares
