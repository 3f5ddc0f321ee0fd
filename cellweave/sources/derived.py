"""Grids, viewpoints, matrices and telemetry derived from the driver's tables.

A table of cells has the columns of CELLS; rows and cols are those of the cell's map. Everything is keyed by map_id, so one
plan serves many maps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = ("map_id", "rows", "cols", "r", "c", "gt", "observed", "weight")
WIDTH = 100


def events_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map, 100 wide, with a cell for each event: errors are obstacles, sign-ups under 10 are unknown, value sets the weight."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    n = e.agg(F.max("event_id")).first()[0]
    error = F.col("event_type") == "error"
    hidden = (F.col("event_type") == "signup") & (F.col("value") < 10)
    return e.select(
        F.lit("events").alias("map_id"),
        F.lit(n // WIDTH + 1).cast("int").alias("rows"),
        F.lit(WIDTH).cast("int").alias("cols"),
        F.expr(f"cast(event_id div {WIDTH} as int)").alias("r"),
        F.expr(f"cast(event_id % {WIDTH} as int)").alias("c"),
        F.when(error, 2).otherwise(1).cast("int").alias("gt"),
        F.when(error, 2).when(hidden, 0).otherwise(1).cast("int").alias("observed"),
        (F.floor("value").cast("int") % 20 + 1).cast("int").alias("weight"),
    )


def explored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of the events with fewer obstacles, and squares of 12 cells that were never seen."""
    wall = (F.col("gt") == 2) & ((F.col("r") * 100 + F.col("c")) % 3 == 0)
    hidden = (F.floor(F.col("r") / 12) + F.floor(F.col("c") / 12)) % 3 == 0
    out = events_cells(spark, sf_dir).withColumn("gt", F.when(wall, 2).otherwise(1).cast("int"))
    return out.withColumn("observed", F.when(hidden, 0).otherwise(F.col("gt")).cast("int"))


def viewpoints(cells: DataFrame, k: int, step: int = 7919, modulus: int = 10007) -> DataFrame:
    """map_id, i, r, c: k free cells of each map in the order of an arithmetic hash."""
    from pyspark.sql import Window as W

    h = (F.col("r").cast("long") * 100 + F.col("c")) * step % modulus  # beyond an int from 271,180 cells on
    order = F.row_number().over(W.partitionBy("map_id").orderBy(h, "r", "c"))
    numbered = cells.where("observed = 1").select("map_id", order.alias("number"), "r", "c").where(F.col("number") <= k)
    return numbered.select("map_id", (F.col("number") - 1).cast("int").alias("i"), "r", "c")
