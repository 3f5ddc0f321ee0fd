"""Queries on viewpoints of a map that begins at row 3,000: hashes of its cells pass an int."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.plans.catalogue import ORACLE_SQL, QUERIES
from tests.test_catalogue import SF, plain

NAMES = [
    "astar_matrix",
    "bfs_matrix",
    "cache_build",
    "bfs_pairs",
    "cache_lookup",
    "cache_refresh",
    "cache_staleness",
    "clear_paths",
    "dijkstra_matrix",
    "fleet_plan",
    "changed_leaves_matrix",
    "fallback_goals",
    "dijkstra_pairs",
]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("far"))
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", f"{out}/{name}")
    spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") + 300_000).write.parquet(f"{out}/events.parquet")
    con = duckdb.connect()
    for name in os.listdir(out):
        con.execute(f"create view {name[:-8]} as select * from '{out}/{name}{'/*.parquet' if name == 'events.parquet' else ''}'")
    return out, con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, far, name):
    ours = QUERIES[name](spark, far[0]).toPandas()
    if name not in ORACLE_SQL:
        assert len(ours)
        return
    sql = ORACLE_SQL[name].replace("(r * 100 + c) * 7919", "(r * 100 + c)::bigint * 7919")  # the SQL's own hash passes an int too
    pd.testing.assert_frame_equal(plain(ours), plain(far[1].execute(sql).df()), check_dtype=False)
