"""Queries on the index of a map that begins at row 3,000, where hashes of cells pass an int; they run at once, as each is a chain of small jobs."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.plans.catalogue import ORACLE_SQL, QUERIES
from tests.test_catalogue import SF, plain

NAMES = ["grown_index_matrix", "hybrid_matrix", "incremental_matrix", "leaf_lifts", "index_pairs", "index_matrix", "matrix_check"]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Each query's rows, or its error; and the tables in DuckDB."""
    out = str(tmp_path_factory.mktemp("far"))
    spark.read.parquet(f"{SF}/events.parquet").where("event_id < 600").withColumn("event_id", F.col("event_id") + 300_000).write.parquet(f"{out}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{out}/events.parquet/*.parquet'")

    def rows(name):
        try:
            return QUERIES[name](spark, out).toPandas()
        except Exception as error:
            return error

    with ThreadPoolExecutor(len(NAMES)) as pool:
        return dict(zip(NAMES, pool.map(rows, NAMES))), con


@pytest.mark.parametrize("name", NAMES)
def test_query(far, name):
    ours = far[0][name]
    if isinstance(ours, Exception):
        raise ours
    sql = ORACLE_SQL[name].replace("(r * 100 + c) * 7919", "(r * 100 + c)::bigint * 7919")  # the SQL's own hash passes an int too
    pd.testing.assert_frame_equal(plain(ours), plain(far[1].execute(sql).df()), check_dtype=False)
