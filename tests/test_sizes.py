"""What bounds memory and what large maps ask for: row groups, wide nodes, levels that are not kept, long ways."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cellweave.operators import query, search, tiles
from cellweave.session import INF, stored
from cellweave.streaming import versions
from tests.grids import as_matrix, plain_matrix, table, updates, viewpoints


def states_of(rows, cols):
    return [[2 if (r * 7 + c * 11) % 13 == 0 else 0 if (r * 5 + c) % 31 == 0 else 1 for c in range(cols)] for r in range(rows)]


def largest_group(df):
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in df.inputFiles()]
    return max(m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups))


def test_row_groups_of_matrices_are_small(spark, tmp_path):
    """A reader holds up to 4096 rows of one row group, so groups are bounded by bytes."""
    dealt = np.random.default_rng(5)
    wide = spark.createDataFrame([(k, dealt.bytes(256 << 10)) for k in range(64)], "id int, D binary").coalesce(1)
    assert largest_group(stored(wide, "wide")) < 4 << 20
    log = versions.VersionLog(spark, f"file://{tmp_path}/log")
    assert largest_group(spark.read.parquet(f"{log.path}/{log._write(wide, 'rows/1')}")) < 4 << 20


@pytest.mark.parametrize("batch", [[(3, 3, "open", None), (20, 9, "block", None), (31, 4, "reweight", 7)], [(3, 3, "open", None), (33, 5, "open", None)]])
def test_batch_stats_count_levels_that_are_not_kept(spark, batch):
    own = table(spark, states_of(40, 12))
    whole, cut = (tiles.Index.build(own, tiles.Config(b=4, max_ports=m)).update(updates(spark, batch)) for m in (8192, 45))
    assert whole.whole and cut.height < whole.height
    a, b = (x.batch_stats().first() for x in (whole, cut))
    assert (a["touched"], a["ancestors"]) == (b["touched"], b["ancestors"])
    if any(op != "open" for *_, op, _ in batch):  # a batch of openings goes on from old distances, with other pivots
        assert a["pivots"] == b["pivots"]
    a, b = (x.batch_stats(2).first() for x in (whole, cut))
    assert (a["touched"], a["ancestors"]) == (b["touched"], b["ancestors"])


def test_lifts_to_levels_that_are_not_kept(spark):
    """Also with ways of over 60000."""
    states = states_of(40, 12)
    points = viewpoints(spark, [(3, 2), (38, 11), (18, 5), (0, 0)])
    heavy = [[4000 + r for c in range(12)] for r in range(40)]
    whole, cut = (query.ask(tiles.Index.build(table(spark, states, heavy), tiles.Config(b=4, max_ports=m)), points) for m in (8192, 45))
    assert whole.index.whole and cut.index.height + 1 < whole.index.height
    read = lambda df: sorted(map(tuple, df.collect()))
    rows = read(whole.ports())
    assert max(x[-1] for x in rows) > 60_000 and rows == read(cut.ports())
    assert read(whole.lifts()) == read(cut.lifts())
    want = plain_matrix(states, [(3, 2), (38, 11), (18, 5), (0, 0)], heavy)
    assert as_matrix(whole.matrix(), 4) == as_matrix(cut.matrix(), 4) == want


@pytest.mark.parametrize("weighted", [False, True])
def test_one_to_many_goes_on_beyond_60000(spark, monkeypatch, weighted):
    """Ways along a map of 61,000 cells, in one tile and over several; a wall ends them."""
    n = 61_000
    cells = spark.range(n).select(F.lit("m").alias("map_id"), F.lit(n).alias("rows"), F.lit(1).alias("cols"), F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1).alias("gt"), F.when(F.col("id") == n - 5, 2).otherwise(1).alias("observed"), F.lit(3).alias("weight"))
    targets = cells.where("r % 1000 = 0 or r > 60990").select("map_id", F.col("r").alias("j"), "r", "c")
    want = {r: INF if r >= n - 5 else r * (3 if weighted else 1) for r in [*range(0, n, 1000), *range(60_991, n)]}
    for side in (1024, 128):
        monkeypatch.setattr(search, "SIDE", side)
        assert {x["j"]: x["d"] for x in search.one_to_many(cells, (0, 0), targets, weighted).collect()} == want
