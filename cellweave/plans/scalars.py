"""Queries of scalar expressions, sources and list functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import scalar
from cellweave.operators import neighbourhood
from cellweave.plans.registry import query
from cellweave.sources import derived, maps
from cellweave.sources.sql import CELLS

B, G = 8, 2


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.events_cells(spark, sf_dir)


@query("""select l_orderkey, l_linenumber, cast(least(60000, l_partkey * 13 + l_suppkey * 97) as bigint) as two,
  cast(least(60000, l_partkey * 13 + l_suppkey * 97 + l_orderkey) as bigint) as three from lineitem""")
def saturating_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = F.col("l_partkey") * 13, F.col("l_suppkey") * 97
    return t.select("l_orderkey", "l_linenumber", scalar.add_dist(a, b).alias("two"), scalar.add_dist(a, b, F.col("l_orderkey")).alias("three"))


@query(f"with {CELLS} select r, c, cast(abs(r - 37) + abs(c - 42) as int) as l1, (r, c) < (37, 42) as before from cells")
def point_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.struct("r", "c") < F.struct(F.lit(37), F.lit(42))
    return cells(spark, sf_dir).select("r", "c", scalar.manhattan(F.col("r"), F.col("c"), F.lit(37), F.lit(42)).alias("l1"), before.alias("before"))


@query(f"""with {CELLS} select r, c, cast(r * cols + c as int) as idx, cast((r * cols + c) // cols as int) as r2, cast((r * cols + c) % cols as int) as c2,
  (r + 1 < rows and c + 1 < cols) as next_inside from cells""")
def index_and_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = scalar.cell_index(F.col("r"), F.col("c"), F.col("cols"))
    back = scalar.cell_point(idx, F.col("cols"))
    return cells(spark, sf_dir).select("r", "c", idx.alias("idx"), back["r"].alias("r2"), back["c"].alias("c2"), scalar.in_bounds(F.col("r") + 1, F.col("c") + 1, F.col("rows"), F.col("cols")).alias("next_inside"))


@query(f"with {CELLS} select r, c from cells where observed = 1")
def passable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where(scalar.is_passable(F.col("observed"))).select("r", "c")


@query(f"""with {CELLS} select a.r, a.c, cast(coalesce(b.observed, 2) as int) as east, cast(case when coalesce(b.observed, 2) = 2 then 60000 else b.weight end as int) as east_weight
  from cells a left join cells b on b.r = a.r and b.c = a.c + 1""")
def observed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    east = own.select("map_id", "r", (F.col("c") - 1).alias("c"), F.col("observed").alias("o"), F.col("weight").alias("w"))
    met = own.select("map_id", "r", "c").join(east, ["map_id", "r", "c"], "left")
    return met.select("r", "c", scalar.observed_or_wall(F.col("o")).alias("east"), scalar.cell_weight(F.col("o"), F.col("w")).alias("east_weight"))


@query(f"""with {CELLS}, free as (select r, c, weight from cells where observed = 1)
  select a.r, a.c, b.r as r2, b.c as c2, cast(greatest(1, (a.weight + b.weight) // 2) as int) as w from free a, free b where (b.r = a.r + 1 and b.c = a.c) or (b.r = a.r and b.c = a.c + 1)""")
def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.seam_edges(cells(spark, sf_dir), 1).select("r", "c", "r2", "c2", "w")


@query(f"""with {CELLS} select r, c, cast(r // 8 as int) as tx, cast(c // 8 as int) as ty, cast(r // 32 as int) as tx2, cast(c // 32 as int) as ty2, cast((r % 8) * 8 + c % 8 as int) as local from cells""")
def tile_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = F.col("r"), F.col("c")
    up = B * G**2
    return cells(spark, sf_dir).select("r", "c", scalar.tile(r, B).alias("tx"), scalar.tile(c, B).alias("ty"), scalar.tile(r, up).alias("tx2"), scalar.tile(c, up).alias("ty2"), scalar.local_index(r, c, B).alias("local"))


_PORT = """case when r % 8 = 0 then c % 8 when r % 8 = 7 then 8 + c % 8 when c % 8 = 0 then 16 + r % 8 - 1 when c % 8 = 7 then 22 + r % 8 - 1 else -1 end"""


@query(f"with {CELLS} select cast(r // 8 as int) as tx, cast(c // 8 as int) as ty, cast({_PORT} as int) as idx, r, c from cells where {_PORT} >= 0")
def tile_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    tiles = own.select("map_id", scalar.tile(F.col("r"), B).alias("tx"), scalar.tile(F.col("c"), B).alias("ty")).distinct()
    ports = tiles.select("map_id", "tx", "ty", F.explode(scalar.ports(F.col("tx") * B, F.col("ty") * B, B)).alias("p")).select("map_id", "tx", "ty", "p.idx", "p.r", "p.c")
    return ports.join(own.select("map_id", "r", "c"), ["map_id", "r", "c"]).select("tx", "ty", "idx", "r", "c")


@query(f"with {CELLS} select r, c, cast({_PORT} as int) as port from cells")
def port_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("r", "c", scalar.port_index(F.col("r"), F.col("c"), B).alias("port"))


@query(f"""with {CELLS} select r, c, cast(case when r // 8 = 37 // 8 and c // 8 = 42 // 8 then 0 when r // 16 = 37 // 16 and c // 16 = 42 // 16 then 1
  when r // 32 = 37 // 32 and c // 32 = 42 // 32 then 2 when r // 64 = 0 and c // 64 = 0 then 3 else 4 end as int) as lvl from cells""")
def lca_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("r", "c", scalar.lca_level(F.col("r"), F.col("c"), F.lit(37), F.lit(42), B, G, 3).alias("lvl"))


@query("""with m as (select cast(max(event_id) // 100 + 1 as int) as n from events)
  select event_id, cast(greatest(0, least(99, floor((value / 10 - 1) / 0.25))) as int) as c, cast(greatest(0, least(n - 1, floor((user_id % 40 - 2) / 0.25))) as int) as r from events, m""")
def world_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = e.agg(F.max("event_id")).first()[0] // derived.WIDTH + 1
    at = scalar.world_to_cell(F.col("value") / 10 - 1, (F.col("user_id") % 40 - 2).cast("double"), 0.25, F.lit(n), F.lit(derived.WIDTH))
    return e.select("event_id", at["c"].alias("c"), at["r"].alias("r"))


@query("""with a as (select event_id, value - 60 as a, cast(event_id % 400 as int) as span, cast(event_id % 7 as int) as rays from events)
  select event_id, round(case when a between -pi() and pi() then a else a - 2 * pi() * floor((a + pi()) / (2 * pi())) end, 6) as angle,
    case when rays <= 1 then 0.0 when span >= 360 then span / rays else span / (rays - 1) end as step from a""")
def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    span, rays = (F.col("event_id") % 400).cast("double"), F.col("event_id") % 7
    return e.select("event_id", F.round(scalar.normalize_angle(F.col("value") - 60), 6).alias("angle"), scalar.ray_step(span, rays).alias("step"))


_UPDATES = """u as (select r, c, event_id as seq, case event_id % 3 when 0 then 'open' when 1 then 'block' else 'reweight' end as op, cast(event_id % 50 + 1 as int) as new
    from (select event_id, cast((event_id * 37 % n) // 100 as int) as r, cast(event_id * 37 % 100 as int) as c from events, (select max(event_id) + 1 as n from events)) where seq % 5 = 0)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event as an open, block or reweight of another cell."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").where("event_id % 5 = 0")
    n = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] + 1
    at = F.col("event_id") * 37
    op = F.when(F.col("event_id") % 3 == 0, "open").when(F.col("event_id") % 3 == 1, "block").otherwise("reweight")
    return e.select(F.lit("events").alias("map_id"), F.floor(at % n / 100).cast("int").alias("r"), (at % 100).cast("int").alias("c"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 50 + 1).cast("int").alias("weight"))


UPDATED = f"""{CELLS}, {_UPDATES}, state as (select r, c, max_by(op, seq) as op from u where op <> 'reweight' group by r, c), heavy as (select r, c, max_by(new, seq) as new from u where op = 'reweight' group by r, c),
  updated as (select cells.r, cells.c, gt, cast(case state.op when 'open' then 1 when 'block' then 2 else observed end as int) as observed, cast(coalesce(new, weight) as int) as weight, rows, cols
    from cells left join state using (r, c) left join heavy using (r, c))"""


#: Like UPDATED, with the openings alone.
OPENED = UPDATED.replace("max_by(op, seq) as op from u where op <> 'reweight'", "'open' as op from u where op = 'open'").replace("where op = 'reweight'", "where false")


@query(f"with {UPDATED} select r, c, observed, weight from updated")
def cell_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.update_cells(cells(spark, sf_dir), updates(spark, sf_dir)).select("r", "c", "observed", "weight")


@query(f"with {CELLS}, {_UPDATES} select r, c, cast(case when gt = 2 then 2 when (r, c) in (select (r, c) from u) then 0 else 1 end as int) as observed from cells")
def revealed_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.revealed_except(cells(spark, sf_dir), updates(spark, sf_dir)).select("r", "c", "observed")


@query("""with t as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as way, cast(l_orderkey % 4 as int) as cur from lineitem group by l_orderkey)
  select l_orderkey, cast(greatest(0, len(way) - cur) as int) as remaining, way[cur + 1] as goal, cast(case when cur < len(way) then cur + 1 else cur end as int) as next from t""")
def tour_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    way, cur = F.col("x.l_partkey"), (F.col("l_orderkey") % 4).cast("int")
    return t.select("l_orderkey", scalar.remaining(way, cur).alias("remaining"), scalar.current_goal(way, cur).alias("goal"), scalar.advance(way, cur).alias("next"))


@query("""with t as (select l_orderkey, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) || ',x,' as s from lineitem group by l_orderkey)
  select l_orderkey, s, array_to_string(list_transform(list_filter(string_split(s, ','), lambda x: trim(x) <> ''), lambda x: coalesce(try_cast(x as int), 0)), ',') as joined from t""")
def integer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    s = F.concat(scalar.join_ints(F.col("x")), F.lit(",x,"))
    return t.select("l_orderkey", s.alias("s"), scalar.join_ints(scalar.parse_ints(s)).alias("joined"))


@query("""with lines as (select cast(event_id // 100 as int) as r, cast(event_id % 100 as int) as c, case event_type when 'error' then '@' when 'signup' then 'G' when 'click' then 'S' when 'view' then '.' else 'T' end as ch from events)
  select r, c, cast(case when ch in ('.', 'G', 'S') then 1 else 2 end as int) as gt, cast(0 as int) as observed, cast(1 as int) as weight from lines""")
def map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of a map file, read as cells."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "@").when(F.col("event_type") == "signup", "G").when(F.col("event_type") == "click", "S").when(F.col("event_type") == "view", ".").otherwise("T")
    row = e.groupBy(F.expr("cast(event_id div 100 as int)").alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", kind.alias("ch")))), lambda x: x["ch"]), "").alias("line"))
    rows = e.agg(F.max(F.expr("event_id div 100")) + 1).first()[0]
    head = spark.createDataFrame([(0, "type octile\r"), (1, f"height {rows}\r"), (2, "width 100\r"), (3, "map")], "n int, line string")
    lines = head.unionByName(row.select((F.col("r") + 4).alias("n"), "line")).select(F.lit("events").alias("map_id"), "n", "line")
    return maps.parse_lines(lines).select("r", "c", "gt", "observed", "weight")


@query(f"with {CELLS} select r, c, gt, gt as observed from cells")
def fully_revealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.revealed(cells(spark, sf_dir)).select("r", "c", "gt", "observed")


@query("select cast(r as int) as r, cast(c as int) as c, cast(1 as int) as gt, cast(0 as int) as observed, cast(1 as int) as weight from range(120) a(r), range(90) b(c)")
def blank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.blank(spark, 120, 90).select("r", "c", "gt", "observed", "weight")


@query("select cast(r as int) as r, cast(c as int) as c, cast(case when r % 8 = 4 and c % 10 <> 5 then 2 else 1 end as int) as observed, cast(1 + (r * 31 + c * 17) % 20 as int) as weight from range(64) a(r), range(64) b(c)")
def weighted_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.weighted_walls(spark).select("r", "c", "observed", "weight")


@query("""select cast(r as int) as r, cast(c as int) as c, cast(case when r in (0, 63) or c in (0, 63) or (r = 32 and c not in (16, 48)) or (c = 32 and r not in (16, 48)) then 2 else 1 end as int) as gt from range(64) a(r), range(64) b(c)""")
def crossed_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.crossed_box(spark).select("r", "c", "gt")


@query(f"""with {CELLS} select cast(r * 2 + dr as int) as r, cast(c * 2 + dc as int) as c, cast(case when observed = 0 then gt else observed end as int) as state from cells, range(2) a(dr), range(2) b(dc)""")
def upscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.upscaled(cells(spark, sf_dir), 2).select("r", "c", F.col("gt").alias("state"))


@query()
def procedural_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.rooms(spark, 64, 64, 16, 42).select("r", "c", "gt", "observed")


@query()
def exploration_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.exploration_snapshot(cells(spark, sf_dir), (0, 0)).select("r", "c", "gt", "observed")
