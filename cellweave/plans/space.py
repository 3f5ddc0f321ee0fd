"""Queries of the neighbourhood operators, frontiers and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import frontier, neighbourhood, raster, sampling
from cellweave.plans.registry import query
from cellweave.plans.scalars import B, cells
from cellweave.sources import derived
from cellweave.sources.sql import CELLS, EXPLORED, FOUR, SQUARE, viewpoints

CLEARANCE = f"""{SQUARE}, wall as (select r, c from cells where observed = 2),
  near as (select wall.r + dr as r, wall.c + dc as c, min(greatest(abs(dr), abs(dc))) as near from wall, sq group by all),
  clear as (select cells.r, cells.c, observed, rows, cols, cast(case when observed = 1 then least(3, coalesce(near, 3), r + 1, c + 1, rows - r, cols - c) else 0 end as int) as clr from cells left join near using (r, c))"""


@query(f"with {EXPLORED}, {CLEARANCE} select r, c, clr from clear")
def clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.clearance(derived.explored_cells(spark, sf_dir)).select("r", "c", "clr")


FRONTIER = f"""{CLEARANCE}, {FOUR}, unk as (select r, c from cells where observed = 0),
  u4 as (select unk.r + dr as r, unk.c + dc as c, count(*) as n from unk, four group by all),
  deep as (select unk.r + dr as r, unk.c + dc as c, count(*) as n from unk join u4 on u4.r = unk.r and u4.c = unk.c and u4.n >= 2, four group by all),
  around as (select a.r, a.c, sum(case when b.observed = 0 then 1 else 0 end) as unknowns, sum(case when coalesce(b.observed, 2) = 2 then 1 else 0 end) as walls
    from (select r, c, dr, dc from cells, sq where observed = 1) a left join cells b on b.r = a.r + dr and b.c = a.c + dc group by all),
  front as (select clear.r, clear.c, clr from clear join u4 using (r, c) join deep using (r, c) join around using (r, c)
    where clear.observed = 1 and unknowns >= 4 and not (clr <= 1 and (walls >= 6 or unknowns < 6)))"""


@query(f"with {EXPLORED}, {FRONTIER} select r, c, clr from front")
def frontier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.frontier_cells(derived.explored_cells(spark, sf_dir)).select("r", "c", "clr")


CLUSTERS = f"""eight as (select * from sq where abs(dr) <= 1 and abs(dc) <= 1),
  link as (select a.r * 100 + a.c as a, b.r * 100 + b.c as b from front a, eight, front b where b.r = a.r + dr and b.c = a.c + dc),
  label(p, l) using key (p) as (select r * 100 + c, r * 100 + c from front union
    select q.p, q.l from (select link.b as p, min(label.l) as l from label join link on link.a = label.p group by all) q join recurring.label old on old.p = q.p where q.l < old.l),
  member as (select cast(p // 100 as int) as r, cast(p % 100 as int) as c, cast(dense_rank() over (order by l) - 1 as int) as cluster_id from label),
  cluster as (select cluster_id, r, c, clr from member join front using (r, c) where cluster_id in (select cluster_id from member join front using (r, c) group by 1 having count(*) >= 2 and max(clr) >= 2))"""


@query(f"with recursive {EXPLORED}, {FRONTIER}, {CLUSTERS} select cluster_id, r, c, clr from cluster")
def frontier_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.cluster_cells(derived.explored_cells(spark, sf_dir), max_size=0).select("cluster_id", "r", "c", "clr")


@query()
def frontier_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.frontier_clusters(derived.explored_cells(spark, sf_dir))
    return out.select("id", F.col("rep.r").alias("r"), F.col("rep.c").alias("c"), F.size("cells").alias("size"))


_MEDOID = """cost as (select a.cluster_id, a.r, a.c, count(*) as size, sum(abs(a.r - b.r) + abs(a.c - b.c)) + max(case when a.clr <= 1 then 1000 when a.clr = 2 then 100 else 0 end) as cost from {t} a join {t} b using (cluster_id) group by all),
  medoid as (select cluster_id, cast(any_value(size) as int) as size, cast(min(cost) as bigint) as cost from cost group by 1)"""


@query(f"with recursive {EXPLORED}, {FRONTIER}, {CLUSTERS}, {_MEDOID.format(t='cluster')} select cluster_id, size, cost from medoid where size <= 128")
def frontier_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of each medoid: the cell is one of least cost, first in visiting order.

    Over frontier.EXACT cells it is the squared distance to the centroid and that penalty; the SQL has no such clusters.
    """
    own = frontier.cluster_cells(derived.explored_cells(spark, sf_dir), max_size=0)
    best = frontier.medoids(own)
    at = best.join(own.select("cluster_id", "r", "c", "clr"), ["cluster_id", "r", "c"])
    other = own.select("cluster_id", F.col("r").alias("r2"), F.col("c").alias("c2"))
    l1 = F.abs(F.col("r") - F.col("r2")) + F.abs(F.col("c") - F.col("c2"))
    penalty = F.when(F.col("clr") <= 1, 1000).when(F.col("clr") == 2, 100).otherwise(0)
    exact = at.where(F.col("size") <= frontier.EXACT).join(other, "cluster_id").groupBy("cluster_id", "size").agg((F.sum(l1) + F.max(penalty)).cast("double").alias("cost"))
    middle = own.groupBy("cluster_id").agg(F.avg("r").alias("mr"), F.avg("c").alias("mc"))
    dr, dc = F.col("r") - F.col("mr"), F.col("c") - F.col("mc")
    penalty = F.when(F.col("clr") <= 1, 200.0).when(F.col("clr") == 2, 20.0).otherwise(0.0)
    rough = at.where(F.col("size") > frontier.EXACT).join(middle, "cluster_id").select("cluster_id", "size", (dr * dr + dc * dc + penalty).alias("cost"))
    return exact.unionByName(rough)


@query(f"""with {EXPLORED}, {FRONTIER}, off as (select a.x as dr, b.x as dc from (values (-3), (-2), (-1), (0), (1), (2), (3)) a(x), (values (-3), (-2), (-1), (0), (1), (2), (3)) b(x)),
  ranked as (select f.r, f.c, f.clr, k.r as kr, k.c as kc, row_number() over (partition by f.r, f.c order by k.clr desc, dr * dr + dc * dc, k.r, k.c) as n from front f, off, clear k where k.r = f.r + dr and k.c = f.c + dc and k.observed = 1)
  select r, c, case when clr >= 2 then r else kr end as safe_r, case when clr >= 2 then c else kc end as safe_c from ranked where n = 1""")
def stand_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.explored_cells(spark, sf_dir)
    return frontier.stand_off(neighbourhood.frontier_cells(own), own).select("r", "c", "safe_r", "safe_c")


@query(f"""with recursive {EXPLORED}, {FRONTIER}, {CLUSTERS}, rep as (select cluster_id, count(*) as size, min(r * 100 + c) as lead from cluster group by 1),
  tiled as (select cluster_id, cast(size as int) as size, cast(lead // 100 as int) as r, cast(lead % 100 as int) as c, cast((lead // 100 // 8) * 13 + lead % 100 // 8 as int) as tile, count(*) over () as n from rep),
  turned as (select *, row_number() over (partition by tile order by size desc, cluster_id) as turn from tiled),
  picked as (select *, cast(row_number() over (order by case when n > 40 then turn end, case when n > 40 then tile end, cluster_id) - 1 as int) as pick from turned)
  select pick, cluster_id, size, r, c, tile from picked where pick < 40""")
def viewpoint_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 40 clusters, represented by their first cells, in rounds over the tiles."""
    own = derived.explored_cells(spark, sf_dir)
    reps = frontier.cluster_cells(own, max_size=0).groupBy("map_id", "cluster_id").agg(F.count("*").cast("int").alias("size"), F.min(F.struct("r", "c")).alias("p"))
    reps = reps.select("map_id", "cluster_id", "size", "p.r", "p.c").join(own.select("map_id", "cols").distinct(), "map_id")
    return frontier.select_viewpoints(reps, 40, B).select("pick", "cluster_id", "size", "r", "c", "tile")


@query(f"""with {EXPLORED}, hidden as (select distinct r + a.x as r, c + b.x as c from cells, range(-4, 5) a(x), range(-4, 5) b(x) where observed = 0)
  select cells.r, cells.c, hidden.r is null as explored from cells left join hidden using (r, c)""")
def area_explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.explored_cells(spark, sf_dir)
    return neighbourhood.area_explored(own.select("map_id", "r", "c"), own).select("r", "c", "explored")


@query(f"""with {CELLS}, {viewpoints("cells", 20)}, near as (select distinct r + a.x as r, c + b.x as c from vp, range(-6, 7) a(x), range(-6, 7) b(x)),
  asked as (select r, c, rows, cols from cells union all select r - 3, c + 3, rows, cols from cells)
  select asked.r, asked.c, not (asked.r between 0 and rows - 1 and asked.c between 0 and cols - 1) or near.r is not null as explored from asked left join near using (r, c)""")
def area_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell, and every cell shifted so that some lie off the map, with 20 viewpoints as robots."""
    own = cells(spark, sf_dir)
    asked = own.select("map_id", "r", "c").unionByName(own.select("map_id", (F.col("r") - 3).alias("r"), (F.col("c") + 3).alias("c")))
    return neighbourhood.area_visited(asked, derived.viewpoints(own, 20), own).select("r", "c", "explored")


@query(f"""with {CELLS}, free as (select r, c from cells where observed = 1),
  ranked as (select p.r, p.c, f.r as fr, f.c as fc, row_number() over (partition by p.r, p.c order by case when greatest(abs(f.r - p.r), abs(f.c - p.c)) = 0 then 0 when greatest(abs(f.r - p.r), abs(f.c - p.c)) <= 16 then 1 else 2 end, (f.r - p.r) * (f.r - p.r) + (f.c - p.c) * (f.c - p.c), f.r, f.c) as n
    from cells p join free f on f.r between p.r - 32 and p.r + 32 and f.c between p.c - 32 and p.c + 32 where p.observed <> 1)
  select r, c, fr as snap_r, fc as snap_c from ranked where n = 1""")
def nearest_passable(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    points = own.where("observed <> 1").select("map_id", (F.col("r") * 100 + F.col("c")).alias("id"), "r", "c")
    return neighbourhood.nearest_passable(points, own).select("r", "c", "snap_r", "snap_c")


@query(f"""with {CELLS}, free as (select r, c from cells where observed = 1),
  ranked as (select p.r, p.c, f.r as fr, f.c as fc, row_number() over (partition by p.r, p.c order by (f.r - p.r) * (f.r - p.r) + (f.c - p.c) * (f.c - p.c), f.r, f.c) as n
    from cells p left join free f on f.r between p.r - 2 and p.r + 2 and f.c between p.c - 2 and p.c + 2)
  select r, c, coalesce(fr, r) as snap_r, coalesce(fc, c) as snap_c from ranked where n = 1""")
def path_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    points = own.select("map_id", (F.col("r") * 100 + F.col("c")).alias("id"), "r", "c")
    return neighbourhood.nearest_passable(points, own, (2,)).select("r", "c", "snap_r", "snap_c")


_POSES = "pose as (select event_id as id, (event_id % 100 + value % 1) * 0.25 + 0.0011 as x, (event_id // 100 + (value * 3) % 1) * 0.25 + 0.0011 as y, least(0.05 + (value % 7) / 100, 0.38 * 0.25) as eff from events)"


@query(f"""with {CELLS}, {_POSES}, n as (select -1 + x as d from range(3) a(x)),
  under as (select id, cast(floor(y / 0.25) as int) + a.d as r, cast(floor(x / 0.25) as int) + b.d as c, x, y, eff from pose, n a, n b),
  hit as (select id, under.r, under.c from under where pow(greatest(c * 0.25 - x, x - (c + 1) * 0.25, 0.0), 2) + pow(greatest(r * 0.25 - y, y - (r + 1) * 0.25, 0.0), 2) < eff * eff)
  select id, bool_and(coalesce(observed, 2) = 1) as clear from hit left join cells on cells.r = hit.r and cells.c = hit.c group by id""")
def footprint_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    poses = e.select(F.lit("events").alias("map_id"), F.col("event_id").alias("id"), ((F.col("event_id") % 100 + F.col("value") % 1) * 0.25 + 0.0011).alias("x"), ((F.floor(F.col("event_id") / 100) + (F.col("value") * 3) % 1) * 0.25 + 0.0011).alias("y"), (0.05 + (F.col("value") % 7) / 100).alias("radius"))
    return neighbourhood.footprint_clear(poses, cells(spark, sf_dir), 0.25).select("id", "clear")


@query(f"""with {CELLS}, free as (select r * 100 + c as id, (c + 0.5) * 0.25::double as x1, (r + 0.5) * 0.25::double as y1, (c + 2.5) * 0.25::double as x2 from cells where observed = 1),
  way as (select id, x1 + (k / 15.0::double) * (x2 - x1) as x, y1 as y from free, range(16) t(k)),
  n as (select -1 + x as d from range(3) a(x)),
  under as (select id, x, y, cast(floor(y / 0.25) as int) + a.d as r, cast(floor(x / 0.25) as int) + b.d as c from way, n a, n b),
  hit as (select id, under.r, under.c from under where pow(greatest(c * 0.25 - x, x - (c + 1) * 0.25, 0.0), 2) + pow(greatest(r * 0.25 - y, y - (r + 1) * 0.25, 0.0), 2) < 0.05 * 0.05)
  select id, bool_and(coalesce(observed, 2) = 1) as clear from hit left join cells on cells.r = hit.r and cells.c = hit.c group by id""")
def segment_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir).where("observed = 1")
    segments = own.select("map_id", (F.col("r") * 100 + F.col("c")).alias("id"), ((F.col("c") + 0.5) * 0.25).alias("x1"), ((F.col("r") + 0.5) * 0.25).alias("y1"), ((F.col("c") + 2.5) * 0.25).alias("x2"), ((F.col("r") + 0.5) * 0.25).alias("y2"), F.lit(0.05).alias("radius"))
    return neighbourhood.segment_clear(segments, cells(spark, sf_dir), 0.25).select("id", "clear")


@query(f"""with {CELLS}, step as (select x as k from range(9) a(x))
  select a.r, a.c, bool_and(coalesce(b.observed, 2) = 1) as visible from (select r, c, k from cells, step) a left join cells b on b.r = a.r + (2 * k * 3 + 8) // 16 and b.c = a.c + k group by all""")
def line_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every cell to the one 3 rows down and 8 columns on; what is off the map is seen by no one."""
    own = cells(spark, sf_dir)
    pairs = own.select("map_id", (F.col("r") * 100 + F.col("c")).alias("id"), F.col("r").alias("r1"), F.col("c").alias("c1"), (F.col("r") + 3).alias("r2"), (F.col("c") + 8).alias("c2"))
    return neighbourhood.line_of_sight(pairs, own).select(F.col("r1").alias("r"), F.col("c1").alias("c"), "visible")


@query(f"""with {CELLS}, free as (select r, c, weight from cells where observed = 1)
  select a.r, a.c, b.r as r2, b.c as c2, cast(greatest(1, (a.weight + b.weight) // 2) as int) as w from free a, free b
  where ((b.r = a.r + 1 and b.c = a.c) or (b.r = a.r and b.c = a.c + 1)) and (a.r // 8 <> b.r // 8 or a.c // 8 <> b.c // 8)""")
def tile_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.seam_edges(cells(spark, sf_dir), B).select("r", "c", "r2", "c2", "w")


COMPONENTS = f"""{FOUR}, truly as (select r, c from cells where gt = 1),
  link as (select a.r * 100 + a.c as a, b.r * 100 + b.c as b from truly a, four, truly b where b.r = a.r + dr and b.c = a.c + dc),
  label(p, l) using key (p) as (select r * 100 + c, r * 100 + c from truly union
    select q.p, q.l from (select link.b as p, min(label.l) as l from label join link on link.a = label.p group by all) q join recurring.label old on old.p = q.p where q.l < old.l),
  comp as (select cast(p // 100 as int) as r, cast(p % 100 as int) as c, cast(dense_rank() over (order by l) - 1 as int) as comp, count(*) over (partition by l) as size from label),
  largest as (select * from comp where comp = (select comp from comp order by size desc, comp limit 1))"""


@query(f"with recursive {CELLS}, {COMPONENTS} select r, c, comp, size from comp")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.components(cells(spark, sf_dir)).select("r", "c", "comp", "size")


@query(f"with recursive {CELLS}, {COMPONENTS} select r, c, comp, size from largest")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.largest_component(cells(spark, sf_dir)).select("r", "c", "comp", "size")


@query(f"with {CELLS} select count(*) filter (gt = 1) as passable from cells")
def passable_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).agg(F.count_if(F.col("gt") == 1).alias("passable"))


def _component(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    return raster.largest_component(own).join(own.select("map_id", "rows", "cols").distinct(), "map_id").select("map_id", "rows", "cols", "r", "c")


def _sectors(n: int) -> str:
    """A table `best` of the nearest cell to each of n x n centres."""
    return f"""st as materialized (select cast(greatest(1, max(rows) // {n}) as int) as sr, cast(greatest(1, max(cols) // {n}) as int) as sc from cells),
  near as (select l.r, l.c, sr, sc, l.r // sr + a.x as y, l.c // sc + b.x as x from largest l, st, (values (-2), (-1), (0), (1), (2)) a(x), (values (-2), (-1), (0), (1), (2)) b(x)),
  gap as (select y * {n} + x as sector, r, c, abs(r - (y * sr + sr // 2)) as gr, abs(c - (x * sc + sc // 2)) as gc, sr, sc from near where y between 0 and {n - 1} and x between 0 and {n - 1}),
  best as (select sector, min(((gr + gc) * 10000 + r) * 1000 + c) as m from gap where gr <= greatest(1, sr // 2) and gc <= greatest(1, sc // 2) group by 1)"""


@query(f"""with recursive {CELLS}, {COMPONENTS}, {_sectors(8)}
  select cast(sector as int) as sector, cast(m // 1000 % 10000 as int) as r, cast(m % 1000 as int) as c from best""")
def sector_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sectors(_component(spark, sf_dir), 8).select("sector", "r", "c")


@query(f"""with recursive {CELLS}, {COMPONENTS}, start as (select r, c from largest order by ((r * 100003 + c)::bigint * 7919 + 7) % 1000003, r, c limit 1),
  pick(i, r, c, far, pr, pc) as (select 0, l.r, l.c, abs(l.r - s.r) + abs(l.c - s.c), s.r, s.c from largest l, start s
    union all select i + 1, r, c, least(far, abs(r - qr) + abs(c - qc)), qr, qc from (select *, first_value(r) over (order by far desc, r, c) as qr, first_value(c) over (order by far desc, r, c) as qc from pick where i < 24))
  select distinct cast(i as int) as i, pr as r, pc as c from pick""")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.geometry(_component(spark, sf_dir), "spread", 25, 7).select("i", "r", "c")


@query(f"""with recursive {CELLS}, {COMPONENTS}
  select cast(row_number() over (order by greatest(abs(r - 50), abs(c - 50)), abs(r - 50) + abs(c - 50), r, c) - 1 as int) as i, r, c from largest qualify i < 25""")
def cluster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.nearest(_component(spark, sf_dir), 25, F.lit(50), F.lit(50)).select("i", "r", "c")


@query(f"""with recursive {CELLS}, {COMPONENTS}, {_sectors(16)}, once as (select m // 1000 % 10000 as r, m % 1000 as c, min(sector) as sector from best group by all)
  select cast(row_number() over (order by sector) - 1 as int) as i, cast(r as int) as r, cast(c as int) as c from once qualify i < 80""")
def geometry_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 80 of 16 x 16 sectors; the SQL is for maps that have as many and need no padding."""
    return sampling.geometry(_component(spark, sf_dir), "sector", 80).select("i", "r", "c")


@query(f"""with recursive {CELLS}, {COMPONENTS}, known as (select r, c from largest qualify row_number() over (order by ((r * 100003 + c)::bigint * 7919) % 1000003, r, c) <= 25),
  open as (select r, c, (r // 8) * 13 + c // 8 as tile, row_number() over (partition by (r // 8) * 13 + c // 8 order by ((r * 100003 + c)::bigint * 7919) % 1000003, r, c) as turn from largest anti join known using (r, c))
  select cast(row_number() over (order by turn, tile) - 1 as int) as i, r, c from open qualify i < 64""")
def withheld_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _component(spark, sf_dir)
    return sampling.withheld(own, 64, B, sampling.uniform(own, 25), spread=True).select("i", "r", "c")


@query(f"""with recursive {CELLS}, {COMPONENTS}
  select cast(row_number() over (order by ((r * 100003 + c)::bigint * 7919 + 42) % 1000003, r, c) - 1 as int) as i, r, c from largest qualify i < 50""")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(_component(spark, sf_dir), 50, 42).select("i", "r", "c")
