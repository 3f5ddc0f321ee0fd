"""The derived tables again, as SQL fragments for the equivalent queries."""

CELLS = """cells as materialized (
  select cast(floor(event_id / 100) as int) as r, cast(event_id % 100 as int) as c,
         cast(case when event_type = 'error' then 2 else 1 end as int) as gt,
         cast(case when event_type = 'error' then 2 when event_type = 'signup' and value < 10 then 0 else 1 end as int) as observed,
         cast(cast(floor(value) as int) % 20 + 1 as int) as weight,
         cast(100 as int) as cols, cast((select max(event_id) from events) // 100 + 1 as int) as rows
  from events)"""


#: Like CELLS, with fewer obstacles and unseen squares.
EXPLORED = CELLS.replace("cells as materialized (", "event_cells as materialized (", 1) + """,
  cells as materialized (select r, c, weight, rows, cols, cast(case when gt = 2 and (r * 100 + c) % 3 = 0 then 2 else 1 end as int) as gt,
    cast(case when (r // 12 + c // 12) % 3 = 0 then 0 when gt = 2 and (r * 100 + c) % 3 = 0 then 2 else 1 end as int) as observed from event_cells)"""


def viewpoints(table: str, k: int) -> str:
    return f"""vp as (select * from (select cast(row_number() over (order by ((r * 100 + c) * 7919) % 10007, r, c) - 1 as int) as i, r, c from {table} where observed = 1) where i < {k})"""


#: The four neighbours and the 24 cells of the 5 x 5 square around a cell.
FOUR = "four(dr, dc) as (values (-1, 0), (1, 0), (0, -1), (0, 1))"
SQUARE = "sq(dr, dc) as (select a.x, b.x from (values (-2), (-1), (0), (1), (2)) a(x), (values (-2), (-1), (0), (1), (2)) b(x) where a.x <> 0 or b.x <> 0)"


def distances(table: str, sources: str, weighted: bool) -> str:
    """A recursive `dist(s, r, c, d)`: from each row (i, r, c) of `sources` to every cell of `table` that it reaches."""
    step = "greatest(1, (f.weight + n.weight) // 2)" if weighted else "1"
    return f"""free as (select r, c, weight from {table} where observed = 1),
  edge as (select f.r, f.c, n.r as nr, n.c as nc, {step} as w from free f, four, free n where n.r = f.r + dr and n.c = f.c + dc),
  dist(s, r, c, d) using key (s, r, c) as (
    select s.i, s.r, s.c, 0 from {sources} s join free f on f.r = s.r and f.c = s.c
    union
    select q.s, q.nr, q.nc, q.d from (
      select dist.s, e.nr, e.nc, min(dist.d + e.w) as d from dist join edge e on e.r = dist.r and e.c = dist.c group by all) q
    left join recurring.dist old on old.s = q.s and old.r = q.nr and old.c = q.nc
    where old.d is null or q.d < old.d)"""
