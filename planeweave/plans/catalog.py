"""Queries over the layers of plans/layers.py, and SQL that gives the same rows.

The SQL of overlays of rectangles counts unit cells, which shares nothing with the engine. That of triangles is the
arrangement as plain joins of everything in a group with everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.functions.exact import along, cross, crossing, pixel_hit, side
from planeweave.operators import grid, halfedges
from planeweave.plans.layers import SQL_FRAMES, SQL_RECTS, SQL_TRIANGLES, frames, rect_a, rect_b, triangles
from planeweave.plans.overlay import Overlay
from planeweave.plans.storage import materialize
from planeweave.sources import geometry as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: name of the operation: what to keep, in SQL over w, and how layer b counts.
OPS = {"union": ("w > 0", 1), "intersection": ("w > 1", 1), "symmetric_difference": ("w = 1", 1), "difference": ("w > 0", -1)}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = triangles(spark, sf_dir)
    return t.where("layer = 0"), t.where("layer = 1")


def tri_overlay(spark: SparkSession, sf_dir: str, op: str = "union") -> Overlay:
    if op == "self_union":
        return Overlay(triangles(spark, sf_dir), keys=["gid"], op=op)
    return Overlay(*_both(spark, sf_dir), keys=["gid"], op=op)


def _plain(df: DataFrame) -> DataFrame:
    """gid as a number again."""
    return df.withColumn("gid", F.col("gid.gid"))


def _long(df: DataFrame) -> DataFrame:
    """area2 as a long, which these layers never leave."""
    return df.withColumn("area2", F.col("area2").cast("long"))


# overlays of rectangles, against counts of unit cells

_CELLS = SQL_RECTS + """,
cells as (select gid, x + i as cx, y + j as cy, s from (select *, 1 as s from rect_a union all select *, {sign} as s from rect_b) r, range(0, 4) as a(i), range(0, 4) as b(j) where i < w and j < h),
depth as (select gid, cx, cy, sum(s) as w from cells group by all)"""

for _op, (_keep, _sign) in OPS.items():
    query(f"{_op}_area", "with " + _CELLS.replace("{sign}", str(_sign)) + f" select gid, cast(2 * count(*) as bigint) as area2 from depth where {_keep} group by gid")(
        lambda spark, d, op=_op: _long(Overlay(rect_a(spark, d), rect_b(spark, d), keys=["gid"], op=op).area2())
    )

_SELF = "with " + _CELLS.replace("union all select *, {sign} as s from rect_b", "")


@query("selfor_area", _SELF + " select gid, cast(2 * count(*) as bigint) as area2 from depth where w > 0 group by gid")
def selfor_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(Overlay(rect_a(spark, sf_dir), keys=["gid"], op="self_union").area2())


@query("depth_histogram", "with " + _CELLS.replace("{sign}", "1") + " select gid, cast(w as bigint) as depth, cast(2 * count(*) as bigint) as area2 from depth group by gid, w")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(Overlay(rect_a(spark, sf_dir), rect_b(spark, sf_dir), keys=["gid"]).depths()).withColumn("depth", F.col("depth").cast("long"))


@query("covered_at_least_3", "with " + _CELLS.replace("{sign}", "1") + " select gid, cast(2 * count(*) as bigint) as area2 from depth where w >= 3 group by gid")
def covered_at_least_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(Overlay(rect_a(spark, sf_dir), rect_b(spark, sf_dir), keys=["gid"], keep=lambda w: w >= 3).area2())


# the arrangement of triangles

_FLOOR = lambda n, d: f"(({n}) - ((({n}) % ({d})) + ({d})) % ({d})) // ({d})"
_DEN, _T, _U = "((x2 - x1) * (v2 - v1) - (y2 - y1) * (u2 - u1))", "((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1))", "((u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1))"
_OFF = "((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1))"


def _arrangement(sign: int = 1, source: str = SQL_TRIANGLES) -> str:
    """CTEs bag, pairs, crossing, pixels, hits, sub, edges over both layers; sign -1 turns layer 1 round."""
    turned = "select gid, case when layer = 1 then x2 else x1 end as x1, case when layer = 1 then y2 else y1 end as y1, case when layer = 1 then x1 else x2 end as x2, case when layer = 1 then y1 else y2 end as y2 from steps"
    taken = "select gid, x1, y1, x2, y2 from steps" if sign > 0 else turned
    snap = lambda a, r: f"{a} + {_FLOOR(f'2 * t * {r} + d - 1', '2 * d')}"
    return f"""{source},
directed as ({taken}),
bag as (select gid, least([x1, y1], [x2, y2]) as a, greatest([x1, y1], [x2, y2]) as b, sum(case when [x1, y1] < [x2, y2] then 1 else -1 end) as m from directed group by all),
seg as materialized (select row_number() over () as sid, gid, a[1] as x1, a[2] as y1, b[1] as x2, b[2] as y2, m from bag),
pairs as (select s.*, o.x1 as u1, o.y1 as v1, o.x2 as u2, o.y2 as v2 from seg s join seg o on s.gid = o.gid and (s.x1, s.y1, s.x2, s.y2) < (o.x1, o.y1, o.x2, o.y2)
  and s.x1 <= o.x2 and o.x1 <= s.x2 and least(s.y1, s.y2) <= greatest(o.y1, o.y2) and least(o.y1, o.y2) <= greatest(s.y1, s.y2)),
terms as (select gid, x1, y1, x2, y2, u1, v1, u2, v2, abs({_DEN}) as d, {_T} * sign({_DEN})::int as t, {_U} * sign({_DEN})::int as u from pairs),
crossing as (select gid, x1, y1, x2, y2, u1, v1, u2, v2, {snap('x1', '(x2 - x1)')} as x, {snap('y1', '(y2 - y1)')} as y from terms where d > 0 and t > 0 and t < d and u > 0 and u < d),
pixels as (select gid, x1 as x, y1 as y from seg union select gid, x2, y2 from seg union select gid, x, y from crossing),
hits as (select s.*, x, y from seg s join pixels p on s.gid = p.gid and x between x1 - 1 and x2 + 1 and y between least(y1, y2) - 1 and greatest(y1, y2) + 1
  where (case when x2 >= x1 and y2 >= y1 then 2 * ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) + abs(x2 - x1) + abs(y2 - y1) >= 0 else 2 * ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) + abs(x2 - x1) + abs(y2 - y1) > 0 end)
  and (case when x2 <= x1 and y2 <= y1 then 2 * ((x2 - x) * (x2 - x1) + (y2 - y) * (y2 - y1)) + abs(x2 - x1) + abs(y2 - y1) >= 0 else 2 * ((x2 - x) * (x2 - x1) + (y2 - y) * (y2 - y1)) + abs(x2 - x1) + abs(y2 - y1) > 0 end)
  and (case when ({_OFF} >= 0 and x2 >= x1 and y2 <= y1) or ({_OFF} < 0 and x2 <= x1 and y2 >= y1) then 2 * abs({_OFF}) <= abs(x2 - x1) + abs(y2 - y1) else 2 * abs({_OFF}) < abs(x2 - x1) + abs(y2 - y1) end)),
sub as (select gid, x as sx, y as sy, lead(x) over w as ex, lead(y) over w as ey, m from hits window w as (partition by sid order by x * sign(x2 - x1)::int + y * sign(y2 - y1)::int) qualify ex is not null),
net as (select gid, least([sx, sy], [ex, ey]) as a, greatest([sx, sy], [ex, ey]) as b, sum(case when [sx, sy] < [ex, ey] then m else -m end) as m from sub group by all having sum(case when [sx, sy] < [ex, ey] then m else -m end) <> 0),
edges as materialized (select gid, case when m > 0 then a[1] else b[1] end as sx, case when m > 0 then a[2] else b[2] end as sy, case when m > 0 then b[1] else a[1] end as ex, case when m > 0 then b[2] else a[2] end as ey, cast(abs(m) as bigint) as power from net)"""


#: Right and left winding numbers, by a ray from each edge's midpoint against every edge of its group.
_WINDING = """,
faces as (select e.gid, e.sx, e.sy, e.ex, e.ey, e.power,
  coalesce(sum(case when e.sy <> e.ey then case when f.sy <> f.ey and 2 * least(f.sy, f.ey) <= e.sy + e.ey and e.sy + e.ey < 2 * greatest(f.sy, f.ey)
      and (e.sx + e.ex - 2 * f.sx) * (f.ey - f.sy) * sign(f.ey - f.sy)::int > (e.sy + e.ey - 2 * f.sy) * (f.ex - f.sx) * sign(f.ey - f.sy)::int then f.power * sign(f.ey - f.sy)::int else 0 end
    else case when f.sx <> f.ex and 2 * least(f.sx, f.ex) <= e.sx + e.ex and e.sx + e.ex < 2 * greatest(f.sx, f.ex)
      and (e.sy + e.ey - 2 * f.sy) * (f.ex - f.sx) * sign(f.ex - f.sx)::int > (e.sx + e.ex - 2 * f.sx) * (f.ey - f.sy) * sign(f.ex - f.sx)::int then f.power * sign(f.sx - f.ex)::int else 0 end end), 0)
  + case when e.sy < e.ey or (e.sy = e.ey and e.ex < e.sx) then e.power else 0 end as w_right
  from edges e left join edges f on e.gid = f.gid and (f.sx, f.sy, f.ex, f.ey) <> (e.sx, e.sy, e.ex, e.ey) group by e.gid, e.sx, e.sy, e.ex, e.ey, e.power)"""


def _bounded(keep: str) -> str:
    right, left = keep.replace("w ", "w_right "), keep.replace("w ", "(w_right - power) ")
    turn = lambda a, b: f"case when {right} then {a} else {b} end as {a}"
    return f""",
bound as materialized (select gid, {turn('sx', 'ex')}, {turn('sy', 'ey')}, {turn('ex', 'sx')}, {turn('ey', 'sy')} from faces where ({right}) <> ({left}))"""


def _sql(tail: str, keep: str | None = None, sign: int = 1, source: str = SQL_TRIANGLES) -> str:
    return "with recursive " + _arrangement(sign, source) + (_WINDING + _bounded(keep) if keep else "") + tail


_AREA = " select gid, cast(sum(ex * sy - sx * ey) as bigint) as area2 from bound group by gid having sum(ex * sy - sx * ey) <> 0"
for _op, (_keep, _sign) in OPS.items():
    query(f"tri_{_op}_area", _sql(_AREA, _keep, _sign))(lambda spark, d, op=_op: _long(tri_overlay(spark, d, op).area2()))
query("tri_selfor_area", _sql(_AREA, "w > 0"))(lambda spark, d: _long(tri_overlay(spark, d, "self_union").area2()))


@query("overlay_edges", _sql(" select gid, sx, sy, ex, ey from bound", "w > 0"))
def overlay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).boundary)


@query("segment_intersections", _sql(" select distinct gid, x1, y1, x2, y2, u1, v1, u2, v2, x, y from crossing"))
def segment_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tri_overlay(spark, sf_dir).ask("crossings")
    return _plain(found).withColumnsRenamed({"o_x1": "u1", "o_y1": "v1", "o_x2": "u2", "o_y2": "v2"})


@query("hot_pixels", _sql(" select gid, x, y from pixels"))
def hot_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("pixels"))


@query("pixel_hits", _sql(" select gid, x1, y1, x2, y2, x, y from hits"))
def pixel_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("hits")).drop("m")


@query("sub_edges", _sql(" select gid, sx, sy, ex, ey, cast(m as bigint) as m from sub"))
def sub_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("sub_edges"))


@query("edge_power", _sql(" select * from edges"))
def edge_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).edges)


_DEGREES = """,
degree as (select gid, x, y, cast(sum(o) as bigint) as n_out, cast(sum(1 - o) as bigint) as n_in, cast(sum(o * power) as bigint) as p_out, cast(sum((1 - o) * power) as bigint) as p_in
  from (select gid, sx as x, sy as y, 1 as o, power from edges union all select gid, ex, ey, 0, power from edges) group by all)"""


@query("vertex_degrees", _sql(_DEGREES + " select * from degree"))
def vertex_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("degrees"))


@query("vertex_balance", _sql(_DEGREES + " select gid, count(*) as vertices, count(*) filter (p_out <> p_in) as unbalanced from degree group by gid"))
def vertex_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _plain(tri_overlay(spark, sf_dir).ask("degrees"))
    return at.groupBy("gid").agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("p_out") != F.col("p_in")).alias("unbalanced"))


@query("chain_end_vertices", _sql(_DEGREES + " select * from degree where not (n_out = 1 and n_in = 1 and p_out = p_in)"))
def chain_end_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("degrees")).where(halfedges.CHAIN_END)


_INNER = _DEGREES + """,
ending as (select gid, x, y from degree where not (n_out = 1 and n_in = 1 and p_out = p_in)),
walk(gid, fx, fy, x, y, px, py, n, power) as (select e.gid, sx, sy, ex, ey, sx, sy, 2, power from edges e join ending v on v.gid = e.gid and v.x = sx and v.y = sy
  union all select w.gid, w.fx, w.fy, e.ex, e.ey, e.sx, e.sy, n + 1, w.power from walk w join edges e on e.gid = w.gid and e.sx = w.x and e.sy = w.y
  where not exists (select 1 from ending v where v.gid = w.gid and v.x = w.x and v.y = w.y))
select w.gid, fx, fy, w.x as lx, w.y as ly, cast(n as bigint) as n_points, power from walk w join ending v on v.gid = w.gid and v.x = w.x and v.y = w.y"""


@query("chains", _sql(_INNER))
def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open chains; closed ones have a query of their own."""
    found = _plain(tri_overlay(spark, sf_dir).ask("chains")).where("not closed")
    end = lambda i, c: F.element_at("path", i)[c]
    return found.select("gid", end(1, "x").alias("fx"), end(1, "y").alias("fy"), end(-1, "x").alias("lx"), end(-1, "y").alias("ly"), F.size("path").cast("long").alias("n_points"), "power")


@query("closed_chains", _sql(_DEGREES + """,
mid as (select gid, x, y from degree where n_out = 1 and n_in = 1 and p_out = p_in),
round(gid, fx, fy, x, y, n) as (select e.gid, sx, sy, ex, ey, 2 from edges e join mid v on v.gid = e.gid and v.x = sx and v.y = sy where (ex, ey) > (sx, sy)
  union all select r.gid, r.fx, r.fy, e.ex, e.ey, n + 1 from round r join mid v on v.gid = r.gid and v.x = r.x and v.y = r.y join edges e on e.gid = r.gid and e.sx = r.x and e.sy = r.y
  where (e.ex, e.ey) >= (r.fx, r.fy) and (r.x, r.y) <> (r.fx, r.fy))
select gid, fx, fy, cast(n as bigint) as n_points from round where (x, y) = (fx, fy)"""))
def closed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles without a chain end, from their least vertex."""
    found = _plain(tri_overlay(spark, sf_dir).ask("chains")).where("closed")
    return found.select("gid", F.col("path")[0]["x"].alias("fx"), F.col("path")[0]["y"].alias("fy"), F.size("path").cast("long").alias("n_points"))


_COMPONENTS = """,
link as (select gid, [sx, sy] as a, [ex, ey] as b from edges union select gid, [ex, ey], [sx, sy] from edges),
reach(gid, a, root) as (select gid, a, a from link union select l.gid, l.b, r.root from reach r join link l on l.gid = r.gid and l.a = r.a where r.root < l.b),
rooted as (select gid, a, least(a, min(root)) as root from reach group by gid, a)"""


@query("components", _sql(_COMPONENTS + " select gid, a[1] as x, a[2] as y, root[1] as cx, root[2] as cy, dense_rank() over (partition by gid order by root) - 1 as component, count(*) over (partition by gid, root) as size from rooted"))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("components"))


@query("component_sizes", _sql(_COMPONENTS + " select gid, count(distinct root) as n_components, max(n) as largest from (select gid, root, count(*) over (partition by gid, root) as n from rooted) group by gid"))
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _plain(tri_overlay(spark, sf_dir).ask("components"))
    return found.groupBy("gid").agg((F.max("component") + 1).alias("n_components"), F.max("size").alias("largest"))


_RAY = """,
point as (select distinct gid, root[1] as x, root[2] as y from rooted),
met as (select p.gid, p.x, p.y, e.sx, e.sy, e.ex, e.ey, e.sx + (p.y - e.sy) * (e.ex - e.sx) / (e.ey - e.sy) as hit_x, (e.ex - e.sx) / (e.ey - e.sy) as lean from point p join edges e on e.gid = p.gid and e.sy <> e.ey and least(e.sy, e.ey) <= p.y and p.y < greatest(e.sy, e.ey)
  and (p.x - e.sx) * (e.ey - e.sy) * sign(e.ey - e.sy)::int > (p.y - e.sy) * (e.ex - e.sx) * sign(e.ey - e.sy)::int)
select p.gid, p.x, p.y, sx as near_sx, sy as near_sy, ex as near_ex, ey as near_ey from point p left join
  (select * from met qualify row_number() over (partition by gid, x, y order by hit_x desc, lean desc) = 1) using (gid, x, y)"""


@query("component_rays", _sql(_COMPONENTS + _RAY))
def component_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("component_rays"))


_SPOKES = """,
spoke as (select gid, sx as vx, sy as vy, ex - sx as dx, ey - sy as dy, true as forward from {edges} union all select gid, ex, ey, sx - ex, sy - ey, false from {edges}),
placed as (select *, row_number() over w - 1 as place, lead(dx) over w as ndx, lead(dy) over w as ndy, first(dx) over w as fdx, first(dy) over w as fdy from spoke
  window w as (partition by gid, vx, vy order by case when dy = 0 and dx < 0 then -pi() else atan2(dy, dx) end))"""


@query("angular_order", _sql(_SPOKES.format(edges="edges") + " select gid, vx, vy, cast(place as integer) as place, dx, dy, forward from placed"))
def angular_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("angular_order"))


@query("next_half_edge", _sql(_SPOKES.format(edges="edges") + " select gid, vx + dx as sx, vy + dy as sy, vx as ex, vy as ey, vx + coalesce(ndx, fdx) as nx, vy + coalesce(ndy, fdy) as ny from placed"))
def next_half_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tri_overlay(spark, sf_dir).ask("next_half_edges"))


@query("half_edge_winding", _sql(_WINDING + " select gid, sx, sy, ex, ey, cast(w_right as bigint) as w from faces union all select gid, ex, ey, sx, sy, cast(w_right - power as bigint) from faces"))
def half_edge_winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(halfedges.half_edge_winding(tri_overlay(spark, sf_dir).faces))


_RINGS = _SPOKES.format(edges="bound") + """,
follow as materialized (select gid, vx + dx as sx, vy + dy as sy, vx as ex, vy as ey, vx + coalesce(ndx, fdx) as nx, vy + coalesce(ndy, fdy) as ny from placed where not forward),
tour(gid, f, sx, sy, ex, ey, n, area2) as (select gid, [sx, sy, ex, ey], sx, sy, ex, ey, 1, ex * sy - sx * ey from follow
  union all select t.gid, t.f, f.ex, f.ey, f.nx, f.ny, n + 1, area2 + f.nx * f.ey - f.ex * f.ny from tour t join follow f on f.gid = t.gid and f.sx = t.sx and f.sy = t.sy and f.ex = t.ex and f.ey = t.ey
  where [f.ex, f.ey, f.nx, f.ny] > t.f),
ring as (select t.gid, t.f, t.n, t.area2 from tour t join follow f on f.gid = t.gid and f.sx = t.sx and f.sy = t.sy and f.ex = t.ex and f.ey = t.ey where [f.ex, f.ey, f.nx, f.ny] = t.f)"""


@query("ring_areas", _sql(_RINGS + " select gid, f[1] as rx, f[2] as ry, cast(n + 1 as bigint) as n_points, cast(area2 as bigint) as area2 from ring", "w > 0"))
def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _plain(tri_overlay(spark, sf_dir).ask("rings"))
    return found.select("gid", "rx", "ry", F.size("ring").cast("long").alias("n_points"), F.col("area2").cast("long").alias("area2"))


@query("polygon_ring_counts", _sql(_RINGS + " select gid, count(*) filter (area2 > 0) as n_polygons, count(*) filter (area2 < 0) as n_holes, cast(sum(area2) as bigint) as area2 from ring group by gid", "w > 0"))
def polygon_ring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tri_overlay(spark, sf_dir).polygons()
    holes = F.aggregate("geometry", F.lit(0).cast("long"), lambda t, p: t + F.size(p["inner_rings"]))
    return found.select("gid", F.size("geometry").cast("long").alias("n_polygons"), holes.alias("n_holes"), G.area2(F.col("geometry")).cast("long").alias("area2"))


# whole geometries: every ring's points, and which hole lies in which polygon

_POLYGONS = _RINGS.replace("select gid, [sx, sy, ex, ey], sx", "select gid, [sx, sy, ex, ey], [[sx, sy], [ex, ey]], sx").replace("tour(gid, f,", "tour(gid, f, points,").replace(
    "select t.gid, t.f, f.ex", "select t.gid, t.f, list_append(points, [f.nx, f.ny]), f.ex").replace("select t.gid, t.f, t.n", "select t.gid, t.f, t.points, t.n").replace("\nring as", "\nloop as") + """,
piece as (select gid, f, unnest(points[:-2]) as a, unnest(points[2:]) as b from loop),
looked as (select h.gid, h.f as hole, e.f as onto, e.a[1] + (h.f[2] - e.a[2]) * (e.b[1] - e.a[1]) / (e.b[2] - e.a[2]) as hit_x, (e.b[1] - e.a[1]) / (e.b[2] - e.a[2]) as lean from loop h join piece e on e.gid = h.gid and h.area2 < 0
  and e.a[2] <> e.b[2] and least(e.a[2], e.b[2]) <= h.f[2] and h.f[2] < greatest(e.a[2], e.b[2])
  and (h.f[1] - e.a[1]) * (e.b[2] - e.a[2]) * sign(e.b[2] - e.a[2])::int > (h.f[2] - e.a[2]) * (e.b[1] - e.a[1]) * sign(e.b[2] - e.a[2])::int),
seen as (select gid, hole, onto from looked qualify row_number() over (partition by gid, hole order by hit_x desc, lean desc) = 1),
chase(gid, hole, f) as (select gid, hole, onto from seen union all select c.gid, c.hole, s.onto from chase c join seen s on s.gid = c.gid and s.hole = c.f),
said as (select gid, f, points, area2, '(' || array_to_string(list_transform(points, lambda p: p[1] || ' ' || p[2]), ',') || ')' as text from loop),
filled as (select c.gid, c.f, list(h.text order by h.points) as holes, list(h.points order by h.points) as hole_points from chase c join said o on o.gid = c.gid and o.f = c.f and o.area2 > 0 join said h on h.gid = c.gid and h.f = c.hole group by c.gid, c.f),
whole as (select o.gid, o.points, coalesce(hole_points, []) as hole_points, '(' || array_to_string(list_concat([o.text], coalesce(holes, [])), ',') || ')' as text from said o left join filled using (gid, f) where o.area2 > 0)
select gid, 'MULTIPOLYGON(' || string_agg(text, ',' order by points, hole_points) || ')' as wkt from whole group by gid"""


def frame_overlay(spark: SparkSession, sf_dir: str, op: str = "union") -> Overlay:
    rows = frames(spark, sf_dir)
    if op == "self_union":
        return Overlay(rows, keys=["gid"], op=op)
    return Overlay(rows.where("layer = 0"), rows.where("layer = 1"), keys=["gid"], op=op)


def _wkt(o: Overlay) -> DataFrame:
    return o.polygons().select("gid", G.to_wkt(F.col("geometry")).alias("wkt"))


for _op, (_keep, _sign) in (OPS | {"self_union": ("w > 0", 1)}).items():
    query(f"frame_{_op}_polygons", _sql(_POLYGONS, _keep, _sign, SQL_FRAMES))(lambda spark, d, op=_op: _wkt(frame_overlay(spark, d, op)))
query("tri_union_polygons", _sql(_POLYGONS, "w > 0"))(lambda spark, d: _wkt(tri_overlay(spark, d)))


@query("overlay_again", f"with {SQL_FRAMES} select distinct gid, true as is_valid, true as same from steps")
def overlay_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions are valid, and a union of a union is the same geometry."""
    once = materialize(frame_overlay(spark, sf_dir).polygons(), "union")
    again = Overlay(once, keys=["gid"])
    twice = again.polygons().withColumnRenamed("geometry", "other")
    return once.join(twice, "gid").join(again.validity(), "gid").select("gid", "is_valid", G.same_geometry(F.col("geometry"), F.col("other")).alias("same"))


# scalars, ingest and the grid


@query("ring_segments", f"with {SQL_TRIANGLES} select gid, id, cast(i as integer) as i, x1, y1, x2, y2 from steps")
def ring_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triangles(spark, sf_dir).select("gid", "id", F.posexplode(G.ring_segments(F.col("ring"))).alias("i", "s"))
    return rows.select("gid", "id", "i", "s.*")


_WKT_RING = lambda order: "'MULTIPOLYGON(((' || " + " || ',' || ".join(f"ring[{i}].x || ' ' || ring[{i}].y" for i in order) + " || ')))'"


@query("ring_close", f"with {SQL_TRIANGLES} select id, {_WKT_RING((1, 2, 3, 1))} as wkt from tri")
def ring_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles(spark, sf_dir).select("id", G.to_wkt(F.col("geometry")).alias("wkt"))


@query("ring_reverse", f"with {SQL_TRIANGLES} select id, {_WKT_RING((1, 3, 2, 1))} as wkt from tri")
def ring_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.transform("geometry", lambda p: F.struct(G.reversed_ring(p["outer_ring"]).alias("outer_ring"), p["inner_rings"].alias("inner_rings")))
    return triangles(spark, sf_dir).select("id", G.to_wkt(back).alias("wkt"))


@query("wkt_roundtrip", f"with {SQL_RECTS} select id, 'MULTIPOLYGON(((' || x || ' ' || y || ',' || x || ' ' || y + h || ',' || x + w || ' ' || y + h || ',' || x + w || ' ' || y || ',' || x || ' ' || y || ')))' as wkt, 2 * w * h as area2 from rect_a")
def wkt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a generator of one row, so that the optimizer doesn't write the parsing out at every use
    back = rect_a(spark, sf_dir).select("id", F.explode(F.array(G.from_wkt(G.to_wkt(F.col("geometry"))))).alias("back"))
    return back.select("id", G.to_wkt(F.col("back")).alias("wkt"), G.area2(F.col("back")).cast("long").alias("area2"))


@query("segment_bbox", f"with {SQL_TRIANGLES} select id, cast(i as integer) as i, least(x1, x2) as xmin, least(y1, y2) as ymin, greatest(x1, x2) as xmax, greatest(y1, y2) as ymax from steps")
def segment_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ring_segments(spark, sf_dir)
    return s.select("id", "i", *[c.alias(n) for n, c in G.envelope(*map(F.col, ("x1", "y1", "x2", "y2"))).items()])


@query("segment_scalars", f"""with {SQL_TRIANGLES}, a as (select a.id, a.i, a.x1, a.y1, a.x2, a.y2, b.x1 as u1, b.y1 as v1, b.x2 as u2, b.y2 as v2, a.x1 + a.id % 9 as x, a.y1 + a.id % 11 as y from steps a join steps b on a.gid = b.gid and a.i = b.i and b.id = a.id + 1),
t as (select *, abs({_DEN}) as d, {_T} * sign({_DEN})::int as t, {_U} * sign({_DEN})::int as u from a)
select id, cast(i as integer) as i, cast({_DEN} as bigint) as turn, cast(x * sign(x2 - x1)::int + y * sign(y2 - y1)::int as bigint) as along, cast(sign((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) as integer) as side,
  case when d > 0 and t > 0 and t < d and u > 0 and u < d then cast(x1 + {_FLOOR('2 * t * (x2 - x1) + d - 1', '2 * d')} as bigint) end as cross_x,
  (case when x2 >= x1 and y2 >= y1 then 2 * ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) + abs(x2 - x1) + abs(y2 - y1) >= 0 else 2 * ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) + abs(x2 - x1) + abs(y2 - y1) > 0 end)
  and (case when x2 <= x1 and y2 <= y1 then 2 * ((x2 - x) * (x2 - x1) + (y2 - y) * (y2 - y1)) + abs(x2 - x1) + abs(y2 - y1) >= 0 else 2 * ((x2 - x) * (x2 - x1) + (y2 - y) * (y2 - y1)) + abs(x2 - x1) + abs(y2 - y1) > 0 end)
  and (case when ({_OFF} >= 0 and x2 >= x1 and y2 <= y1) or ({_OFF} < 0 and x2 <= x1 and y2 >= y1) then 2 * abs({_OFF}) <= abs(x2 - x1) + abs(y2 - y1) else 2 * abs({_OFF}) < abs(x2 - x1) + abs(y2 - y1) end) as hit from t""")
def segment_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment with the like one of the next triangle of its group, and with a point near it."""
    s = ring_segments(spark, sf_dir)
    o = s.select("gid", "i", (F.col("id") - 1).alias("id"), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"))
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    x, y = F.col("x1") + F.col("id") % 9, F.col("y1") + F.col("id") % 11
    return s.join(o, ["gid", "i", "id"]).select(
        "id", "i", cross(c[2] - c[0], c[3] - c[1], F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")).alias("turn"),
        along(x, y, c[2] - c[0], c[3] - c[1]).alias("along"), side(x, y, *c).alias("side"),
        crossing(*c, F.col("u1"), F.col("v1"), F.col("u2"), F.col("v2"))["x"].alias("cross_x"), pixel_hit(x, y, *c).alias("hit"),
    )


def _boxes(layer: DataFrame) -> DataFrame:
    return layer.select("gid", "id", F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("h")).alias("ymax"))


@query("bbox_overlap_pairs", f"with {SQL_RECTS} select a.gid, a.id as query_id, b.id as item_id from rect_a a join rect_b b on a.gid = b.gid and a.x <= b.x + b.w and b.x <= a.x + a.w and a.y <= b.y + b.h and b.y <= a.y + a.h")
def bbox_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _boxes(rect_b(spark, sf_dir))
    return grid.overlapping(_boxes(rect_a(spark, sf_dir)), items, grid.cell_size(items))


@query("grid_cell_counts", f"with {SQL_RECTS} select gid, cx, cy, count(*) as n from rect_a, unnest(range(x // 8, (x + w) // 8 + 1)) as a(cx), unnest(range(y // 8, (y + h) // 8 + 1)) as b(cy) group by all")
def grid_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_cells(_boxes(rect_a(spark, sf_dir)), 8).groupBy("gid", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query("grid_ray_left", f"with {SQL_RECTS} select a.gid, a.id as point_id, count(*) as n from rect_a a join rect_b b on a.gid = b.gid and b.y <= a.y and a.y <= b.y + b.h and b.x <= a.x group by all")
def grid_ray_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.left_of(rect_a(spark, sf_dir).select("gid", "id", "x", "y"), _boxes(rect_b(spark, sf_dir)), 8)
    return found.groupBy("gid", "point_id").agg(F.count(F.lit(1)).alias("n"))

