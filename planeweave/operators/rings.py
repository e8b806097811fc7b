"""Boundary edges to rings, faces and polygons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.functions.exact import counter_clockwise, floor_div, ratio_order, wide
from planeweave.operators.graph import connected_components
from planeweave.plans.storage import materialize
from planeweave.sources.geometry import ring_area2

EDGE = ["sx", "sy", "ex", "ey"]


def spokes(edges: DataFrame) -> DataFrame:
    """(gid, vx, vy, spokes): what leaves each vertex, counter-clockwise from -x; out tells edges that start there."""
    ends = F.array(
        F.struct(F.col("sx").alias("vx"), F.col("sy").alias("vy"), (F.col("ex") - F.col("sx")).alias("dx"), (F.col("ey") - F.col("sy")).alias("dy"), F.lit(True).alias("out")),
        F.struct(F.col("ex").alias("vx"), F.col("ey").alias("vy"), (F.col("sx") - F.col("ex")).alias("dx"), (F.col("sy") - F.col("ey")).alias("dy"), F.lit(False).alias("out")),
    )
    rows = edges.select("gid", F.explode(ends).alias("s")).groupBy("gid", "s.vx", "s.vy").agg(F.collect_list(F.struct("s.dx", "s.dy", "s.out")).alias("spokes"))
    return rows.withColumn("spokes", F.array_sort("spokes", counter_clockwise))


def successors(edges: DataFrame) -> DataFrame:
    """(gid, sx, sy, ex, ey, nx, ny): after each boundary edge comes the next edge out, counter-clockwise from its back."""
    at = spokes(edges).select("gid", "vx", "vy", "spokes", F.posexplode("spokes").alias("i", "s")).where("not s.out")
    following = F.col("spokes")[F.pmod(F.col("i") + 1, F.size("spokes"))]
    return at.select("gid", (F.col("vx") + F.col("s.dx")).alias("sx"), (F.col("vy") + F.col("s.dy")).alias("sy"), F.col("vx").alias("ex"), F.col("vy").alias("ey"), (F.col("vx") + following["dx"]).alias("nx"), (F.col("vy") + following["dy"]).alias("ny"))


def _in_order(edges: pd.Series) -> pd.Series:
    """Closed rings from lists of sx, sy, ex, ey, nx, ny, each from its least edge."""
    out = []
    for ring in edges:
        follows = {tuple(e[:4]): tuple(e[2:]) for e in map(list, ring)}
        first = e = min(follows)
        points = []
        while True:
            points.append({"x": int(e[0]), "y": int(e[1])})
            e = follows[e]
            if e == first:
                break
        out.append([*points, points[0]])
    return pd.Series(out, dtype=object)


def trace(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings (gid, rx, ry, rex, rey, area2, ring) and the ring of every edge (gid, sx, sy, ex, ey, rx, ry, rex, rey).

    A ring is named by its least edge. Which edges belong together comes from components over the successors, whatever a
    ring's length; only the order of one ring's own points is made in one task, as its row holds them all anyway.
    area2 is twice the area, positive for outer (clockwise) rings.
    """
    follow = materialize(successors(edges), "successors")
    node = lambda a, b, c, d: F.struct("gid", F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), F.col(d).alias("d"))
    labels = connected_components(follow.select(node(*EDGE).alias("src"), node("ex", "ey", "nx", "ny").alias("dst")))
    own = labels.select("node.gid", F.col("node.a").alias("sx"), F.col("node.b").alias("sy"), F.col("node.c").alias("ex"), F.col("node.d").alias("ey"), F.col("component.a").alias("rx"), F.col("component.b").alias("ry"), F.col("component.c").alias("rex"), F.col("component.d").alias("rey"))
    own = materialize(own, "ring-edges")
    held = follow.join(own, ["gid", *EDGE]).groupBy("gid", "rx", "ry", "rex", "rey").agg(F.collect_list(F.array(*EDGE, "nx", "ny")).alias("edges"))
    rings = held.select("gid", "rx", "ry", "rex", "rey", F.pandas_udf(_in_order, "array<struct<x:int,y:int>>")("edges").alias("ring"))
    rings = rings.select("gid", "rx", "ry", "rex", "rey", ring_area2(F.col("ring")).alias("area2"), "ring")
    return materialize(rings, "rings"), own


def ray_nearest(points: DataFrame, edges: DataFrame, band: int, tags: list[str], needs_wide: bool = False) -> DataFrame:
    """points (gid, x, y, ...) with the tags (as near_*) of the edge that a ray to -x meets first, null if none.

    An edge from y1 to y2 > y1 counts for y1 <= y < y2 where it lies strictly left of the point. Of edges that leave one
    vertex at the point's height upward, the rightmost one is met first. All comparisons are exact.
    """
    up = F.col("sy") < F.col("ey")
    lo = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    upward = edges.where("sy <> ey").select("gid", lo("sx", "ex").alias("ax"), lo("sy", "ey").alias("ay"), lo("ex", "sx").alias("bx"), lo("ey", "sy").alias("by"), *[F.col(t).alias(f"near_{t}") for t in tags])
    upward = upward.withColumn("band", F.explode(F.sequence(F.floor(F.col("ay") / band), F.floor((F.col("by") - 1) / band))))
    asked = points.withColumn("band", F.floor(F.col("y") / band)).withColumn("__ask", F.struct(*points.columns))
    c = lambda n: wide(F.col(n).cast("long"), needs_wide)
    left = (c("x") - c("ax")) * (c("by") - c("ay")) > (c("y") - c("ay")) * (c("bx") - c("ax"))
    met = asked.join(upward, ["gid", "band"]).where((F.col("ay") <= F.col("y")) & (F.col("y") < F.col("by")) & left)
    # where the edge is at the point's height: the whole part, then the rest as a fraction; then how the edge leans
    num, den = (c("y") - c("ay")) * (c("bx") - c("ax")), F.col("by") - F.col("ay")
    order = F.struct(F.col("ax") + floor_div(num, c("by") - c("ay")), ratio_order(F.pmod(num, c("by") - c("ay")).cast("long"), den, needs_wide), ratio_order(F.col("bx") - F.col("ax"), den, needs_wide))
    best = met.groupBy("__ask").agg(F.max_by(F.struct(*[f"near_{t}" for t in tags]), order).alias("near"))
    return asked.select("__ask").join(best, "__ask", "left").select(*[F.col(f"__ask.{c}").alias(c) for c in points.columns], *[F.col(f"near.near_{t}").alias(f"near_{t}") for t in tags])


def polygons(edges: DataFrame, band: int = 64, needs_wide: bool = False) -> DataFrame:
    """(gid, geometry): the polygons that boundary edges enclose; a group without edges has no row.

    Each hole's leftmost vertex looks to -x; the ring it sees bounds the same face, and faces are the components of that.
    A face without exactly one outer ring is an error.
    """
    rings, own = trace(edges)
    name = ["rx", "ry", "rex", "rey"]
    ring_id = lambda p="": F.struct("gid", *[F.col(p + n).alias(n) for n in name])
    holes = rings.where("area2 < 0").select("gid", *name, F.expr("array_min(ring)").alias("p")).select("gid", *name, F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))
    seen = ray_nearest(holes, own, band, name, needs_wide).where("near_rx is not null")
    faces = connected_components(seen.select(ring_id().alias("src"), ring_id("near_").alias("dst")))
    named = rings.withColumn("node", ring_id()).join(faces, "node", "left").withColumn("face", F.coalesce("component", "node"))
    outer = F.max(F.when(F.col("area2") > 0, F.col("ring")))
    inner = F.array_sort(F.collect_list(F.when(F.col("area2") < 0, F.col("ring"))))
    one = named.groupBy("gid", "face").agg(outer.alias("outer_ring"), inner.alias("inner_rings"), F.count_if(F.col("area2") > 0).alias("outers"))
    one = one.withColumn("outer_ring", F.when(F.col("outers") == 1, F.col("outer_ring")).otherwise(F.raise_error(F.lit("a face without exactly one outer ring"))))
    return one.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("outer_ring", "inner_rings"))).alias("geometry"))
