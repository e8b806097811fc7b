"""The graph of planar edges: degrees, components, chains, half edges and what follows them.

Edges are (gid, sx, sy, ex, ey, power), each with a positive power; a vertex is named by its group and coordinates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planeweave.operators.graph import connected_components
from planeweave.operators.rings import EDGE, ray_nearest, spokes
from planeweave.plans.storage import materialize


#: Of the rows of degrees(), those where chains end: all but those with one edge in, one out, and equal power.
CHAIN_END = "not (n_out = 1 and n_in = 1 and p_out = p_in)"


def degrees(edges: DataFrame) -> DataFrame:
    """(gid, x, y, n_out, n_in, p_out, p_in): edges and power that leave and enter each vertex."""
    ends = F.array(
        F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    rows = edges.select("gid", F.explode(ends).alias("v"), "power")
    total = lambda c: F.sum(c).cast("long")
    return rows.groupBy("gid", "v.x", "v.y").agg(total("v.o").alias("n_out"), total("v.i").alias("n_in"), total(F.col("v.o") * F.col("power")).alias("p_out"), total(F.col("v.i") * F.col("power")).alias("p_in"))


def chain_ends(edges: DataFrame) -> DataFrame:
    """The rows of degrees() where chains end: all but those with one edge in, one out, and equal power."""
    return degrees(edges).where(CHAIN_END)


def vertex_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(gid, x, y, cx, cy, component, size) of each vertex.

    (cx, cy) is the leftmost vertex of its component, the lowest of those; component numbers a group's components from 0
    in the order of these vertices. vertices (gid, x, y) may name more than the edges do: isolated ones are components.
    """
    node = lambda x, y: F.struct("gid", F.col(x).alias("x"), F.col(y).alias("y"))
    linked = connected_components(edges.select(node("sx", "sy").alias("src"), node("ex", "ey").alias("dst")))
    rows = linked.select("node.gid", "node.x", "node.y", F.col("component.x").alias("cx"), F.col("component.y").alias("cy"))
    if vertices is not None:
        rows = vertices.select("gid", "x", "y").distinct().join(rows, ["gid", "x", "y"], "left")
        rows = rows.select("gid", "x", "y", F.coalesce("cx", "x").alias("cx"), F.coalesce("cy", "y").alias("cy"))
    sizes = rows.groupBy("gid", "cx", "cy").agg(F.count(F.lit(1)).alias("size"))
    numbered = sizes.withColumn("component", F.row_number().over(W.partitionBy("gid").orderBy("cx", "cy")).cast("long") - 1)
    return rows.join(numbered, ["gid", "cx", "cy"]).select("gid", "x", "y", "cx", "cy", "component", "size")


def _walked(edges: pd.Series) -> pd.DataFrame:
    """Chains in order from lists of sx, sy, ex, ey, whether the edge starts at a chain end."""
    closed, paths = [], []
    for chain in edges:
        ahead = {(e[0], e[1]): (e[2], e[3]) for e in chain}
        ends = [(e[0], e[1]) for e in chain if e[4]]
        at = start = ends[0] if ends else min(ahead)
        path = [start]
        while True:
            at = ahead[at]
            path.append(at)
            if at == start or at not in ahead:
                break
        closed.append(not ends)
        paths.append([{"x": int(x), "y": int(y)} for x, y in path])
    return pd.DataFrame({"closed": closed, "path": paths})


def chains(edges: DataFrame) -> DataFrame:
    """(gid, power, closed, path): maximal paths through vertices that are no chain ends, and cycles without such a vertex.

    A path that comes back to the chain end it left is not closed in this sense. Edges of one chain are found as
    components of edges that meet at a vertex inside a chain; the order of a chain's points is made in its own row.
    """
    edges = edges.select("gid", *EDGE, "power")
    inner = degrees(edges).where("n_out = 1 and n_in = 1 and p_out = p_in").select("gid", "x", "y")
    edge = F.struct("gid", *EDGE)
    into = edges.select("gid", F.col("ex").alias("x"), F.col("ey").alias("y"), edge.alias("src"))
    out = edges.select("gid", F.col("sx").alias("x"), F.col("sy").alias("y"), edge.alias("dst"))
    meet = into.join(inner, ["gid", "x", "y"]).join(out, ["gid", "x", "y"])
    label = connected_components(meet.select("src", "dst"))
    named = edges.withColumn("node", edge).join(label, "node", "left").withColumn("chain", F.coalesce("component", "node"))
    ends = chain_ends(edges).select("gid", F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(1).alias("end"))
    rows = named.join(ends, ["gid", "sx", "sy"], "left")
    walked = F.pandas_udf(_walked, "struct<closed:boolean,path:array<struct<x:long,y:long>>>")
    held = rows.groupBy("chain").agg(F.min("power").alias("power"), F.collect_list(F.array(*EDGE, F.coalesce("end", F.lit(0)).cast("long"))).alias("edges"))
    return held.select("chain.gid", F.col("power").cast("long").alias("power"), walked("edges").alias("w")).select("gid", "power", "w.closed", "w.path")


def half_edges(edges: DataFrame) -> DataFrame:
    """(gid, sx, sy, ex, ey, forward, power): each edge both ways; the way back has the negative power."""
    both = F.array(F.struct(*EDGE, F.lit(True).alias("forward"), F.col("power").cast("long").alias("power")), F.struct(F.col("ex").alias("sx"), F.col("ey").alias("sy"), F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.lit(False).alias("forward"), (-F.col("power")).cast("long").alias("power")))
    return edges.select("gid", F.explode(both).alias("h")).select("gid", "h.*")


def angular_order(edges: DataFrame) -> DataFrame:
    """(gid, vx, vy, place, dx, dy, forward): half edges that leave each vertex, counter-clockwise from -x, places from 0."""
    return spokes(edges).select("gid", "vx", "vy", F.posexplode("spokes").alias("place", "s")).select("gid", "vx", "vy", "place", "s.dx", "s.dy", F.col("s.out").alias("forward"))


def next_half_edges(edges: DataFrame) -> DataFrame:
    """(gid, sx, sy, ex, ey, nx, ny): after a half edge comes the one counter-clockwise from its way back: to (nx, ny)."""
    at = spokes(edges).select("gid", "vx", "vy", "spokes", F.posexplode("spokes").alias("i", "s"))
    following = F.col("spokes")[F.pmod(F.col("i") + 1, F.size("spokes"))]
    return at.select("gid", (F.col("vx") + F.col("s.dx")).alias("sx"), (F.col("vy") + F.col("s.dy")).alias("sy"), F.col("vx").alias("ex"), F.col("vy").alias("ey"), (F.col("vx") + following["dx"]).alias("nx"), (F.col("vy") + following["dy"]).alias("ny"))


def component_rays(edges: DataFrame, band: int, needs_wide: bool = False) -> DataFrame:
    """(gid, x, y, near_sx, near_sy, near_ex, near_ey): what the leftmost vertex of each component sees to -x, null if none.

    A component that sees nothing lies in the outermost face; another lies in the face right of the edge that it sees.
    """
    starts = vertex_components(edges).select("gid", F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
    return ray_nearest(materialize(starts, "leftmost"), edges, band, EDGE, needs_wide)


def half_edge_winding(faces: DataFrame) -> DataFrame:
    """(gid, sx, sy, ex, ey, w) of every half edge: the winding number of the face on its right."""
    c: Column = F.array(F.struct(*EDGE, F.col("w_right").cast("long").alias("w")), F.struct(F.col("ex").alias("sx"), F.col("ey").alias("sy"), F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("w_left").cast("long").alias("w")))
    return faces.select("gid", F.explode(c).alias("h")).select("gid", "h.*")
