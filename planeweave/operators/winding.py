"""Winding numbers on both sides of planar edges, without walking the graph.

A row of cells starts half a unit below its lowest grid line, so that no vertex lies there. The winding number at a cell's
lower left corner is a running sum of the edges that cross the row's lower line to its left; from the corner to an edge, only
edges in the cell count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planeweave.functions.exact import floor_div, wide
from planeweave.operators.arrange import cells_of


def winding(edges: DataFrame, cell: int, needs_wide: bool = False) -> DataFrame:
    """edges with w_right and w_left: the summed power of all rings around the face on either side (clockwise counts +1)."""
    h = F.lit(cell).cast("long")
    c = lambda n: wide(F.col(n), needs_wide)
    ends = ["sx", "sy", "ex", "ey"]
    up = F.col("sy") < F.col("ey")
    lo_x, lo_y = F.when(up, c("sx")).otherwise(c("ex")), F.when(up, c("sy")).otherwise(c("ey"))
    hi_x, hi_y = F.when(up, c("ex")).otherwise(c("sx")), F.when(up, c("ey")).otherwise(c("sy"))
    upward = edges.where("sy <> ey").select("gid", lo_x.alias("ax"), lo_y.alias("ay"), hi_x.alias("bx"), hi_y.alias("by"), F.when(up, F.col("power")).otherwise(-F.col("power")).alias("p"))
    rows = upward.withColumn("r", F.explode(F.expr(f"case when div(cast(by as bigint) - pmod(cast(by as bigint), {cell}L), {cell}L) > div(cast(ay as bigint) - pmod(cast(ay as bigint), {cell}L), {cell}L) then sequence(div(cast(ay as bigint) - pmod(cast(ay as bigint), {cell}L), {cell}L) + 1, div(cast(by as bigint) - pmod(cast(by as bigint), {cell}L), {cell}L)) end")))
    # x where the edge crosses y = r * cell - 1/2, as num / den
    den = 2 * (F.col("by") - F.col("ay"))
    num = 2 * F.col("ax") * (F.col("by") - F.col("ay")) + (2 * F.col("r") * h - 1 - 2 * F.col("ay")) * (F.col("bx") - F.col("ax"))
    events = rows.select("gid", "r", (-floor_div(-(2 * num + den), 2 * den * h)).cast("long").alias("c"), F.col("p"), num.alias("num"), den.alias("den"))

    mid = edges.withColumn("mx2", F.col("sx") + F.col("ex")).withColumn("my2", F.col("sy") + F.col("ey"))
    mid = mid.withColumn("c", floor_div(F.col("mx2") + 1, 2 * h)).withColumn("r", floor_div(F.col("my2") + 1, 2 * h))
    w = W.partitionBy("gid", "r").orderBy("c", "ask").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = events.groupBy("gid", "r", "c").agg(F.sum("p").alias("p")).select("gid", "r", "c", F.lit(0).alias("ask"), "p")
    asked = mid.select("gid", "r", "c").distinct().select("gid", "r", "c", F.lit(1).alias("ask"), F.lit(0).cast("long").alias("p"))
    corners = summed.unionByName(asked).withColumn("corner", F.sum("p").over(w)).where("ask = 1").select("gid", "r", "c", "corner")

    # oriented upward (a to b) and rightward (l to r) before the join, so that what follows it stays short
    f_up, f_right = F.col("f_sy") < F.col("f_ey"), F.col("f_sx") < F.col("f_ex")
    held = cells_of(edges.select("gid", *[F.col(n).alias(f"f_{n}") for n in ends], F.col("power").alias("f_p")), cell, "f_sx", "f_sy", "f_ex", "f_ey", grow=1)
    oriented = [F.when(f_up if t in "ab" else f_right, c(f"f_{first}{v}")).otherwise(c(f"f_{last}{v}")).alias(f"{t}{v}") for t, first, last in (("a", "s", "e"), ("b", "e", "s"), ("l", "s", "e"), ("r", "e", "s")) for v in "xy"]
    held = held.select(
        "gid", F.col("cx").alias("c"), F.col("cy").alias("r"), *[f"f_{n}" for n in ends], *oriented,
        F.when(F.col("f_sy") == F.col("f_ey"), 0).when(f_up, F.col("f_p")).otherwise(-F.col("f_p")).alias("p_up"),
        F.when(F.col("f_sx") == F.col("f_ex"), 0).when(f_right, -F.col("f_p")).otherwise(F.col("f_p")).alias("p_over"),
    )
    asks = mid.select("gid", "r", "c", *ends, "power", c("mx2").alias("mx2"), c("my2").alias("my2"), (2 * c("r") * h - 1).alias("low2"), (2 * c("c") * h - 1).alias("left2"))
    near = asks.join(held, ["gid", "r", "c"])
    itself = "f_sx = sx and f_sy = sy and f_ex = ex and f_ey = ey"
    # does f cross the cell's lower line between the corner and the midpoint's x?
    num = "(2 * ax * (by - ay) + (low2 - 2 * ay) * (bx - ax))"
    first = F.expr(f"if(p_up <> 0 and 2 * ay < low2 and low2 < 2 * by and {num} > left2 * (by - ay) and {num} <= mx2 * (by - ay), p_up, 0L)")
    # does it pass between that line and the midpoint, just right of it?
    y = "(2 * ly * (rx - lx) + (mx2 - 2 * lx) * (ry - ly))"
    second = F.expr(f"if(p_over <> 0 and not ({itself}) and 2 * lx <= mx2 and mx2 < 2 * rx and {y} < my2 * (rx - lx) and ({y} > low2 * (rx - lx) or ({y} = low2 * (rx - lx) and ry > ly)), p_over, 0L)")
    # an edge that falls through its own midpoint on that line has been crossed there, in the corner's sum or in the first
    own = F.expr(f"if({itself} and my2 = low2 and rx > lx and ry < ly, -p_up, 0L)")
    local = near.groupBy("gid", *ends, "power", "r", "c").agg(F.sum(first + second + own).alias("local"))
    below = local.join(corners, ["gid", "r", "c"]).withColumn("w", F.col("corner") + F.col("local"))
    is_right = F.when(F.col("sx") == F.col("ex"), up).otherwise(F.col("sx") < F.col("ex"))
    out = below.withColumn("w_right", F.when(is_right, F.col("w")).otherwise(F.col("w") + F.col("power")))
    return out.select("gid", *ends, "power", "w_right", (F.col("w_right") - F.col("power")).alias("w_left"))


def boundary(edges: DataFrame, keep) -> DataFrame:
    """(gid, sx, sy, ex, ey): edges between a kept face and one that isn't, turned so that the kept one is on the right."""
    right, left = keep(F.col("w_right")), keep(F.col("w_left"))
    turn = lambda a, b: F.when(right, F.col(a)).otherwise(F.col(b)).alias(a)
    return edges.where(right != left).select("gid", turn("sx", "ex"), turn("sy", "ey"), turn("ex", "sx"), turn("ey", "sy"))
