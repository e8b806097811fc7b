"""From a bag of directed segments to planar edges with a power, by grid-keyed joins.

Segments are (gid, x1, y1, x2, y2, m): one row for each pair of ends of a group, the lesser end first, m the steps that way less the steps
back. A segment whose steps cancel stays: its ends and crossings bend others all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planeweave.functions.exact import NARROW, along, boxes_touch, crosses, crossing_terms, floor_div, pixel_hit, snapped, wide
from planeweave.sources.geometry import envelope

ENDS = ["x1", "y1", "x2", "y2"]


def bag(steps: DataFrame) -> DataFrame:
    """Sums equal and opposite steps (gid, x1, y1, x2, y2); those of no length go."""
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b)).cast("long")
    rows = steps.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    rows = rows.select("gid", pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"), F.when(ahead, 1).otherwise(-1).cast("long").alias("m"))
    return rows.groupBy("gid", *ENDS).agg(F.sum("m").alias("m"))


def grid_of(segments: DataFrame) -> tuple[int, bool]:
    """(cell size, whether products need decimals): the mean extent of a segment twice, and the largest spread of all."""
    spread = lambda lo, hi: F.max(F.greatest(lo, hi)) - F.min(F.least(lo, hi))
    r = segments.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))), spread(F.col("x1"), F.col("x2")), spread(F.col("y1"), F.col("y2"))).first()
    return (max(1, round(2 * r[0])) if r[0] else 1), max(r[1] or 0, r[2] or 0) > NARROW


def cells_of(rows: DataFrame, cell: int, x1="x1", y1="y1", x2="x2", y2="y2", grow: int = 1) -> DataFrame:
    """rows with cx and cy for every cell that the segment, grown by ``grow`` on all sides, can touch.

    Cells are walked column by column, so that a long slanting segment takes as many as it crosses and few more.
    """
    a, b, c, d = (F.col(n).cast("long") for n in (x1, y1, x2, y2))
    left, right = F.least(a, c), F.greatest(a, c)
    low_y, high_y = F.when(a <= c, b).otherwise(d), F.when(a <= c, d).otherwise(b)
    h = F.lit(cell).cast("long")
    rows = rows.withColumn("cx", F.explode(F.sequence(floor_div(left - grow, h), floor_div(right + grow, h))))
    run, rise = F.greatest(right - left, F.lit(1)), high_y - low_y
    at = lambda x: low_y + F.floor(rise.cast("double") * (F.least(F.greatest(x, left), right) - left).cast("double") / run.cast("double")).cast("long")
    y_from, y_to = at(F.col("cx") * h - grow - 1), at((F.col("cx") + 1) * h + grow + 1)
    straight = right == left
    lo = F.when(straight, F.least(b, d)).otherwise(F.least(y_from, y_to) - 1) - grow
    hi = F.when(straight, F.greatest(b, d)).otherwise(F.greatest(y_from, y_to) + 2) + grow
    lo, hi = F.greatest(lo, F.least(b, d) - grow), F.least(hi, F.greatest(b, d) + grow)
    return rows.withColumn("cy", F.explode(F.sequence(floor_div(lo, h), floor_div(hi, h))))


def _box(prefix: str) -> dict[str, Column]:
    return envelope(*[F.col(prefix + n) for n in ENDS])


def crossings(segments: DataFrame, cell: int, needs_wide: bool = False) -> DataFrame:
    """(gid, ends of one, ends of the other as o_*, x, y): each pair that crosses inside both, in the cell of its snapped crossing alone."""
    held = cells_of(segments.select("gid", *ENDS), cell)
    other = held.select("gid", "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ENDS])
    first = F.struct(*ENDS) < F.struct(*[F.col(f"o_{c}").alias(c) for c in ENDS])
    pairs = held.join(other, ["gid", "cx", "cy"]).where(first & boxes_touch(_box(""), _box("o_")))
    mine, its = [wide(F.col(c), needs_wide) for c in ENDS], [wide(F.col(f"o_{c}"), needs_wide) for c in ENDS]
    # the terms pass through a generator of one row, so that the optimizer doesn't write them out at every use
    pairs = pairs.select("gid", "cx", "cy", *ENDS, *[f"o_{c}" for c in ENDS], F.explode(F.array(crossing_terms(*mine, *its))).alias("k")).where(crosses(F.col("k")))
    x, y = snapped(mine[0], mine[2] - mine[0], F.col("k")), snapped(mine[1], mine[3] - mine[1], F.col("k"))
    pairs = pairs.select("gid", "cx", "cy", *ENDS, *[f"o_{c}" for c in ENDS], x.alias("x"), y.alias("y"))
    h = F.lit(cell).cast("long")
    return pairs.where((floor_div(F.col("x"), h) == F.col("cx")) & (floor_div(F.col("y"), h) == F.col("cy"))).drop("cx", "cy")


def hot_pixels(segments: DataFrame, cell: int, needs_wide: bool = False) -> DataFrame:
    """(gid, x, y), distinct: all ends and all snapped crossings."""
    ends = segments.select("gid", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    return ends.select("gid", "p.x", "p.y").unionByName(crossings(segments, cell, needs_wide).select("gid", "x", "y")).distinct()


def pixel_hits(segments: DataFrame, pixels: DataFrame, cell: int, needs_wide: bool = False) -> DataFrame:
    """(gid, ends, m, x, y): each hot pixel that each segment meets. A pixel lies in one cell, so no pair comes twice."""
    held = cells_of(segments, cell)
    h = F.lit(cell).cast("long")
    spots = pixels.withColumn("cx", floor_div(F.col("x"), h)).withColumn("cy", floor_div(F.col("y"), h))
    near = held.join(spots, ["gid", "cx", "cy"])
    box = (F.col("x") >= F.least("x1", "x2") - 1) & (F.col("x") <= F.greatest("x1", "x2") + 1) & (F.col("y") >= F.least("y1", "y2") - 1) & (F.col("y") <= F.greatest("y1", "y2") + 1)
    hit = pixel_hit(*[wide(F.col(c), needs_wide) for c in ("x", "y", *ENDS)])
    return near.where(box & hit).select("gid", *ENDS, "m", "x", "y")


def sub_edges(hits: DataFrame) -> DataFrame:
    """(gid, sx, sy, ex, ey, m): from pixel to pixel along each segment."""
    key = along(F.col("x"), F.col("y"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    w = W.partitionBy("gid", *ENDS).orderBy(key)
    steps = hits.select("gid", "m", F.col("x").alias("sx"), F.col("y").alias("sy"), F.lead("x").over(w).alias("ex"), F.lead("y").over(w).alias("ey"))
    return steps.where("ex is not null")


def powered(steps: DataFrame) -> DataFrame:
    """(gid, sx, sy, ex, ey, power): steps between the same two pixels netted, turned so that the power is positive."""
    ahead = (F.col("sx") < F.col("ex")) | ((F.col("sx") == F.col("ex")) & (F.col("sy") < F.col("ey")))
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    rows = steps.select("gid", pick("sx", "ex").alias("ax"), pick("sy", "ey").alias("ay"), pick("ex", "sx").alias("bx"), pick("ey", "sy").alias("by"), F.when(ahead, F.col("m")).otherwise(-F.col("m")).alias("m"))
    net = rows.groupBy("gid", "ax", "ay", "bx", "by").agg(F.sum("m").alias("m")).where("m <> 0")
    turn = lambda a, b: F.when(F.col("m") > 0, F.col(a)).otherwise(F.col(b))
    return net.select("gid", turn("ax", "bx").alias("sx"), turn("ay", "by").alias("sy"), turn("bx", "ax").alias("ex"), turn("by", "ay").alias("ey"), F.abs("m").alias("power"))


def arrangement(segments: DataFrame, cell: int, needs_wide: bool = False) -> DataFrame:
    """Planar edges with their power."""
    return powered(sub_edges(pixel_hits(segments, hot_pixels(segments, cell, needs_wide), cell, needs_wide)))
