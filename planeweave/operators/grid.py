"""A uniform grid over boxes: which boxes lie near a box, or to the left of a point, by equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.functions.exact import boxes_touch, floor_div

BOX = ["xmin", "ymin", "xmax", "ymax"]


def cell_size(items: DataFrame) -> int:
    """Twice the mean extent of a box, at least 1: long boxes take few cells, small ones share few."""
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    mean = items.where("xmin <= xmax and ymin <= ymax").agg(F.avg(extent)).first()[0]
    return max(1, round(2 * mean)) if mean else 1


def grid_cells(items: DataFrame, cell: int) -> DataFrame:
    """The input's rows (gid, xmin, ymin, xmax, ymax, ...) with cx and cy for every cell that the closed box touches.

    Boxes with a null side, or with xmin > xmax or ymin > ymax, touch none.
    """
    h = F.lit(cell).cast("long")
    at = lambda c: floor_div(F.col(c).cast("long"), h)
    rows = items.where("xmin <= xmax and ymin <= ymax")
    rows = rows.withColumn("cx", F.explode(F.sequence(at("xmin"), at("xmax"))))
    return rows.withColumn("cy", F.explode(F.sequence(at("ymin"), at("ymax"))))


def overlapping(queries: DataFrame, items: DataFrame, cell: int) -> DataFrame:
    """(gid, query_id, item_id), once for each pair of closed boxes of a group that touch.

    A pair that shares several cells counts in the one that holds the lower left corner of what both cover.
    """
    h = F.lit(cell).cast("long")
    q = grid_cells(queries.select("gid", F.col("id").alias("query_id"), *BOX), cell)
    other = grid_cells(items.select("gid", F.col("id").alias("item_id"), *BOX), cell)
    i = other.select("gid", "cx", "cy", "item_id", *[F.col(c).alias(f"i_{c}") for c in BOX])
    boxes = {c: F.col(c) for c in BOX}, {c: F.col(f"i_{c}") for c in BOX}
    low_x, low_y = F.greatest("xmin", "i_xmin").cast("long"), F.greatest("ymin", "i_ymin").cast("long")
    here = (F.col("cx") == floor_div(low_x, h)) & (F.col("cy") == floor_div(low_y, h))
    return q.join(i, ["gid", "cx", "cy"]).where(boxes_touch(*boxes) & here).select("gid", "query_id", "item_id")


def left_of(points: DataFrame, items: DataFrame, band: int) -> DataFrame:
    """(gid, point_id, item_id): boxes that a ray from the point to -x meets, by bands of ``band`` rows."""
    h = F.lit(band).cast("long")
    at = lambda c: floor_div(F.col(c).cast("long"), h)
    banded = items.where("xmin <= xmax and ymin <= ymax").select("gid", F.col("id").alias("item_id"), *BOX)
    banded = banded.withColumn("band", F.explode(F.sequence(at("ymin"), at("ymax"))))
    asked = points.select("gid", F.col("id").alias("point_id"), "x", "y").withColumn("band", at("y"))
    return asked.join(banded, ["gid", "band"]).where("ymin <= y and y <= ymax and xmin <= x").select("gid", "point_id", "item_id")
