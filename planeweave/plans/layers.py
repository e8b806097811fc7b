"""Layers of polygons made of the driver's tables, whose whole-number keys are all that they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.functions.exact import floor_div
from planeweave.sources.geometry import POLYGON, RING, rectangle, reversed_ring


def rectangles(spark: SparkSession, sf_dir: str, table: str, key: str, mx: int, my: int) -> DataFrame:
    """(gid, id, x, y, w, h, geometry): a rectangle for each row, 500 to a group."""
    k = F.col(key).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
        floor_div(k, F.lit(500)).alias("gid"), k.alias("id"), (k * mx % 149).alias("x"), (k * my % 151).alias("y"), (2 + k % 3).alias("w"), (2 + floor_div(k, F.lit(3)) % 3).alias("h")
    )
    return rows.withColumn("geometry", rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def rect_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rectangles(spark, sf_dir, "part", "p_partkey", 7919, 104729)


def rect_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rectangles(spark, sf_dir, "customer", "c_custkey", 6101, 15485863)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, id, layer, ring, geometry): a clockwise triangle for each order, 60 to a group, in two layers; ring is open."""
    k = F.col("o_orderkey").cast("long")
    d = lambda n: floor_div(k, F.lit(n))
    x, y = (k * 37 + d(7) * 11) % 53, (k * 53 + d(5) * 17) % 59
    p = lambda a, b: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"))
    ring = F.array(p(x, y), p(x + k % 5, y + 6 + k % 13), p(x + 5 + k % 11, y + k % 7))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(d(60).alias("gid"), k.alias("id"), (k % 2).alias("layer"), ring.alias("ring"))
    none = F.array().cast(f"array<{RING}>")
    return rows.withColumn("geometry", F.array(F.struct(F.col("ring").alias("outer_ring"), none.alias("inner_rings"))))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, id, layer, geometry): for each customer a frame around a hole, and a rectangle to its right; 40 to a group, in two layers."""
    k = F.col("c_custkey").cast("long")
    x, y, w, h = k * 37 % 61, k * 53 % 67, 3 + k % 7, 3 + floor_div(k, F.lit(3)) % 5
    ring = lambda *box: rectangle(*box)[0]["outer_ring"]
    none = F.array().cast(f"array<{RING}>")
    frame = F.struct(ring(x, y, w + 4, h + 4).alias("outer_ring"), F.array(reversed_ring(ring(x + 2, y + 1, w, h))).alias("inner_rings"))
    beside = F.struct(ring(x + w + 6, y, F.lit(3), h).alias("outer_ring"), none.alias("inner_rings"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(floor_div(k, F.lit(40)).alias("gid"), k.alias("id"), (k % 2).alias("layer"), F.array(frame, beside).cast(f"array<{POLYGON}>").alias("geometry"))


#: The same layers in SQL, as common table expressions.
SQL_RECTS = """
rect_a as (select p_partkey // 500 as gid, p_partkey as id, p_partkey * 7919 % 149 as x, p_partkey * 104729 % 151 as y, 2 + p_partkey % 3 as w, 2 + p_partkey // 3 % 3 as h from part),
rect_b as (select c_custkey // 500 as gid, c_custkey as id, c_custkey * 6101 % 149 as x, c_custkey * 15485863 % 151 as y, 2 + c_custkey % 3 as w, 2 + c_custkey // 3 % 3 as h from customer)"""
SQL_TRIANGLES = """
k as (select o_orderkey as k, (o_orderkey * 37 + o_orderkey // 7 * 11) % 53 as x, (o_orderkey * 53 + o_orderkey // 5 * 17) % 59 as y from orders),
tri as (select k // 60 as gid, k as id, k % 2 as layer, [{'x': x, 'y': y}, {'x': x + k % 5, 'y': y + 6 + k % 13}, {'x': x + 5 + k % 11, 'y': y + k % 7}] as ring from k),
steps as (select gid, id, layer, i - 1 as i, ring[i].x as x1, ring[i].y as y1, ring[i % 3 + 1].x as x2, ring[i % 3 + 1].y as y2 from tri, range(1, 4) as t(i))"""
SQL_FRAMES = """
k as (select c_custkey as k, c_custkey * 37 % 61 as x, c_custkey * 53 % 67 as y, 3 + c_custkey % 7 as w, 3 + c_custkey // 3 % 5 as h from customer),
box as (select k, x, y, w + 4 as w, h + 4 as h, false as hole from k union all select k, x + 2, y + 1, w, h, true from k union all select k, x + w + 6, y, 3, h, false from k),
ring as (select k, case when hole then [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]] else [[x, y], [x, y + h], [x + w, y + h], [x + w, y], [x, y]] end as p from box),
steps as (select k // 40 as gid, k as id, k % 2 as layer, i - 1 as i, p[i][1] as x1, p[i][2] as y1, p[i + 1][1] as x2, p[i + 1][2] as y2 from ring, range(1, 5) as t(i))"""
