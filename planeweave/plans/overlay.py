"""Overlay of two layers of multi-polygons, for every group of keys at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.exact import exact_sum
from planeweave.operators import arrange, groups, halfedges, rings
from planeweave.operators.winding import boundary, winding
from planeweave.plans.storage import materialize
from planeweave.sources.geometry import segments

#: What each operation keeps, by the summed winding number of a face; difference turns b round.
KEEP: dict[str, Callable[[Column], Column]] = {
    "union": lambda w: w > 0,
    "intersection": lambda w: w > 1,
    "symmetric_difference": lambda w: w == 1,
    "difference": lambda w: w > 0,
    "self_union": lambda w: w > 0,
}


class Joined:
    """What is asked of groups that are too large for one task, by joins; steps are (gid, x1, y1, x2, y2)."""

    def __init__(self, steps: DataFrame, keep: Callable[[Column], Column], cell: int | None = None):
        self.keep = keep
        self.bag = materialize(arrange.bag(steps), "bag")
        size, self.wide = arrange.grid_of(self.bag)
        self.cell = cell or size

    def crossings(self) -> DataFrame:
        return arrange.crossings(self.bag, self.cell, self.wide)

    def pixels(self) -> DataFrame:
        return arrange.hot_pixels(self.bag, self.cell, self.wide)

    def hits(self) -> DataFrame:
        return arrange.pixel_hits(self.bag, self.pixels(), self.cell, self.wide)

    def sub_edges(self) -> DataFrame:
        return arrange.sub_edges(self.hits())

    def edges(self) -> DataFrame:
        if not hasattr(self, "_edges"):
            self._edges = materialize(arrange.arrangement(self.bag, self.cell, self.wide), "edges")
        return self._edges

    def faces(self) -> DataFrame:
        return winding(self.edges(), self.cell, self.wide)

    def boundary(self) -> DataFrame:
        return boundary(self.faces(), self.keep)

    def area2(self) -> DataFrame:
        turn = F.col("ex") * F.col("sy") - F.col("sx") * F.col("ey")
        return self.boundary().groupBy("gid").agg(exact_sum(turn).alias("area2")).where("area2 <> 0")

    def depths(self) -> DataFrame:
        turn = F.col("ex") * F.col("sy") - F.col("sx") * F.col("ey")
        sides = self.faces().select("gid", F.explode(F.array(F.struct(F.col("w_right").alias("depth"), turn.alias("t")), F.struct(F.col("w_left").alias("depth"), (-turn).alias("t")))).alias("s"))
        return sides.groupBy("gid", "s.depth").agg(exact_sum(F.col("s.t")).alias("area2")).where("depth <> 0 and area2 <> 0")

    def degrees(self) -> DataFrame:
        return halfedges.degrees(self.edges())

    def angular_order(self) -> DataFrame:
        return halfedges.angular_order(self.edges())

    def next_half_edges(self) -> DataFrame:
        return halfedges.next_half_edges(self.edges())

    def components(self) -> DataFrame:
        return halfedges.vertex_components(self.edges())

    def component_rays(self) -> DataFrame:
        return halfedges.component_rays(self.edges(), self.cell, self.wide)

    def chains(self) -> DataFrame:
        return halfedges.chains(self.edges())

    def rings(self) -> DataFrame:
        return rings.trace(self.boundary())[0]

    def polygons(self) -> DataFrame:
        return rings.polygons(materialize(self.boundary(), "boundary"), max(1, self.cell), self.wide)

    def validity(self) -> DataFrame:
        taken = self.sub_edges().groupBy("gid").agg(F.count(F.lit(1)).alias("steps"), F.max(F.abs("m")).alias("most"), F.min(F.abs("m")).alias("least"))
        one = F.col("w_right").isin(0, 1) & F.col("w_left").isin(0, 1) & (F.col("power") == 1)
        sides = self.faces().groupBy("gid").agg(F.count(F.lit(1)).alias("edges"), F.every(one).alias("one"))
        ok = (F.col("steps") == F.col("edges")) & (F.col("most") == 1) & (F.col("least") == 1) & F.col("one")
        return taken.join(sides, "gid", "left").select("gid", F.coalesce(ok, F.lit(False)).alias("is_valid"))


class Overlay:
    """The arrangement of one or two layers (keys, geometry), and what can be asked of it.

    Clockwise outer rings count +1, counter-clockwise ones -1; a face's winding number is the sum over all rings around it,
    whichever layer they are of. Rings may be open or closed; empty and null rings, polygons and layers, and steps of no
    length or with a null coordinate, add nothing. Null keys form a group. Rows that repeat count each. Without keys, all rows are one overlay.

    Small groups are done whole in one task each (operators/groups.py), the others by joins; ``joins`` asks for joins for all.
    """

    def __init__(self, a: DataFrame, b: DataFrame | None = None, keys: list[str] | None = None, op: str | None = None, keep: Callable[[Column], Column] | None = None, geometry: str = "geometry", cell: int | None = None, joins: bool = False):
        self.keys, self.keep = list(keys or []), keep or KEEP[op or ("union" if b is not None else "self_union")]
        steps = segments(a, self.keys, geometry)
        if b is not None:
            steps = steps.unionByName(segments(b, self.keys, geometry, backwards=op == "difference"))
        gid = F.struct(*self.keys) if self.keys else F.struct(F.lit(0).alias("all"))
        steps = steps.select(gid.alias("gid"), *arrange.ENDS).where(" and ".join(f"{c} is not null" for c in arrange.ENDS))
        self.small, self.joined = None, None
        if joins:
            self.joined = Joined(steps, self.keep, cell)
            return
        large = groups.too_large(steps)
        self.small = steps
        if large.limit(1).count():
            large = materialize(large, "large")
            named = steps.withColumn("h", F.xxhash64("gid"))
            self.small = named.join(large, "h", "left_anti").drop("h")
            self.joined = Joined(named.join(large, "h", "left_semi").drop("h"), self.keep, cell)

    def ask(self, product: str) -> DataFrame:
        """(gid, ...): one of groups.PRODUCTS, of all groups."""
        by_joins = getattr(self.joined, product)() if self.joined else None
        if self.small is None:
            return by_joins
        kept = groups.codes(self.keep, self.small) if product in ("boundary", "area2", "rings", "polygons") else None
        whole = groups.asked(self.small, product, kept)
        if by_joins is None:
            return whole
        return whole.unionByName(by_joins.select("gid", *[F.col(f.name).cast(f.dataType) if f.name != "area2" else F.col("area2") for f in whole.schema.fields[1:]]))

    @property
    def edges(self) -> DataFrame:
        """Planar edges (gid, sx, sy, ex, ey, power)."""
        return self.ask("edges")

    @property
    def faces(self) -> DataFrame:
        """edges with w_right and w_left."""
        return self.ask("faces")

    @property
    def boundary(self) -> DataFrame:
        """Edges around what is kept, with the kept face on their right."""
        return self.ask("boundary")

    def _named(self, df: DataFrame) -> DataFrame:
        """gid back to the keys, areas as decimals."""
        rest = [F.col(c).cast("decimal(38,0)").alias(c) if c == "area2" else c for c in df.columns if c != "gid"]
        return df.select(*[F.col(f"gid.{k}").alias(k) for k in self.keys], *rest)

    def area2(self) -> DataFrame:
        """(keys, area2: decimal(38,0)): twice the kept area; groups that keep nothing have no row."""
        return self._named(self.ask("area2"))

    def depths(self) -> DataFrame:
        """(keys, depth, area2: decimal(38,0)): twice the area at each winding number but 0."""
        return self._named(self.ask("depths"))

    def rings(self) -> DataFrame:
        """(keys, area2, ring): every ring of the result."""
        return self._named(self.ask("rings").select("gid", "area2", "ring"))

    def polygons(self) -> DataFrame:
        """(keys, geometry): the resulting multi-polygons."""
        return self._named(self.ask("polygons"))

    def validity(self) -> DataFrame:
        """(keys, is_valid): whether the layer's rings, clockwise around and counter-clockwise inside, are polygons already: no face
        is covered twice or turned inside out, no part of an edge is used twice, and no edge has the same face on both sides."""
        return self._named(self.ask("validity"))


def overlay(a: DataFrame, b: DataFrame | None = None, keys: list[str] | None = None, op: str | None = None, **how) -> DataFrame:
    """(keys, geometry) of one operation; how: keep (a predicate of the winding number), geometry, cell."""
    return Overlay(a, b, keys, op, **how).polygons()


def union(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return overlay(a, b, keys, "union")


def intersection(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return overlay(a, b, keys, "intersection")


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return overlay(a, b, keys, "symmetric_difference")


def difference(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return overlay(a, b, keys, "difference")


def self_union(a: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return overlay(a, None, keys, "self_union")
