"""Multi-polygons as nested columns, their segments, and WKT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.exact import cross, of_words, wide, words_of

POINT = "struct<x:int,y:int>"
RING = f"array<{POINT}>"
POLYGON = f"struct<outer_ring:{RING},inner_rings:array<{RING}>>"
MULTIPOLYGON = f"array<{POLYGON}>"


def _let(value: Column, then) -> Column:
    """then(value), the value being made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def closed(ring: Column) -> Column:
    """The ring with its first point again at the end, if it isn't there yet; empty and null rings are empty."""
    ring = F.coalesce(ring, F.array().cast(RING))
    open_ = (F.size(ring) > 0) & ~F.element_at(ring, 1).eqNullSafe(F.element_at(ring, -1))
    return F.when(F.size(ring) == 0, ring).when(open_, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def reversed_ring(ring: Column) -> Column:
    """Closed, with its first point kept and the others in reverse."""
    return F.reverse(closed(ring))


def rings_of(multipolygon: Column) -> Column:
    """All rings: of each polygon the outer one, then the inner ones."""
    return F.flatten(F.transform(multipolygon, lambda p: F.concat(F.array(p["outer_ring"]), F.coalesce(p["inner_rings"], F.array().cast(f"array<{RING}>")))))


def ring_segments(ring: Column) -> Column:
    """array of struct(x1, y1, x2, y2): consecutive points of the closed ring, as longs, steps of no length left out."""
    r = closed(ring)
    pairs = F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(
        a["x"].cast("long").alias("x1"), a["y"].cast("long").alias("y1"), b["x"].cast("long").alias("x2"), b["y"].cast("long").alias("y2")))
    return F.filter(pairs, lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))


def segments(layer: DataFrame, keys: list[str], geometry: str = "geometry", backwards: bool = False) -> DataFrame:
    """(*keys, x1, y1, x2, y2), one row for each step of each ring; backwards turns every step round."""
    # generators and items of arrays are compiled, higher-order functions aren't; the step that closes a closed ring has no length
    names = [f"__{k}" for k in range(len(keys))]
    rows = layer.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.explode(geometry).alias("p"))
    rows = rows.select(*names, F.explode(F.concat(F.array("p.outer_ring"), F.coalesce("p.inner_rings", F.array().cast(f"array<{RING}>")))).alias("r")).where("size(r) > 0")
    rows = rows.select(*names, "r", F.explode(F.sequence(F.lit(0), F.size("r") - 1)).alias("i"))
    here, after = F.get("r", F.col("i")), F.get("r", F.when(F.col("i") + 1 < F.size("r"), F.col("i") + 1).otherwise(0))
    a, b = (after, here) if backwards else (here, after)
    rows = rows.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[v[c].cast("long").alias(f"{c}{n}") for v, n in ((a, 1), (b, 2)) for c in "xy"])
    return rows.where("x1 != x2 or y1 != y2")


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A clockwise, closed rectangle as a multi-polygon."""
    p = lambda a, b: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"))
    ring = F.array(p(x, y), p(x, y + h), p(x + w, y + h), p(x + w, y), p(x, y))
    return F.array(F.struct(ring.alias("outer_ring"), F.array().cast(f"array<{RING}>").alias("inner_rings")))


def to_wkt(multipolygon: Column) -> Column:
    """``MULTIPOLYGON(((x y,x y,...),...),...)``; ``MULTIPOLYGON EMPTY`` without polygons; null for null."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(closed(r), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))
    none = F.array().cast(f"array<{RING}>")
    polygon = lambda p: F.concat(F.lit("("), F.array_join(F.transform(F.concat(F.array(p["outer_ring"]), F.coalesce(p["inner_rings"], none)), ring), ","), F.lit(")"))
    text = F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(multipolygon, polygon), ","), F.lit(")"))
    return F.when(F.size(multipolygon) == 0, F.lit("MULTIPOLYGON EMPTY")).otherwise(text)


def from_wkt(wkt: Column) -> Column:
    """The multi-polygon of a POLYGON or MULTIPOLYGON text with whole coordinates, by string functions alone."""
    body = F.regexp_replace(F.upper(wkt), r"\s*([(),])\s*", "$1")
    body = F.regexp_replace(body, r"^\s*POLYGON\s*(\(.*\))\s*$", "MULTIPOLYGON($1)")
    inner = F.regexp_extract(body, r"^\s*MULTIPOLYGON\s*\(\(\((.*)\)\)\)\s*$", 1)
    # marks of one character split without regular expressions, and each text is split once
    marked = F.replace(F.replace(F.regexp_replace(inner, r"\s+", " "), F.lit(")),(("), F.lit("\x01")), F.lit("),("), F.lit("\x02"))
    point = lambda p: _let(F.split(F.trim(p), " "), lambda w: F.struct(F.element_at(w, 1).cast("int").alias("x"), F.element_at(w, 2).cast("int").alias("y")))
    ring = lambda r: F.transform(F.split(r, ","), point)
    polygon = lambda p: _let(F.transform(F.split(p, "\x02"), ring), lambda r: F.struct(F.element_at(r, 1).alias("outer_ring"), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))).alias("inner_rings")))
    return _let(marked, lambda t: F.when(t == "", F.array().cast(MULTIPOLYGON)).otherwise(F.transform(F.split(t, "\x01"), polygon)))


def ring_area2(ring: Column) -> Column:
    """Twice the area of a ring as decimal(38,0), positive if clockwise; exact for all of int32."""
    zero = F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))

    def add(t: Column, s: Column) -> Column:
        high, low = words_of(s["x2"] * s["y1"] - s["x1"] * s["y2"])
        return F.struct((t["high"] + high).alias("high"), (t["low"] + low).alias("low"))

    return F.aggregate(ring_segments(ring), zero, add, lambda t: of_words(t["high"], t["low"]))


def area2(multipolygon: Column) -> Column:
    return F.aggregate(rings_of(multipolygon), F.lit(0).cast("decimal(38,0)"), lambda t, r: (t + ring_area2(r)).cast("decimal(38,0)"))


def canonical_ring(ring: Column) -> Column:
    """The ring without points on straight runs, closed, from its least point; of several ways that begin there, the least.

    Rings that enclose the same points in the same direction come out equal. A ring of no area is empty.
    """

    def distinct(r: Column) -> Column:
        return F.filter(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda p, i: ~p.eqNullSafe(F.get(r, i + 1)))

    def bent(r: Column) -> Column:
        def bends(p: Column, i: Column) -> Column:
            before, after = F.get(r, F.pmod(i - 1, F.size(r))), F.get(r, F.pmod(i + 1, F.size(r)))
            d = [a[c].cast("long") - b[c].cast("long") for a, b in ((p, before), (after, p)) for c in ("x", "y")]
            far = F.greatest(*[F.abs(n) for n in d]) >= F.lit(1 << 31)
            return F.when(far, cross(*[wide(n, True) for n in d]) != 0).otherwise(cross(*d) != 0)

        return F.filter(r, bends)

    def turned(r: Column) -> Column:
        starts = _let(F.array_min(r), lambda least: F.filter(F.sequence(F.lit(1), F.size(r)), lambda k: F.get(r, k - 1) == least))
        return F.array_min(F.transform(starts, lambda k: F.concat(F.slice(r, k, F.size(r)), F.slice(r, 1, k))))

    return _let(_let(_let(closed(ring), distinct), bent), lambda r: F.when(F.size(r) > 2, turned(r)).otherwise(F.array().cast(RING)))


def canonical(multipolygon: Column) -> Column:
    """The multi-polygon with canonical rings, holes and polygons in order; those of no area left out. Null for null."""
    holes = lambda p: F.array_sort(F.filter(F.transform(F.coalesce(p["inner_rings"], F.array().cast(f"array<{RING}>")), canonical_ring), lambda r: F.size(r) > 0))
    polygons = F.transform(multipolygon, lambda p: F.struct(canonical_ring(p["outer_ring"]).alias("outer_ring"), holes(p).alias("inner_rings")))
    return F.array_sort(F.filter(polygons, lambda p: F.size(p["outer_ring"]) > 0))


def same_geometry(a: Column, b: Column) -> Column:
    """Whether both are the same polygons, whatever the order of polygons and holes, where rings begin, and points on straight runs."""
    return F.when(a.eqNullSafe(b), F.lit(True)).otherwise(canonical(a).eqNullSafe(canonical(b)))


def envelope(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """The closed box of a segment."""
    return {"xmin": F.least(x1, x2), "ymin": F.least(y1, y2), "xmax": F.greatest(x1, x2), "ymax": F.greatest(y1, y2)}
