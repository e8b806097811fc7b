"""Exact integer geometry as Column expressions.

Coordinates are longs, or decimal(38,0) where products could leave 64 bits (see wide()). A pixel of a grid point is the unit
square around it, closed on its right and top, open on its left and bottom.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Differences of coordinates up to here keep every product within 64 bits.
NARROW = 1_300_000


def wide(c: Column, needed: bool) -> Column:
    return c.cast("decimal(38,0)") if needed else c


def floor_div(n: Column, d: Column) -> Column:
    """Quotient toward minus infinity, for d > 0."""
    return F.call_function("div", n - F.pmod(n, d), d)


def sign(c: Column) -> Column:
    return F.when(c > 0, F.lit(1)).when(c < 0, F.lit(-1)).otherwise(F.lit(0))


def cross(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    return dx1 * dy2 - dy1 * dx2


def boxes_touch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed boxes xmin, ymin, xmax, ymax have a point in common."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def pixel_hit(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the segment meets the pixel of (x, y); of a segment of no length, whether it is that point."""
    dx, dy = x2 - x1, y2 - y1
    reach = F.abs(dx) + F.abs(dy)
    begin = 2 * ((x - x1) * dx + (y - y1) * dy) + reach
    end = 2 * ((x2 - x) * dx + (y2 - y) * dy) + reach
    off = (x - x1) * dy - (y - y1) * dx
    up, down = (dx >= 0) & (dy >= 0), (dx <= 0) & (dy <= 0)
    corner = ((off >= 0) & (dx >= 0) & (dy <= 0)) | ((off < 0) & (dx <= 0) & (dy >= 0))
    inside = F.when(up, begin >= 0).otherwise(begin > 0) & F.when(down, end >= 0).otherwise(end > 0)
    near = F.when(corner, 2 * F.abs(off) <= reach).otherwise(2 * F.abs(off) < reach)
    return F.when(reach == 0, (x == x1) & (y == y1)).otherwise(inside & near)


def crossing_terms(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """struct(den, t, u): two lines' crossing is t/den along the first segment and u/den along the second."""
    dx1, dy1, dx2, dy2 = x2 - x1, y2 - y1, x4 - x3, y4 - y3
    return F.struct(cross(dx1, dy1, dx2, dy2).alias("den"), cross(x3 - x1, y3 - y1, dx2, dy2).alias("t"), cross(x3 - x1, y3 - y1, dx1, dy1).alias("u"))


def crosses(k: Column) -> Column:
    """Whether the crossing of those terms lies inside both segments; parallel ones have none."""
    den, t, u = k["den"], k["t"], k["u"]
    return ((den > 0) & (t > 0) & (t < den) & (u > 0) & (u < den)) | ((den < 0) & (t < 0) & (t > den) & (u < 0) & (u > den))


def snapped(start: Column, run: Column, k: Column) -> Column:
    """A coordinate of the crossing, start + run * t / den, to the nearest whole, halves going down."""
    d, n = F.abs(k["den"]), F.when(k["den"] > 0, k["t"]).otherwise(-k["t"])
    return (start + floor_div(2 * n * run + d - 1, 2 * d)).cast("long")


def crossing(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """struct(x, y) of the snapped crossing inside both segments, else null. Long: over tables, arrange.crossings is lighter."""
    k = crossing_terms(x1, y1, x2, y2, x3, y3, x4, y4)
    return F.when(crosses(k), F.struct(snapped(x1, x2 - x1, k).alias("x"), snapped(y1, y2 - y1, k).alias("y")))


def along(x: Column, y: Column, dx: Column, dy: Column) -> Column:
    """Rises strictly from pixel to pixel along a segment of that direction."""
    return x * sign(dx) + y * sign(dy)


def side(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if the point is left of the directed line, -1 if right, 0 if on it."""
    return sign(cross(x2 - x1, y2 - y1, px - x1, py - y1))


def half_turn(dx: Column, dy: Column) -> Column:
    """0 for directions from -x counter-clockwise up to, not including, +x; else 1."""
    return F.when((dy < 0) | ((dy == 0) & (dx < 0)), F.lit(0)).otherwise(F.lit(1))


def counter_clockwise(a: Column, b: Column) -> Column:
    """Comparator of structs with dx and dy (longs of up to 33 bits): counter-clockwise from -x, exact; for array_sort."""
    ha, hb = half_turn(a["dx"], a["dy"]), half_turn(b["dx"], b["dy"])
    far = F.greatest(*[F.abs(v[c]) for v in (a, b) for c in ("dx", "dy")]) >= F.lit(1 << 31)
    big = [wide(v[c], True) for v in (a, b) for c in ("dx", "dy")]
    turn = F.when(far, sign(cross(*big))).otherwise(sign(cross(a["dx"], a["dy"], b["dx"], b["dy"])))
    return F.when(ha != hb, ha - hb).otherwise(-turn)


def words_of(n: Column) -> tuple[Column, Column]:
    """A long as high and low word: sums of either stay within 64 bits for up to 2**31 rows."""
    return F.shiftright(n, 32), n.bitwiseAND(F.lit(0xFFFFFFFF))


def of_words(high: Column, low: Column) -> Column:
    """The whole number of two sums, as decimal(38,0)."""
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def exact_sum(n: Column) -> Column:
    """Aggregate: the sum of longs as decimal(38,0), which no sum of areas leaves."""
    high, low = words_of(n)
    return of_words(F.sum(high), F.sum(low))


def ratio_order(num: Column, den: Column, needs_wide: bool) -> Column:
    """A struct that sorts as num / den does, for den > 0 and both below 2**33.

    Of narrow terms a double tells any two apart; of wide ones the whole part and 36 digits do, as two fractions differ by
    2**-66 at least.
    """
    if not needs_wide:
        return F.struct((num / den).alias("a"))
    digits = F.lit(10**18).cast("decimal(19,0)")
    rest = F.pmod(num, den)
    first = F.call_function("div", rest.cast("decimal(11,0)") * digits, den)
    left = (rest.cast("decimal(11,0)") * digits - first.cast("decimal(19,0)") * den.cast("decimal(11,0)")).cast("decimal(11,0)")
    return F.struct(floor_div(num, den).alias("a"), first.alias("b"), F.call_function("div", left * digits, den).alias("c"))
