"""Small groups whole in one task: their arrangement, winding numbers, graph, rings and polygons, over many groups at once in numpy.

Same rows as arrange.py, winding.py, halfedges.py and rings.py make by joins, which serve the groups that are too large for this.
A group's steps reach one task by one shuffle, and nothing is shuffled or written after it. Coordinates are counted from a group's
least and take 21 bits, so that (group, x, y) is one sortable long; a vertex is an index into the sorted hot pixels. Products of
narrow coordinates stay within 64 bits. Pairs are made a block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planeweave.functions.exact import NARROW

#: Steps of a group that one task takes at most, and pixels that they may meet.
MOST, MOST_HITS = 1 << 14, 1 << 21
#: Steps that a task works on at once, and pairs.
ROWS, PAIRS = 1 << 15, 1 << 19
SIDE, WHOLE = 21, 42
LOW = (1 << SIDE) - 1


def too_large(steps: DataFrame) -> DataFrame:
    """(h): hashes of the groups of steps (gid, x1, y1, x2, y2) that need joins: of many or long steps, spread wide, or of one hash with another."""
    run = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    spread = lambda a, b: F.max(F.greatest(a, b)) - F.min(F.least(a, b))
    each = steps.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum(run.cast("double")).alias("run"), spread("x1", "x2").alias("wide"), spread("y1", "y2").alias("high"))
    n = F.col("n").cast("double")
    hits = F.least(n * n * n / 2, 3 * (F.col("run") + 2 * n))
    each = each.select(F.xxhash64("gid").alias("h"), ((F.col("n") > MOST) | (hits > MOST_HITS) | (F.greatest("wide", "high") > NARROW)).alias("large"))
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bool_or("large").alias("large")).where("large or n > 1").select("h")


def codes(keep: Callable[[Column], Column], df: DataFrame) -> np.ndarray:
    """keep for each winding number from -MOST to MOST: 1 yes, 0 no, 2 null."""
    told = df.sparkSession.range(-MOST, MOST + 1, 1, 1).select(F.coalesce(keep(F.col("id")).cast("int"), F.lit(2)).alias("k"))
    return told.toArrow()["k"].to_numpy().astype(np.int8)


def key(g, x, y):
    return (g << WHOLE) | (x << SIDE) | y


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def summed(values: np.ndarray, starts: np.ndarray, of=np.add) -> np.ndarray:
    return of.reduceat(values, starts) if len(starts) else values[:0]


def expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts' units: whose it is, and which of its own."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(counts: np.ndarray, most: int = PAIRS) -> Iterator[slice]:
    """Slices of counts whose sums are at most ``most``, or of one."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def joined(parts: list[tuple], n: int) -> tuple:
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else tuple(np.empty(0, np.int64) for _ in range(n))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each node's component, of n nodes that are linked from a to b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def ranked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, steps from it) of each node of lists; before tells the one before, of a first one itself."""
    at, far = before, (before != np.arange(len(before))).astype(np.int64)
    while True:
        jumped = at[at]
        if (jumped == at).all():
            return at, far
        far, at = far + far[at], jumped


def in_lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class Groups:
    """Whole groups: g (from 0, rising) and the ends of each directed step."""

    def __init__(self, g: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray):
        first = starts_of(g)
        self.n = len(first)
        self.ox, self.oy = summed(np.minimum(x1, x2), first, np.minimum), summed(np.minimum(y1, y2), first, np.minimum)
        x1, y1, x2, y2 = x1 - self.ox[g], y1 - self.oy[g], x2 - self.ox[g], y2 - self.oy[g]
        p, q = key(g, x1, y1), key(g, x2, y2)
        moved = p != q
        p, q = p[moved], q[moved]
        a, b, m = np.minimum(p, q), np.maximum(p, q), np.where(p < q, 1, -1)
        order = np.lexsort((b, a))
        a, b, m = a[order], b[order], m[order]
        first = starts_of(a, b)
        #: the bag: one row for each pair of ends, sorted by them
        self.a, self.b, self.m = a[first], b[first], summed(m, first)
        self.g, self.x1, self.y1, self.x2, self.y2 = self.a >> WHOLE, self.a >> SIDE & LOW, self.a & LOW, self.b >> SIDE & LOW, self.b & LOW
        self.dx, self.dy = self.x2 - self.x1, self.y2 - self.y1
        self.y_low, self.y_high = np.minimum(self.y1, self.y2), np.maximum(self.y1, self.y2)

    def mean(self, g: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The mean of each group's values, as whole numbers."""
        return (np.bincount(g, values, self.n) / np.maximum(np.bincount(g, minlength=self.n), 1)).astype(np.int64)

    # the arrangement

    @cached_property
    def crossings(self) -> tuple:
        """(one, other, x, y): segments that cross inside both, the lesser first, and the snapped crossing."""
        # segments begin in order of x: those that begin before this one ends come right after it
        to = np.searchsorted(self.a, key(self.g, self.x2, LOW), "right")
        counts, found = to - np.arange(len(to)) - 1, []
        for part in blocks(counts):
            i, k = expanded(counts[part])
            i += part.start
            j = i + 1 + k
            near = np.flatnonzero((self.y_low[i] <= self.y_high[j]) & (self.y_low[j] <= self.y_high[i]))
            i, j = i[near], j[near]
            dx1, dy1, dx2, dy2, fx, fy = self.dx[i], self.dy[i], self.dx[j], self.dy[j], self.x1[j] - self.x1[i], self.y1[j] - self.y1[i]
            den, t, u = dx1 * dy2 - dy1 * dx2, fx * dy2 - fy * dx2, fx * dy1 - fy * dx1
            turn = np.sign(den)
            den, t, u = den * turn, t * turn, u * turn
            met = np.flatnonzero((t > 0) & (t < den) & (u > 0) & (u < den))
            i, j, den, t = i[met], j[met], den[met], t[met]
            at = lambda start, run: start + (2 * t * run + den - 1) // (2 * den)
            found.append((i, j, at(self.x1[i], dx1[met]), at(self.y1[i], dy1[met])))
        return joined(found, 4)

    @cached_property
    def pixels(self) -> np.ndarray:
        i, _, x, y = self.crossings
        return np.unique(np.concatenate([self.a, self.b, key(self.g[i], x, y)]))

    @cached_property
    def at(self) -> tuple:
        """(g, x, y) of each vertex."""
        return self.pixels >> WHOLE, self.pixels >> SIDE & LOW, self.pixels & LOW

    @cached_property
    def hits(self) -> tuple:
        """(segment, vertex): each hot pixel that each segment meets."""
        pg, px, py = self.at
        h = self.mean(self.g, self.dx) + 2
        strip = key(pg, px // h[pg], py)
        order = np.argsort(strip)
        strip = strip[order]
        mine = h[self.g]
        low = np.maximum(self.x1 - 1, 0) // mine
        s, k = expanded((self.x2 + 1) // mine - low + 1)
        column = low[s] + k
        # the segment's heights above the strip, widened by a pixel
        left, right = column * mine[s] - 1, (column + 1) * mine[s]
        x1, x2 = self.x1[s], self.x2[s]
        slope = (self.dy / np.maximum(self.dx, 1))[s]
        ya, yb = (self.y1[s] + slope * (np.clip(x, x1, x2) - x1) for x in (left, right))
        steep = self.dx[s] == 0
        y_low = np.where(steep, self.y_low[s], np.floor(np.minimum(ya, yb))).astype(np.int64) - 1
        y_high = np.where(steep, self.y_high[s], np.ceil(np.maximum(ya, yb))).astype(np.int64) + 1
        y_low, y_high = np.maximum(np.maximum(y_low, self.y_low[s] - 1), 0), np.minimum(np.minimum(y_high, self.y_high[s] + 1), LOW)
        begin = np.searchsorted(strip, key(self.g[s], column, y_low))
        counts, found = np.maximum(np.searchsorted(strip, key(self.g[s], column, y_high), "right") - begin, 0), []
        for part in blocks(counts):
            i, k = expanded(counts[part])
            i += part.start
            v = order[begin[i] + k]
            i = s[i]
            x, y = px[v], py[v]
            dx, dy, fx, fy = self.dx[i], self.dy[i], x - self.x1[i], y - self.y1[i]
            reach = dx + np.abs(dy)
            head, tail, off = 2 * (fx * dx + fy * dy) + reach, 2 * ((dx - fx) * dx + (dy - fy) * dy) + reach, fx * dy - fy * dx
            # exact.pixel_hit, of segments that begin at the lesser end
            corner = ((off >= 0) & (dy <= 0)) | ((off < 0) & (dx == 0))
            far = 2 * np.abs(off)
            hit = (fx >= -1) & (fx <= dx + 1) & ((head > 0) | ((head == 0) & (dy >= 0))) & (tail > 0) & ((far < reach) | ((far == reach) & corner))
            found.append((i[hit], v[hit]))
        return joined(found, 2)

    @cached_property
    def sub_edges(self) -> tuple:
        """(from, to, m): from vertex to vertex along each segment."""
        s, v = self.hits
        _, x, y = self.at
        along = x[v] * (self.dx[s] > 0) + y[v] * np.sign(self.dy[s])
        order = np.argsort((s << 23) | (along + (1 << SIDE)))
        s, v = s[order], v[order]
        on = np.flatnonzero(s[1:] == s[:-1])
        return v[on], v[on + 1], self.m[s[on]]

    @cached_property
    def edges(self) -> tuple:
        """(from, to, power)."""
        v, w, m = self.sub_edges
        pair = (np.minimum(v, w) << 32) | np.maximum(v, w)
        order = np.argsort(pair)
        pair, m = pair[order], np.where(v < w, m, -m)[order]
        first = starts_of(pair)
        pair, m = pair[first], summed(m, first)
        pair, m = pair[m != 0], m[m != 0]
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return np.where(m > 0, a, b), np.where(m > 0, b, a), np.abs(m)

    # winding numbers

    @cached_property
    def winding(self) -> np.ndarray:
        """w_right of each edge; see operators/winding.py for the method."""
        s, e, power = self.edges
        pg, px, py = self.at
        g, sx, sy, ex, ey = pg[s], px[s], py[s], px[e], py[e]
        cell = self.mean(g, np.maximum(np.abs(ex - sx), np.abs(ey - sy))) * 3 // 2 + 1
        h = cell[g]
        up, right = sy < ey, sx < ex
        ax, ay, bx, by = np.where(up, sx, ex), np.where(up, sy, ey), np.where(up, ex, sx), np.where(up, ey, sy)
        lx, ly, rx, ry = np.where(right, sx, ex), np.where(right, sy, ey), np.where(right, ex, sx), np.where(right, ey, sy)
        p_up = np.where(sy == ey, 0, np.where(up, power, -power))
        p_over = np.where(sx == ex, 0, np.where(right, -power, power))
        # what crosses the rows' lower lines, and its sums from the left
        i, k = expanded(by // h - ay // h)
        row = ay[i] // h[i] + 1 + k
        den = 2 * (by - ay)[i]
        num = ax[i] * den + (2 * row * h[i] - 1 - 2 * ay[i]) * (bx - ax)[i]
        event = key(g[i], row, -(-(2 * num + den) // (2 * den * h[i])))
        order = np.argsort(event)
        event, sums = event[order], offsets_of(p_up[i][order])
        mx, my = sx + ex, sy + ey
        c, r = (mx + 1) // (2 * h), (my + 1) // (2 * h)
        w = sums[np.searchsorted(event, key(g, r, c), "right")] - sums[np.searchsorted(event, key(g, r, 0))]
        # edges by the cells that they may touch
        low = np.maximum(lx - 1, 0) // h
        i, k = expanded((rx + 1) // h - low + 1)
        column = low[i] + k
        slope = ((ry - ly) / np.maximum(rx - lx, 1))[i]
        ya, yb = (ly[i] + slope * (np.clip(x, lx[i], rx[i]) - lx[i]) for x in (column * h[i] - 2, (column + 1) * h[i] + 2))
        steep = (lx == rx)[i]
        bottom = np.where(steep, ay[i], np.floor(np.minimum(ya, yb))).astype(np.int64) - 2
        top = np.where(steep, by[i], np.ceil(np.maximum(ya, yb))).astype(np.int64) + 2
        bottom, top = np.maximum(np.maximum(bottom, ay[i] - 1), 0) // h[i], np.minimum(top, by[i] + 1) // h[i]
        j, k = expanded(top - bottom + 1)
        held = key(g[i][j], bottom[j] + k, column[j])
        order = np.argsort(held)
        held, owner = held[order], i[j][order]
        ask = key(g, r, c)
        begin = np.searchsorted(held, ask)
        counts = np.searchsorted(held, ask, "right") - begin
        low, left = 2 * r * h - 1, 2 * c * h - 1
        ax2, ay2, by2, lx2, ly2, rx2 = 2 * ax, 2 * ay, 2 * by, 2 * lx, 2 * ly, 2 * rx
        for part in blocks(counts):
            i, k = expanded(counts[part])
            i += part.start
            f = owner[begin[i] + k]
            # few pairs get past these: an edge with the cell's lower line between its ends, or above or below the midpoint
            low2, mx2 = low[i], mx[i]
            line = np.flatnonzero((ay2[f] < low2) & (low2 < by2[f]))
            over = np.flatnonzero((lx2[f] <= mx2) & (mx2 < rx2[f]))
            ask, e = i[line], f[line]
            rise = by[e] - ay[e]
            num = ax2[e] * rise + (low2[line] - ay2[e]) * (bx[e] - ax[e])
            crossed = (num > left[ask] * rise) & (num <= mx2[line] * rise)
            np.add.at(w, ask[crossed], p_up[e[crossed]])
            ask, e, low2, mx2, my2 = i[over], f[over], low2[over], mx2[over], my[i[over]]
            run = rx[e] - lx[e]
            y = ly2[e] * run + (mx2 - lx2[e]) * (ry[e] - ly[e])
            itself = ask == e
            passed = ~itself & (y < my2 * run) & ((y > low2 * run) | ((y == low2 * run) & (ry[e] > ly[e])))
            np.add.at(w, ask[passed], p_over[e[passed]])
        # an edge that falls through its own midpoint on the line has been crossed there, in the corner's sum or as another's
        own = (my == low) & (rx > lx) & (ry < ly)
        w = w - np.where(own, p_up, 0)
        return np.where(np.where(sx == ex, up, right), w, w + power)

    def boundary(self, kept: np.ndarray) -> tuple:
        """(from, to) with the kept face on the right, sorted."""
        s, e, power = self.edges
        right, left = kept[self.winding + MOST], kept[self.winding - power + MOST]
        edge = (right != left) & (right < 2) & (left < 2)
        s, e, right = s[edge], e[edge], right[edge] == 1
        s, e = np.where(right, s, e), np.where(right, e, s)
        order = np.argsort((s << 32) | e)
        return s[order], e[order]

    def turn(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        _, x, y = self.at
        return x[e] * y[s] - x[s] * y[e]

    # the graph

    @cached_property
    def degrees(self) -> tuple:
        """(n_out, n_in, p_out, p_in) of each vertex, also of those without edges."""
        s, e, power = self.edges
        n = len(self.pixels)
        p_out, p_in = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(p_out, s, power)
        np.add.at(p_in, e, power)
        return np.bincount(s, minlength=n), np.bincount(e, minlength=n), p_out, p_in

    def spokes(self, s: np.ndarray, e: np.ndarray) -> tuple:
        """(vertex, other end, edge, whether it starts there, place, following): edges around each vertex, counter-clockwise from -x.

        Two directions of narrow terms differ by far more than a double's last place.
        """
        _, x, y = self.at
        v, o = np.concatenate([s, e]), np.concatenate([e, s])
        dx, dy = x[o] - x[v], y[o] - y[v]
        order = np.lexsort((np.where((dy == 0) & (dx < 0), -np.pi, np.arctan2(dy, dx)), v))
        v, o = v[order], o[order]
        first = starts_of(v)
        counts = np.diff(np.append(first, len(v)))
        _, place = expanded(counts)
        following = np.arange(1, len(v) + 1)
        following[first + counts - 1] = first
        return v, o, order % max(len(s), 1), order < len(s), place, following

    @cached_property
    def linked(self) -> tuple:
        """(vertex, the least of its component) of vertices with edges."""
        s, e, _ = self.edges
        label = components(len(self.pixels), s, e)
        n_out, n_in, _, _ = self.degrees
        v = np.flatnonzero(n_out + n_in)
        return v, label[v]

    def chains(self) -> tuple:
        """(edges by chain and in its order, first of each chain, whether closed)."""
        s, e, _ = self.edges
        n_out, n_in, p_out, p_in = self.degrees
        inner = (n_out == 1) & (n_in == 1) & (p_out == p_in)
        into = np.zeros(len(self.pixels), np.int64)
        into[e] = np.arange(len(e))
        begins = ~inner[s]
        before = np.where(begins, np.arange(len(s)), into[s])
        label = components(len(s), np.arange(len(s)), before)
        cycle = np.ones(len(s), bool)
        cycle[label[begins]] = False
        cycle = np.flatnonzero(cycle[label])
        # a cycle begins at its least vertex
        cycle = cycle[np.lexsort((s[cycle], label[cycle]))]
        cut = cycle[starts_of(label[cycle])]
        before[cut] = cut
        head, far = ranked(before)
        order = np.lexsort((far, head))
        first = starts_of(head[order])
        return order, first, ~begins[order[first]]

    def rays(self, g: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The edge that a ray from each point to -x meets first, or -1; see rings.ray_nearest."""
        pg, px, py = self.at
        up = py[s] < py[e]
        ax, ay, bx, by = (px[np.where(up, s, e)], py[np.where(up, s, e)], px[np.where(up, e, s)], py[np.where(up, e, s)])
        eg = pg[s]
        h = self.mean(eg, by - ay) + 1
        i, k = expanded(np.where(ay < by, (by - 1) // h[eg] - ay // h[eg] + 1, 0))
        band = key(eg[i], ay[i] // h[eg][i] + k, 0)
        order = np.argsort(band)
        band, owner = band[order], i[order]
        asked = key(g, y // h[g], 0)
        begin = np.searchsorted(band, asked)
        counts = np.searchsorted(band, asked, "right") - begin
        nearest = np.full(len(x), -1)
        for part in blocks(counts):
            i, k = expanded(counts[part])
            i += part.start
            f = owner[begin[i] + k]
            rise, run = by[f] - ay[f], bx[f] - ax[f]
            num = (y[i] - ay[f]) * run
            met = (ay[f] <= y[i]) & (y[i] < by[f]) & ((x[i] - ax[f]) * rise > num)
            i, f, rise, run, num = i[met], f[met], rise[met], run[met], num[met]
            order = np.lexsort((run / rise, num % rise / rise, ax[f] + num // rise, i))
            i, f = i[order], f[order]
            last = np.append(starts_of(i)[1:], len(i)) - 1 if len(i) else starts_of(i)
            nearest[i[last]] = f[last]
        return nearest

    def rings(self, kept: np.ndarray) -> tuple:
        """(from, to, edges by ring and in its order, first of each ring, area2): rings in the order of their least edge, where they begin."""
        s, e = self.boundary(kept)
        _, _, edge, out, _, following = self.spokes(s, e)
        arrives = np.flatnonzero(~out)
        leaves = following[arrives]
        if not out[leaves].all():
            raise ValueError("boundary edges don't close")
        before = np.empty(len(s), np.int64)
        before[edge[leaves]] = edge[arrives]
        name = components(len(s), np.arange(len(s)), before)
        least = np.flatnonzero(name == np.arange(len(s)))
        before[least] = least
        head, far = ranked(before)
        order = np.lexsort((far, head))
        first = starts_of(head[order])
        return s, e, order, first, summed(self.turn(s, e)[order], first)

    # rows to send

    def x_of(self, v: np.ndarray) -> np.ndarray:
        g, x, _ = self.at
        return x[v] + self.ox[g[v]]

    def y_of(self, v: np.ndarray) -> np.ndarray:
        g, _, y = self.at
        return y[v] + self.oy[g[v]]

    def ends_of(self, *vertices: np.ndarray) -> list:
        return [c for v in vertices for c in (self.x_of(v), self.y_of(v))]

    def segment(self, i: np.ndarray) -> list:
        ox, oy = self.ox[self.g[i]], self.oy[self.g[i]]
        return [self.x1[i] + ox, self.y1[i] + oy, self.x2[i] + ox, self.y2[i] + oy]

    def points(self, v: np.ndarray, of=np.int64) -> pa.Array:
        return pa.StructArray.from_arrays([self.x_of(v).astype(of), self.y_of(v).astype(of)], ["x", "y"])

    def closed(self, s: np.ndarray, order: np.ndarray, first: np.ndarray) -> tuple:
        """(vertices of each ring, its first one again at the end; how many)."""
        counts = np.diff(np.append(first, len(order)))
        ring, k = expanded(counts + 1)
        return s[order[first[ring] + k % counts[ring]]], counts + 1


def _crossings(a: Groups, kept):
    i, j, x, y = a.crossings
    g = a.g[i]
    return g, [*a.segment(i), *a.segment(j), x + a.ox[g], y + a.oy[g]]


def _pixels(a: Groups, kept):
    v = np.arange(len(a.pixels))
    return a.at[0], a.ends_of(v)


def _hits(a: Groups, kept):
    i, v = a.hits
    return a.g[i], [*a.segment(i), a.m[i], *a.ends_of(v)]


def _sub_edges(a: Groups, kept):
    v, w, m = a.sub_edges
    return a.at[0][v], [*a.ends_of(v, w), m]


def _edges(a: Groups, kept):
    s, e, power = a.edges
    return a.at[0][s], [*a.ends_of(s, e), power]


def _faces(a: Groups, kept):
    s, e, power = a.edges
    return a.at[0][s], [*a.ends_of(s, e), power, a.winding, a.winding - power]


def _boundary(a: Groups, kept):
    s, e = a.boundary(kept)
    return a.at[0][s], a.ends_of(s, e)


def _area2(a: Groups, kept):
    s, e = a.boundary(kept)
    total = np.zeros(a.n, np.int64)
    np.add.at(total, a.at[0][s], a.turn(s, e))
    g = np.flatnonzero(total)
    return g, [total[g]]


def _depths(a: Groups, kept):
    s, e, power = a.edges
    turn, g = a.turn(s, e), a.at[0][s]
    g, depth, turn = np.concatenate([g, g]), np.concatenate([a.winding, a.winding - power]), np.concatenate([turn, -turn])
    order = np.lexsort((depth, g))
    g, depth, turn = g[order], depth[order], turn[order]
    first = starts_of(g, depth)
    g, depth, total = g[first], depth[first], summed(turn, first)
    some = (depth != 0) & (total != 0)
    return g[some], [depth[some], total[some]]


def _degrees(a: Groups, kept):
    v, _ = a.linked
    return a.at[0][v], [*a.ends_of(v), *[d[v] for d in a.degrees]]


def _angular_order(a: Groups, kept):
    v, o, _, out, place, _ = a.spokes(*a.edges[:2])
    _, x, y = a.at
    return a.at[0][v], [*a.ends_of(v), place.astype(np.int32), x[o] - x[v], y[o] - y[v], out]


def _next_half_edges(a: Groups, kept):
    v, o, _, _, _, following = a.spokes(*a.edges[:2])
    return a.at[0][v], a.ends_of(o, v, o[following])


def _components(a: Groups, kept):
    v, root = a.linked
    g = a.at[0]
    roots, which, size = np.unique(root, return_inverse=True, return_counts=True)
    number = np.arange(len(roots)) - np.searchsorted(g[roots], g[roots])
    return g[v], [*a.ends_of(v, root), number[which], size[which]]


def _component_rays(a: Groups, kept):
    g, x, y = a.at
    root = np.unique(a.linked[1])
    s, e, _ = a.edges
    near = a.rays(g[root], x[root], y[root], s, e)
    none = near < 0
    near = np.maximum(near, 0)
    return g[root], [*a.ends_of(root), *[pa.array(c, mask=none) for c in a.ends_of(s[near], e[near])]]


def _chains(a: Groups, kept):
    s, e, power = a.edges
    order, first, closed = a.chains()
    counts = np.diff(np.append(first, len(order)))
    chain, k = expanded(counts + 1)
    last = k == counts[chain]
    at = order[first[chain] + k - last]
    path = in_lists(offsets_of(counts + 1), a.points(np.where(last, e[at], s[at])))
    return a.at[0][s[order[first]]], [summed(power[order], first, np.minimum), closed, path]


def _rings(a: Groups, kept):
    s, e, order, first, area2 = a.rings(kept)
    points, counts = a.closed(s, order, first)
    named = order[first]
    return a.at[0][s[named]], [*a.ends_of(s[named], e[named]), area2, in_lists(offsets_of(counts), a.points(points, np.int32))]


def _polygons(a: Groups, kept):
    s, e, order, first, area2 = a.rings(kept)
    pg, px, py = a.at
    named = order[first]
    ring_of = np.empty(len(s), np.int64)
    ring_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    hole = np.flatnonzero(area2 < 0)
    p = s[named[hole]]
    near = a.rays(pg[p], px[p], py[p], s, e)
    seen = near >= 0
    face = components(len(first), hole[seen], ring_of[near[seen]])
    if (np.bincount(face[area2 > 0], minlength=len(first)) != (np.bincount(face, minlength=len(first)) > 0)).any():
        raise ValueError("a face without exactly one outer ring")
    outer = np.flatnonzero(area2 > 0)
    of_face = np.empty(len(first), np.int64)
    of_face[face[outer]] = np.arange(len(outer))
    polygon = of_face[face[hole]]
    hole = hole[np.argsort(polygon, kind="stable")]
    holes = np.bincount(polygon, minlength=len(outer))

    def lists(rings: np.ndarray) -> pa.Array:
        counts = np.diff(np.append(first, len(order)))[rings]
        ring, k = expanded(counts + 1)
        return in_lists(offsets_of(counts + 1), a.points(s[order[first[rings][ring] + k % counts[ring]]], np.int32))

    whole = pa.StructArray.from_arrays([lists(outer), in_lists(offsets_of(holes), lists(hole))], ["outer_ring", "inner_rings"])
    g = pg[s[named[outer]]]
    begin = starts_of(g)
    return g[begin], [in_lists(np.append(begin, len(g)), whole)]


def _validity(a: Groups, kept):
    v, _, m = a.sub_edges
    s, _, power = a.edges
    g = a.at[0]
    one = np.isin(a.winding, (0, 1)) & np.isin(a.winding - power, (0, 1)) & (power == 1)
    count = lambda rows: np.bincount(rows, minlength=a.n)
    steps, edges = count(g[v]), count(g[s])
    ok = (steps == edges) & (count(g[v][np.abs(m) != 1]) == 0) & (count(g[s][~one]) == 0)
    some = np.flatnonzero(steps)
    return some, [ok[some]]


_EDGE, _POINT = "sx long, sy long, ex long, ey long", "array<struct<x:{0},y:{0}>>"
_RING = _POINT.format("int")
#: What can be asked of groups: the fields beside gid, and what makes them.
PRODUCTS: dict[str, tuple[str, Callable]] = {
    "crossings": ("x1 long, y1 long, x2 long, y2 long, o_x1 long, o_y1 long, o_x2 long, o_y2 long, x long, y long", _crossings),
    "pixels": ("x long, y long", _pixels),
    "hits": ("x1 long, y1 long, x2 long, y2 long, m long, x long, y long", _hits),
    "sub_edges": (f"{_EDGE}, m long", _sub_edges),
    "edges": (f"{_EDGE}, power long", _edges),
    "faces": (f"{_EDGE}, power long, w_right long, w_left long", _faces),
    "boundary": (_EDGE, _boundary),
    "area2": ("area2 long", _area2),
    "depths": ("depth long, area2 long", _depths),
    "degrees": ("x long, y long, n_out long, n_in long, p_out long, p_in long", _degrees),
    "angular_order": ("vx long, vy long, place int, dx long, dy long, forward boolean", _angular_order),
    "next_half_edges": (f"{_EDGE}, nx long, ny long", _next_half_edges),
    "components": ("x long, y long, cx long, cy long, component long, size long", _components),
    "component_rays": ("x long, y long, near_sx long, near_sy long, near_ex long, near_ey long", _component_rays),
    "chains": (f"power long, closed boolean, path {_POINT.format('long')}", _chains),
    "rings": (f"rx long, ry long, rex long, rey long, area2 long, ring {_RING}", _rings),
    "polygons": (f"geometry array<struct<outer_ring:{_RING},inner_rings:array<{_RING}>>>", _polygons),
    "validity": ("is_valid boolean", _validity),
}


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ROWS rows, from batches sorted by h."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            h = table["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut).combine_chunks()
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def asked(steps: DataFrame, product: str, kept: np.ndarray | None = None) -> DataFrame:
    """(gid, the product's fields) of every group of steps (gid, x1, y1, x2, y2), none of them too large."""
    fields, make = PRODUCTS[product]
    ends = ["x1", "y1", "x2", "y2"]
    rows = steps.select(F.xxhash64("gid").alias("h"), "gid", *[F.col(c).cast("long").alias(c) for c in ends]).repartition("h").sortWithinPartitions("h")
    schema = T.StructType([rows.schema["gid"], *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            h = table["h"].to_numpy()
            first = starts_of(h)
            g = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            at, columns = make(Groups(g, *[table[c].to_numpy() for c in ends]), kept)
            gid = table["gid"].combine_chunks().take(pa.array(first)).take(pa.array(at))
            out = pa.RecordBatch.from_arrays([gid, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], schema.names)
            for k in range(0, out.num_rows, ROWS):
                yield out.slice(k, ROWS)

    return rows.mapInArrow(run, schema)
