"""Media columns: edited and cropped copies of images by local descriptors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planeweave.operators.graph import connected_components
from planeweave.plans.storage import materialize

RADIUS, BITS, TURNS, SUB = 9, 128, 24, 4  # SUB: positions are kept in quarters of a pixel
_rng = np.random.default_rng(7)
_spots = _rng.normal(0, 4.0, (BITS, 2, 2))
_spots *= np.minimum(1, 8.0 / np.linalg.norm(_spots, axis=2, keepdims=True))
_angles = 2 * np.pi * np.arange(TURNS) / TURNS
_spin = np.stack([np.stack([np.cos(_angles), -np.sin(_angles)], 1), np.stack([np.sin(_angles), np.cos(_angles)], 1)], 1)
#: Where each binary test looks, by orientation: (turn, test, side, x and y).
SPOTS = np.rint(np.einsum("tij,bsj->tbsi", _spin, _spots)).astype(np.int64)
_yy, _xx = np.mgrid[-7:8, -7:8]
_disk = (_xx**2 + _yy**2 <= 49).astype(float)
#: A corner as it is stored: place, level, turn, descriptor.
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("level", "u1"), ("turn", "u1"), ("bits", "<u8", (2,))])


def _box(a: np.ndarray) -> np.ndarray:
    """3 by 3 means over the last two axes, edges repeated."""
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), "edge")
    r = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return (r[:, :, :-2] + r[:, :, 1:-1] + r[:, :, 2:]) / 9


def _shrunk(a: np.ndarray, factor: float) -> np.ndarray:
    """Every image smaller by the factor, by bilinear interpolation."""
    h, w = a.shape[1:]
    y, x = (np.clip((np.arange(int(n / factor)) + 0.5) * factor - 0.5, 0, n - 1) for n in (h, w))
    y0, x0 = np.minimum(y.astype(int), h - 2), np.minimum(x.astype(int), w - 2)
    rows = a[:, y0] * (1 - (y - y0))[None, :, None] + a[:, y0 + 1] * (y - y0)[None, :, None]
    return rows[:, :, x0] * (1 - (x - x0)) + rows[:, :, x0 + 1] * (x - x0)


def describe(images: np.ndarray, apart: int = 2, chunk: int = 8192) -> list[np.ndarray]:
    """The corners (CORNER) of each image of a stack (n, height, width).

    Corners are all places whose Harris response is the largest within ``apart`` pixels, at every level of a pyramid whose
    levels shrink by the square root of two until the tests no longer fit; how many there are grows with the picture. A
    corner's orientation is that of its intensity centroid, in TURNS steps; the binary tests are turned by it. Adding to all
    pixels or scaling them changes neither.
    """
    base = images.astype(float)
    level, depth, found, m = base, 0, [], RADIUS
    while min(level.shape[1:]) >= 2 * RADIUS + 3:
        h, w = level.shape[1:]
        smooth = _box(level)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        xx, yy, xy = (_box(_box(a)) for a in (gx * gx, gy * gy, gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[:, m : h - m, m : w - m]
        peak = inner > 1e-6
        for dy in range(-apart, apart + 1):
            for dx in range(-apart, apart + 1):
                if dx or dy:
                    peak &= inner > r[:, m + dy : h - m + dy, m + dx : w - m + dx]
        at = np.stack(np.nonzero(peak), 1)
        for a in range(0, len(at), chunk):
            i, y, x = at[a : a + chunk].T + np.array([[0], [m], [m]])
            patch = smooth[i[:, None, None], y[:, None, None] + _yy, x[:, None, None] + _xx] * _disk
            angle = np.arctan2((patch * _yy).sum((1, 2)), (patch * _xx).sum((1, 2)))
            turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
            spot = SPOTS[turn]
            v = smooth[i[:, None, None], y[:, None, None] + spot[..., 1], x[:, None, None] + spot[..., 0]]
            rows = np.zeros(len(i), CORNER)
            rows["x"], rows["y"] = (np.rint(SUB * ((c + 0.5) * 2 ** (depth / 2) - 0.5)) for c in (x, y))
            rows["level"], rows["turn"] = depth, turn
            rows["bits"] = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1).view("<u8")
            found.append((i, rows))
        depth += 1
        level = _shrunk(_box(base) if depth < 3 else _box(_box(base)), 2 ** (depth / 2))
    if not found:
        return [np.zeros(0, CORNER)] * len(images)
    i, rows = np.concatenate([i for i, _ in found]), np.concatenate([r for _, r in found])
    order = np.argsort(i, kind="stable")
    return np.split(rows[order], np.searchsorted(i[order], np.arange(1, len(images))))


def constellations(corners: np.ndarray, near: int = 2, tables: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(keys, corner of each): for each corner, each of the nearest others of its level, and each table, a hash of a 32-bit word
    of both descriptors and of the turn between them. A key comes once, with its first corner."""
    keys, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for depth in np.unique(corners["level"]):
        at = np.flatnonzero(corners["level"] == depth)
        r = corners[at]
        if len(at) < 2:
            continue
        nearest = np.empty((len(at), min(near, len(at) - 1)), np.int64)
        for a in range(0, len(at), 512):
            part = r[a : a + 512]
            d = (part["x"][:, None] - r["x"][None, :]).astype(float) ** 2 + (part["y"][:, None] - r["y"][None, :]).astype(float) ** 2
            d[np.arange(len(part)), np.arange(a, a + len(part))] = np.inf
            nearest[a : a + 512] = np.argsort(d, 1, kind="stable")[:, : nearest.shape[1]]
        words = r["bits"].reshape(-1, 2).view("<u4").astype(np.uint64)
        for j in nearest.T:
            between = (r["turn"][j].astype(np.int64) - r["turn"]) % TURNS
            for t in range(tables):
                h = words[:, t] * np.uint64(0x9E3779B97F4A7C15) ^ (words[j, t] + (between.astype(np.uint64) << np.uint64(32)) + (np.uint64(t) << np.uint64(40))) * np.uint64(0xBF58476D1CE4E5B9)
                keys.append((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB))
                owner.append(at)
    key, first = np.unique(np.concatenate(keys), return_index=True)
    return key.view(np.int64), np.concatenate(owner)[first]


def consensus_of(a: np.ndarray, b: np.ndarray, most_bits: int = 12, bin_px: int = 6, chunk: int = 512) -> int:
    """The most corners of a that meet corners of b within most_bits and agree on one similarity: turn, step of levels, and a shift
    within a bin of bin_px (on two overlapping grids)."""
    pairs = [np.empty((0, 2), np.int64)]
    for i in range(0, len(a), chunk):
        d = np.bitwise_count(a["bits"][i : i + chunk, None, :] ^ b["bits"][None, :, :]).sum(2)
        pairs.append(np.argwhere(d <= most_bits) + [i, 0])
    i, j = np.concatenate(pairs).T
    if not len(i):
        return 0
    p, q = a[i], b[j]
    turn, step = (q["turn"].astype(np.int64) - p["turn"]) % TURNS, q["level"].astype(np.int64) - p["level"]
    cos, sin, scale = np.cos(turn * (2 * np.pi / TURNS)), np.sin(turn * (2 * np.pi / TURNS)), 2.0 ** (step / 2)
    shift = np.stack([q["x"] - scale * (cos * p["x"] - sin * p["y"]), q["y"] - scale * (sin * p["x"] + cos * p["y"])], 1)
    best = 0
    for grid in (0, bin_px * SUB / 2):
        bins = np.floor((shift + grid) / (bin_px * SUB)).astype(np.int64)
        votes = np.unique(np.column_stack([turn, step, bins, i]), axis=0)
        best = max(best, int(np.unique(votes[:, :4], axis=0, return_counts=True)[1].max()))
    return best


def descriptors(images: DataFrame, pixels_at_once: int = 1 << 20) -> DataFrame:
    """(image, digest, corners: CORNER bytes), one row an image, written; digest tells equal pixels of one size."""

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes = [(int(h), int(w)) if isinstance(p, (bytes, bytearray)) and w > 0 and h > 0 and len(p) == w * h else None for p, w, h in zip(pdf["pixels"], pdf["width"].fillna(0), pdf["height"].fillna(0))]
            found: list[bytes] = [b""] * len(pdf)
            for h, w in set(shapes) - {None}:
                at = [i for i, s in enumerate(shapes) if s == (h, w)]
                size = max(1, min(256, pixels_at_once // (h * w)))
                for a in range(0, len(at), size):
                    part = at[a : a + size]
                    for i, rows in zip(part, describe(np.stack([np.frombuffer(pdf["pixels"].iloc[i], np.uint8).reshape(h, w) for i in part]))):
                        found[i] = rows.tobytes()
            yield pd.DataFrame({"image": pdf["image"], "digest": pdf["digest"], "corners": found})

    rows = images.select("image", "width", "height", "pixels", F.sha2(F.concat_ws("|", F.col("width").cast("string"), F.col("height").cast("string"), F.hex("pixels")), 256).alias("digest"))
    return materialize(rows.mapInPandas(described, "image long, digest string, corners binary"), "corners")


def _keyed(own: DataFrame) -> DataFrame:
    """(key, image, x, y, level, turn): the constellations of every image, a key once in an image."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, images, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.zeros(0, CORNER)]
            for image, b in zip(pdf["image"], pdf["corners"]):
                corners = np.frombuffer(b, CORNER)
                k, at = constellations(corners)
                keys.append(k)
                images.append(np.full(len(k), image))
                rows.append(corners[at])
            r = np.concatenate(rows)
            yield pd.DataFrame({"key": np.concatenate(keys), "image": np.concatenate(images), **{c: r[c].astype(np.int32) for c in ("x", "y", "level", "turn")}})

    return own.mapInPandas(made, "key long, image long, x int, y int, level int, turn int")


def _agreeing(pairs: DataFrame, bin_px: int) -> DataFrame:
    """(a, b): images of which two corners or more agree on a similarity, of pairs (p, q) of corners that share a key.

    Votes are summed by bin before they are sent: a bin has two corners if the least and the greatest in it differ.
    """
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    turn, step = F.pmod(q("turn") - p("turn"), F.lit(TURNS)), q("level") - p("level")
    theta, scale = turn * F.lit(2 * np.pi / TURNS), F.pow(F.lit(2.0), step / 2)
    shift = (q("x") - scale * (F.cos(theta) * p("x") - F.sin(theta) * p("y")), q("y") - scale * (F.sin(theta) * p("x") + F.cos(theta) * p("y")))
    grid = F.explode(F.array(F.lit(0.0), F.lit(bin_px * SUB / 2.0)))
    rows = pairs.select(p("image").alias("a"), q("image").alias("b"), F.struct(p("x"), p("y"), p("level")).alias("corner"), turn.alias("t"), step.alias("s"), shift[0].alias("tx"), shift[1].alias("ty"), grid.alias("g"))
    at = lambda c: F.floor((F.col(c) + F.col("g")) / (bin_px * SUB)).alias(c)
    bins = rows.select("a", "b", "corner", "t", "s", "g", at("tx"), at("ty")).groupBy("a", "b", "t", "s", "g", "tx", "ty").agg(F.min("corner").alias("low"), F.max("corner").alias("high"))
    return bins.where("low <> high").select("a", "b").distinct()


def _verified(pairs: DataFrame, own: DataFrame, most_bits: int, consensus: int, bin_px: int) -> DataFrame:
    """(src, dst) of the pairs (a, b) whose corners reach the consensus."""

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [consensus_of(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER), most_bits, bin_px) >= consensus for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]].rename(columns={"a": "src", "b": "dst"})

    x, y = (own.select(F.col("image").alias(c), F.col("corners").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(judged, "src long, dst long"), "links")


def edited_copies(images: DataFrame, id_col: str = "image", most_bits: int = 12, consensus: int = 4, bin_px: int = 6) -> DataFrame:
    """image, class_id, n_corners for every row of (image, width, height, pixels: one byte a pixel, row by row).

    Two images link if at least ``consensus`` corners of one meet corners of the other, within most_bits of 128, and agree on
    one similarity (see consensus_of); class_id is the smallest id that links and equal pixels reach. Candidates come from
    Hamming tables over constellations: a corner and a near one whose 32-bit words are equal (see constellations); two keys of
    a pair have to agree on a similarity before descriptors are compared. That is an index: recall against all pairs is
    measured in the tests.

    Equal pixels are one node. Under each key all images are first tried with the least one; after that only those that no
    link has joined yet are tried with each other, so a large group of copies takes about one comparison each. Null, empty or
    broken pixels, and images too small for a descriptor, have no corners and a class by equal pixels alone. Rows of one id
    are one node for links; each row returns. Null ids return with the class of their pixels. An empty table gives no rows.
    """
    rows = images.select(F.col(id_col).cast("long").alias("image"), "width", "height", "pixels")
    made = descriptors(rows)
    reps = made.groupBy("digest").agg(F.min("image").alias("rep"))
    own = materialize(made.join(reps, "digest").where("image = rep").groupBy("digest").agg(F.min("rep").alias("image"), F.first("corners").alias("corners")).select("image", "corners"), "own")
    by_key = W.partitionBy("key").orderBy("image")
    shared = _keyed(own).select("*", F.lag("image").over(by_key).alias("before"), F.lead("image").over(by_key).alias("after"))
    met = materialize(shared.where("before <> image or after <> image").drop("before", "after"), "met")
    corner: Column = F.struct("image", "x", "y", "level", "turn")
    least = met.groupBy("key").agg(F.min(corner).alias("p"))
    tried = materialize(_agreeing(met.select("key", corner.alias("q")).join(least, "key").where("p.image <> q.image"), bin_px), "tried")
    links = _verified(tried, own, most_bits, consensus, bin_px)
    labels = connected_components(links)

    known = met.join(labels.withColumnRenamed("node", "image"), "image", "left").select("key", corner.alias("q"), F.coalesce("component", "image").alias("of"))
    open_ = known.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high and n > 2").select("key")
    left = materialize(known.join(open_, "key"), "open")
    others = left.select("key", F.col("q").alias("p"), F.col("of").alias("p_of"))
    pairs = left.join(others, "key").where("p.image < q.image and p_of <> of")
    again = materialize(_agreeing(pairs, bin_px).join(tried, ["a", "b"], "left_anti"), "tried")
    second = _verified(again, own, most_bits, consensus, bin_px)
    if second.limit(1).count():
        labels = connected_components(links.unionByName(second))
    out = made.join(reps, "digest").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("image", F.coalesce("component", "rep", "image").alias("class_id"), F.call_function("div", F.octet_length("corners"), F.lit(CORNER.itemsize)).cast("long").alias("n_corners"))


def render(vectors: DataFrame, side: int = 64) -> DataFrame:
    """Images (image, width, height, pixels) of an embeddings table, which has no media column of its own.

    A vector's components are the amplitudes of waves over a square of side pixels. Ids that end in 1 get no picture of their own
    but that of the id before, cropped by a tenth and dimmed: copies to be found. Vectors that are null, empty or not
    finite have null pixels.
    """
    own = vectors.select(F.col("vec_id").alias("image"), F.col("embedding").cast("array<double>").alias("v"))
    before = own.select((F.col("image") + 1).alias("image"), F.col("v").alias("before")).where("image % 10 = 1").dropDuplicates(["image"])
    rows = own.join(before, "image", "left").select("image", F.coalesce("before", "v").alias("v"), F.col("before").isNotNull().alias("edited"))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[0:side, 0:side] / side
        for pdf in batches:
            sizes, pixels = [], []
            for v, edited in zip(pdf["v"], pdf["edited"]):
                v = np.array([] if v is None else v, float)
                if not len(v) or not np.isfinite(v).all():
                    sizes.append(0)
                    pixels.append(None)
                    continue
                k = np.arange(len(v))
                p, q = 1 + k % 11, 1 + (k * 7) % 13
                waves = (v[:, None] * np.cos(np.pi * np.outer(p, x[0]) + k[:, None])).T @ np.cos(np.pi * np.outer(q, x[0]) + 2.0 * k[:, None])
                low, high = waves.min(), waves.max()
                image = (waves - low) / (high - low if high > low else 1) * 250
                if edited:
                    cut = side // 20
                    image = image[cut : side - cut, cut : side - cut] * 0.8 + 20
                sizes.append(image.shape[0])
                pixels.append(np.rint(image).astype(np.uint8).tobytes())
            yield pd.DataFrame({"image": pdf["image"], "width": sizes, "height": sizes, "pixels": pixels})

    return rows.mapInPandas(drawn, "image long, width int, height int, pixels binary")


def op4_local_descriptor_copies(spark, sf_dir: str) -> DataFrame:
    return edited_copies(materialize(render(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "images"))
