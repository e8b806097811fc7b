"""Overlays against known areas and ring counts, all cases of an operation in one run, each case a group."""

import pytest
from pyspark.sql import functions as F

from planeweave.plans.overlay import Overlay, overlay
from planeweave.sources.geometry import area2, from_wkt, same_geometry


def _r(x1, y1, x2, y2):
    return f"(({x1} {y1},{x1} {y2},{x2} {y2},{x2} {y1},{x1} {y1}))"


def _h(x1, y1, x2, y2):
    return f",({x1} {y1},{x2} {y1},{x2} {y2},{x1} {y2},{x1} {y1})"


def _holed(outer, *holes):
    return _r(*outer)[:-1] + "".join(_h(*h) for h in holes) + ")"


_BIG = lambda cols, rows=range(10): _holed((0, 0, 100, 100), *[(2 + 10 * i, 2 + 10 * j, 8 + 10 * i, 8 + 10 * j) for i in cols for j in rows])
_B = _r(1, 1, 52, 99)
#: Fixed values: (a, b, twice the area, outer rings, holes); None where only the area is known.
CASES = {
    "intersection": [
        (_r(0, 0, 2, 2), _r(1, 1, 3, 3), 2, 1, 0), (_r(0, 0, 3, 3), _r(1, 1, 2, 2), 2, 1, 0), (_r(0, 0, 1, 1), _r(2, 2, 3, 3), 0, 0, 0),
        (_r(0, 0, 1, 1), _r(1, 0, 2, 1), 0, 0, 0), (_r(0, 0, 1, 1), _r(1, 1, 2, 2), 0, 0, 0), ("((0 0,3 4,3 0,0 0))", "((-1 1,-1 2,0 2,0 1,-1 1))", 0, 0, 0),
        ("((0 5,5 10,10 5,5 0,0 5))", "((5 5,10 10,15 5,10 0,5 5))", 25, 1, 0), ("((0 0,0 8,6 0,0 0))", _r(2, 2, 10, 10), 6, 1, 0),
        (_r(0, 0, 10, 10), "((3 9,6 11,13 7,10 5,3 9))", 39, 1, 0), (_r(0, 0, 8, 4), _r(4, 2, 12, 6), 16, 1, 0),
        (_holed((0, 0, 6, 6), (2, 2, 4, 4)), _r(1, 1, 5, 5), 24, None, None), (_BIG((0, 1, 2, 3, 4, 5, 9)), _B, 6396, None, None),
    ],
    "union": [
        ("((-59 867,-36 492,-182 486,-59 867))", "((-220 877,-54 821,-402 541,-808 638,-220 877))", 274510, 1, 0),
        ("((0 0,0 2,5 1,5 0,0 0))", "((3 1,0 2,5 1,3 1))", 13, 1, 0), ("((0 0,1 1,2 1,2 2,3 3,3 0,0 0))", "((0 0,0 3,3 3,2 2,1 2,1 1,0 0))", 16, 1, 1),
        ("((0 0,3 4,3 0,0 0))", "((-1 1,-1 2,0 2,0 1,-1 1))", 17, 2, 0), ("((0 5,5 10,10 5,5 0,0 5))", "((5 5,10 10,15 5,10 0,5 5))", 175, 1, 0),
        ("((0 0,0 8,6 0,0 0))", _r(2, 2, 10, 10), 166, 1, 0), (_r(0, 0, 10, 10), "((3 9,6 11,13 7,10 5,3 9))", 216, 1, 0), (_r(0, 0, 8, 4), _r(4, 2, 12, 6), 112, 1, 0),
        (_r(0, 0, 2, 2), _r(2, 2, 4, 4), 16, 2, 0), (_r(0, 0, 2, 2), _r(2, 0, 4, 2), 16, 1, 0), (_holed((0, 0, 10, 10), (2, 2, 6, 6)), _r(2, 2, 6, 6), 200, 1, 0),
        (_holed((0, 0, 10, 10), (1, 1, 4, 4), (6, 1, 9, 4)), _r(2, 2, 8, 3), 172, None, None), (_BIG(range(10)), _B, 16400, None, None), (_BIG((5,)), _B, 19280, None, None), (_BIG((0, 1, 2, 3, 4, 5, 8, 9)), _B, 17840, None, None),
    ],
    "symmetric_difference": [(_r(0, 0, 2, 2), _r(5, 5, 7, 7), 16, 2, 0), (_r(0, 0, 3, 3), _r(2, 2, 5, 5), 32, None, None), (_r(0, 0, 2, 2), _r(2, 0, 4, 2), 16, 1, 0), (_r(0, 0, 10, 10), _r(2, 2, 5, 5), 182, 1, 1)],
    "difference": [(_r(0, 0, 2, 2), _r(5, 5, 7, 7), 8, 1, 0), (_r(0, 0, 3, 3), _r(2, 2, 5, 5), 16, 1, 0), (_r(0, 0, 10, 10), _r(2, 2, 5, 5), 182, 1, 1), (_r(2, 2, 5, 5), _r(0, 0, 10, 10), 0, 0, 0), (_holed((0, 0, 10, 10), (2, 2, 6, 6)), _r(2, 2, 6, 6), 168, 1, 1)],
    "self_union": [
        ("((0 3,3 6,6 3,3 0,0 3)),((3 3,6 6,9 3,6 0,3 3))", None, 63, 1, 0), (_r(0, 0, 3, 3) + "," + _r(2, 1, 5, 4) + "," + _r(1, 2, 4, 6), None, 46, 1, 0),
        (_holed((-100, -100, -10, -10), (-40, -40, -20, -20)), None, 15400, 1, 1), ("((0 0,0 4,4 4,4 0,0 0),(0 2,2 1,2 3,0 2))", None, 28, 1, 0),
        ("((0 0,4 4,0 4,4 0,0 0))", None, 8, 1, 0), ("((0 0,4 0,4 4,0 4,0 0))", None, 0, 0, 0), (",".join(_r(i, i, i + 2, i + 2) for i in range(100)), None, 602, 1, 0),
        (_r(0, 0, 10, 10) + "," + _holed((2, 2, 8, 8), (3, 3, 7, 7)) + "," + _r(20, 0, 30, 10), None, 400, 2, 0),
        (_holed((0, 0, 20, 20), (5, 5, 15, 15)) + "," + _r(8, 8, 12, 12), None, 632, 2, 1),
    ],
}


@pytest.mark.parametrize("op", sorted(CASES))
def test_known_overlays(spark, op):
    rows = [(i, f"MULTIPOLYGON({a})", f"MULTIPOLYGON({b})" if b else None) for i, (a, b, *_) in enumerate(CASES[op])]
    df = spark.createDataFrame(rows, "case long, a string, b string")
    a, b = (df.select("case", from_wkt(F.col(c)).alias("geometry")) for c in "ab")
    got = overlay(a, None if op == "self_union" else b, ["case"], op)
    count = lambda f: F.aggregate("geometry", F.lit(0), f)
    got = {r.case: (r.area2, r.n, r.holes) for r in got.select("case", area2(F.col("geometry")).alias("area2"), F.size("geometry").alias("n"), count(lambda t, p: t + F.size(p["inner_rings"])).alias("holes")).collect()}
    for i, (_, _, twice, outer, holes) in enumerate(CASES[op]):
        found = got.get(i, (0, 0, 0))
        assert found[0] == twice, (op, i)
        assert outer is None or found[1:] == (outer, holes), (op, i, found)


def test_moved_far_and_spread_wide(spark):
    """Negative coordinates, and spreads whose products leave 64 bits, change no shape."""
    base = spark.createDataFrame([(0, "MULTIPOLYGON(((0 5,5 10,10 5,5 0,0 5)),((5 5,10 10,15 5,10 0,5 5)))")], "k long, w string").select("k", from_wkt(F.col("w")).alias("geometry"))
    moved = F.transform("geometry", lambda p: F.struct(F.transform(p["outer_ring"], lambda q: F.struct((q["x"] - 100_000).alias("x"), (q["y"] - 100_000).alias("y"))).alias("outer_ring"), p["inner_rings"].alias("inner_rings")))
    far = spark.createDataFrame([(0, "MULTIPOLYGON(((2000000000 0,2000000000 1,2000000001 1,2000000001 0,2000000000 0)))")], "k long, w string").select("k", from_wkt(F.col("w")).alias("geometry"))
    rows = base.select(F.lit(1).cast("long").alias("k"), moved.alias("geometry")).unionByName(base).unionByName(far)
    assert {r.k: r.area2 for r in Overlay(rows, keys=["k"], op="self_union", cell=1 << 22).area2().collect()} == {0: 177, 1: 175}


def test_empty_null_and_broken(spark):
    df = spark.createDataFrame([(1, "MULTIPOLYGON EMPTY"), (2, None), (None, "MULTIPOLYGON(((0 0,0 1,1 1,1 0)))"), (3, "POLYGON((1 1))")], "k long, w string")
    layer = df.select("k", from_wkt(F.col("w")).alias("geometry"), F.lit(1).alias("gid"))
    assert [(r.k, r.area2) for r in Overlay(layer, keys=["k"], op="self_union").area2().collect()] == [(None, 2)]
    assert Overlay(layer.where("false"), keys=["k"], op="self_union").area2().collect() == []


def test_all_of_int32(spark):
    """Squares with corners at +-2,000,000,000, and a hole whose ray meets two long edges that a double can't tell apart."""
    far, mid = 2_000_000_000, 1_000_000_000
    a, b = _holed((-far, -far, far, far), (-mid, -mid, mid, mid)), _r(0, -far, far, far)
    rows = spark.createDataFrame([(0, f"MULTIPOLYGON({a})", f"MULTIPOLYGON({b})")], "k long, a string, b string")
    la, lb = (rows.select("k", from_wkt(F.col(c)).alias("geometry")) for c in "ab")
    whole, hole, half = 2 * (2 * far) ** 2, 2 * (2 * mid) ** 2, far * 2 * far * 2
    both = half - hole // 2
    want = {"union": whole - hole // 2, "intersection": both, "difference": whole - hole - both, "symmetric_difference": whole - hole // 2 - both}
    for op, twice in want.items():
        got = overlay(la, lb, ["k"], op).select(area2(F.col("geometry")).alias("a")).collect()
        assert [int(r.a) for r in got] == [twice], op
    assert [int(r.area2) for r in Overlay(la, keys=["k"]).area2().collect()] == [whole - hole]


def test_same_geometry_and_validity(spark):
    rows = [
        ("MULTIPOLYGON(((0 0,0 2,0 4,4 4,4 0,0 0),(1 1,2 1,2 2,1 2,1 1)),((9 9,9 10,10 10,10 9,9 9)))", "MULTIPOLYGON(((9 10,10 10,10 9,9 9)),((4 4,4 0,0 0,0 4,4 4,4 4),(2 2,1 2,1 1,2 1,2 2)))", True, True),
        ("MULTIPOLYGON(((0 0,0 4,4 4,4 0,0 0)))", "MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0)))", False, True),
        ("MULTIPOLYGON(((0 0,0 4,4 4,4 0,0 0)),((3 3,3 5,5 5,5 3,3 3)))", None, False, False),
        ("MULTIPOLYGON(((0 0,4 4,0 4,4 0,0 0)))", "MULTIPOLYGON EMPTY", False, False),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "k long, a string, b string").select("k", from_wkt(F.col("a")).alias("geometry"), from_wkt(F.col("b")).alias("b"))
    assert [r.same for r in df.orderBy("k").select(same_geometry(F.col("geometry"), F.col("b")).alias("same")).collect()] == [r[2] for r in rows]
    assert {r.k: r.is_valid for r in Overlay(df, keys=["k"]).validity().collect()} == {i: r[3] for i, r in enumerate(rows)}


def test_wkt_is_parsed_once(spark):
    """Blanks and holes come out as before; no text is split twice, as each use of a part would write its splitting out again."""
    rows = [("multipolygon ( ( ( 0  0 ,0 4, 4 4,4 0 , 0 0) , (1 1,2 1, 2 2,1 1) ) ,((9 9,9\t10,10 10,9 9)))",), (" POLYGON((0 0, 0 1,1 1))",), ("MULTIPOLYGON EMPTY",), (None,)]
    df = spark.createDataFrame(rows, "w string").select(from_wkt(F.col("w")).alias("g"))
    ring = lambda *p: [tuple(q) for q in p]
    want = [[(ring((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)), [ring((1, 1), (2, 1), (2, 2), (1, 1))]), (ring((9, 9), (9, 10), (10, 10), (9, 9)), [])], [(ring((0, 0), (0, 1), (1, 1)), [])], [], None]
    got = [None if r.g is None else [([tuple(q) for q in p.outer_ring], [[tuple(q) for q in h] for h in p.inner_rings]) for p in r.g] for r in df.collect()]
    assert got == want
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 4
