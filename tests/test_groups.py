"""Whole groups in one task against joins, and which groups go where."""

import random

import pytest
from pyspark.sql import functions as F

from planeweave.operators import groups
from planeweave.plans.overlay import Overlay
from planeweave.sources.geometry import MULTIPOLYGON


def _layer(spark, n_groups=6, seed=1):
    """Groups of rings in tight, wide and long shapes: touching, crossing themselves, repeated, turned round, of no area."""
    r = random.Random(seed)
    rows = []
    for k in range(n_groups):
        wide, high, far = [(6, 6), (12, 40), (300, 7), (60, 60), (3, 90), (25, 25)][k % 6] + (r.randint(-10**6, 10**6),)
        for _ in range(9):
            ring = [(far + r.randint(0, wide), r.randint(0, high) - far) for _ in range(r.randint(1, 5))]
            rows += [(k, [(ring, [])])] * r.choice([1, 1, 2]) + [(k, [(ring[::-1], [])])] * r.choice([0, 0, 1])
        rows.append((k, [([(far, -far), (far, 9 - far), (far + 9, 9 - far), (far + 9, -far)], [[(far + 3, 3 - far), (far + 6, 3 - far), (far + 6, 6 - far), (far + 3, 6 - far), (far + 3, 3 - far)]])]))
    return spark.createDataFrame(rows, f"k long, geometry {MULTIPOLYGON}").cache()


def _rows(df):
    return sorted(repr(sorted((k, str(v)) for k, v in r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def both(spark):
    layer = _layer(spark)
    return [Overlay(layer, keys=["k"], keep=lambda w: (w > 0) & (w != 3), joins=joins) for joins in (False, True)]


@pytest.mark.parametrize("product", sorted(groups.PRODUCTS))
def test_same_as_joins(both, product):
    whole, joins = (_rows(o.ask(product)) for o in both)
    assert whole == joins


def test_large_groups_go_to_joins(spark, monkeypatch):
    layer = _layer(spark, 3)
    want = _rows(Overlay(layer, keys=["k"]).area2())
    monkeypatch.setattr(groups, "MOST_HITS", 2000)
    mixed = Overlay(layer, keys=["k"])
    taken = [mixed.small.select("gid").distinct().count(), mixed.joined.bag.select("gid").distinct().count()]
    assert min(taken) > 0 and sum(taken) == 3
    assert _rows(mixed.area2()) == want


def test_one_hash_of_two_groups(spark):
    """xxhash64 passes over nulls, so (null, 5) and (5, null) share theirs; both are whole, and apart."""
    box = [([(0, 0), (0, 1), (1, 1), (1, 0)], [])]
    layer = spark.createDataFrame([(None, 5, box), (5, None, box), (5, None, box), (7, 7, box)], f"a long, b long, geometry {MULTIPOLYGON}")
    got = Overlay(layer, keys=["a", "b"]).edges.groupBy("gid.a", "gid.b").agg(F.sum("power").alias("p"))
    assert {(r.a, r.b): r.p for r in got.collect()} == {(None, 5): 4, (5, None): 8, (7, 7): 4}


def test_small_groups_are_shuffled_once(spark):
    """No joins, no running sums and no written rounds for them: one exchange of steps."""
    plan = Overlay(_layer(spark, 1), keys=["k"]).ask("polygons")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_batches_keep_groups_whole(spark, monkeypatch):
    layer = _layer(spark, 6, 2)
    want = _rows(Overlay(layer, keys=["k"]).ask("faces"))
    steps = Overlay(layer, keys=["k"]).small.select(F.xxhash64("gid").alias("h"), "gid", "x1", "y1", "x2", "y2").orderBy("h").toArrow()
    monkeypatch.setattr(groups, "ROWS", 50)
    monkeypatch.setattr(groups, "PAIRS", 7)
    tables = list(groups.whole(iter(steps.to_batches(max_chunksize=11))))
    assert sum(t.num_rows for t in tables) == steps.num_rows and len(tables) > 1
    hashes = [set(t["h"].to_pylist()) for t in tables]
    assert sum(map(len, hashes)) == len(set().union(*hashes)) == 6
    made = 0
    for t in tables:
        h = t["h"].to_numpy()
        first = groups.starts_of(h)
        a = groups.Groups((h[:, None] != h[first]).argmin(1), *[t[c].to_numpy() for c in ("x1", "y1", "x2", "y2")])
        made += len(a.winding)
    assert made == len(want)
