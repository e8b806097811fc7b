"""Queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from planeweave.plans import catalog

SF = "/root/testdata/sf0.001"
CHEAP = ["selfor_area", "difference_area", "depth_histogram", "tri_intersection_area", "half_edge_winding", "edge_power", "chains", "closed_chains", "ring_areas", "component_rays", "frame_difference_polygons", "next_half_edge", "ring_segments", "ring_reverse", "wkt_roundtrip", "segment_scalars", "bbox_overlap_pairs", "grid_cell_counts", "grid_ray_left"]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", CHEAP)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = catalog.QUERIES[name](spark, SF), con.execute(catalog.SQL[name])
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["gid", "area2"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
