"""Footprints raised to solids and holes filled: volumes, closed edges, and what stays open."""

import pytest
from pyspark.sql import functions as F
from test_cutting import tables, terrain, torus, volume

from orolith.operators import mesh, solids


def test_volume_is_area_times_height(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    bars = [ring((0, 0), (10, 0), (10, 2), (0, 2)), ring((0, 8), (10, 8), (10, 10), (0, 10)), ring((0, 0), (2, 0), (2, 10), (0, 10)), ring((8, 0), (10, 0), (10, 10), (8, 10))]
    rows = [("frame", r) for r in bars] + [("bow", ring((0, 0), (4, 4), (4, 0), (0, 4))), ("flat", ring((0, 0), (1, 1), (2, 2))), ("none", bars[0]), ("low", bars[0])]
    rings = spark.createDataFrame(rows, "job_id string, ring array<struct<x: double, y: double>>")
    heights = spark.createDataFrame([("frame", 1.0, 4.0), ("bow", 0.0, 2.0), ("flat", 0.0, 1.0), ("low", 2.0, 2.0)], "job_id string, low double, high double")
    v, f = (df.persist() for df in solids.extruded(rings, heights))
    assert {r.job_id: r.volume for r in mesh.volume(f, v).collect()} == pytest.approx({"frame": 64 * 3, "bow": 8 * 2})
    assert {(r.open_edges, r.non_manifold_edges) for r in mesh.edge_counts(f).collect()} <= {(0, 0), (0, 1)}
    assert f.groupBy("job_id", "fid").count().where("count > 1").count() == 0


def test_holes_are_filled_over_their_own_corners(spark):
    box = terrain(4, 5)
    drop = {0, 1, 2, 20, 40}
    v, f = tables(spark, {"holes": (box[0], [t for k, t in enumerate(box[1]) if k not in drop]), "whole": torus(8, 6)})
    out = solids.fill_holes(v, f).persist()
    assert {r.job_id: r.open_edges for r in mesh.edge_counts(out).collect()} == {"holes": 0, "whole": 0}
    assert out.where("job_id = 'whole'").count() == len(torus(8, 6)[1]) and out.groupBy("job_id", "fid").count().where("count > 1").count() == 0
    got = {r.job_id: r.volume for r in mesh.volume(out, v).collect()}["holes"]
    assert got == pytest.approx(volume(*box), rel=0.1)
    assert solids.fill_holes(v, f.limit(0)).count() == 0 and solids.fill_holes(v, f.where("job_id = 'whole'")).count() == len(torus(8, 6)[1])
    assert out.where(F.col("v0") == F.col("v1")).count() == 0
