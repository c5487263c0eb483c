"""Voxels, their surface and gap closing against plain versions."""

import math

import numpy as np
import pytest

from orolith.operators import mesh


def solid(spark, boxes):
    """A mesh of closed boxes (x0, y0, z0, x1, y1, z1), one job."""
    v, f = [], []
    for n, (x0, y0, z0, x1, y1, z1) in enumerate(boxes):
        at = 8 * n
        v += [("s", at + k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate((x, y, z) for z in (z0, z1) for y in (y0, y1) for x in (x0, x1))]
        quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
        for k, (a, b, c, d) in enumerate(quads):
            f += [("s", 12 * n + 2 * k, at + a, at + b, at + c), ("s", 12 * n + 2 * k + 1, at + a, at + c, at + d)]
    return spark.createDataFrame(v, "job_id string, vid long, x double, y double, z double"), spark.createDataFrame(f, "job_id string, fid long, v0 long, v1 long, v2 long")


BOXES = [(0, 0, 0, 9.7, 7.3, 4.1), (12.2, 1.1, 0, 15.9, 5.2, 8.8)]


@pytest.mark.parametrize("size", [0.9, 1.7])
def test_voxels_are_the_cells_inside(spark, size):
    got = {(r.a, r.b, r.c) for r in mesh.voxels(*solid(spark, BOXES), size).collect()}
    want = set()
    for x0, y0, z0, x1, y1, z1 in BOXES:
        inside = [range(math.ceil(lo / size - 0.5), math.floor(hi / size - 0.5) + 1) for lo, hi in ((x0, x1), (y0, y1), (z0, z1))]
        want |= {(a, b, c) for a in inside[0] for b in inside[1] for c in inside[2]}
    assert got == want


def test_voxel_surface_is_closed_and_holds_their_volume(spark):
    rng = np.random.default_rng(3)
    cells = sorted({tuple(int(x) for x in c) for c in rng.integers(0, 5, (40, 3))})
    filled = spark.createDataFrame([("s", *c) for c in cells], "job_id string, a int, b int, c int")
    v, f = mesh.voxel_surface(filled, 0.5)
    facts = mesh.volume(f, v).collect()[0]
    sides = sum(tuple(np.add(c, d)) not in cells for c in cells for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
    assert facts.volume == pytest.approx(len(cells) * 0.125) and facts.area == pytest.approx(sides * 0.25)
    assert mesh.edge_counts(f).collect()[0].open_edges == 0


def test_gaps_are_closed_from_below(spark):
    boxes = [(0, 0, 0, 1, 1, 2), (3, 0, 5, 4, 1, 6), (6, 0, 1, 7, 1, 3), (9, 0, 20, 10, 1, 21)]
    v, f = solid(spark, boxes)
    moved = mesh.close_gaps(v, f).groupBy((mesh.F.floor(mesh.F.col("vid") / 8)).alias("n")).agg(mesh.F.min("z").alias("lo"), mesh.F.max("z").alias("hi")).collect()
    top, want = None, {}
    for n in sorted(range(len(boxes)), key=lambda n: boxes[n][2]):
        lo, hi = boxes[n][2], boxes[n][5]
        down = max(0, lo - top) if top is not None else 0
        want[n] = (lo - down, hi - down)
        top = hi - down if top is None else max(top, hi - down)
    assert {r.n: (r.lo, r.hi) for r in moved} == want and want[3] == (4, 5)


OVERLAPS = [(0, 0, 0, 10, 10, 10), (0, 0, 5, 10, 10, 15), (2, 2, 2, 4, 4, 4), (10, 0, 0, 13, 10, 10), (20, 0, 0, 22, 3, 3)]


@pytest.mark.parametrize("turned", [False, True])
def test_overlapping_nested_and_touching_parts_are_filled_once(spark, turned):
    v, f = solid(spark, OVERLAPS)
    if turned:
        f = f.select("job_id", "fid", "v0", mesh.F.col("v2").alias("v1"), mesh.F.col("v1").alias("v2"))
    got = [(r.a, r.b, r.c) for r in mesh.voxels(v, f, 1.0).collect()]
    want = {(a, b, c) for x0, y0, z0, x1, y1, z1 in OVERLAPS for a in range(x0, x1) for b in range(y0, y1) for c in range(z0, z1)}
    assert len(got) == len(set(got)) and set(got) == want


def test_overlapping_parts_are_fused_to_one(spark):
    v, f = solid(spark, OVERLAPS[:2])
    size = spark.createDataFrame([("s", 1.0)], "job_id string, voxel_mm double")
    fv, ff, facts = mesh.fused(v, f, size)
    told = facts.collect()[0]
    assert (told.print_component_count, told.print_fused_by) == (1, "voxels")
    assert mesh.volume(ff, fv).collect()[0].volume == pytest.approx(1500)
