"""Union, repair, offset and closing of rings against areas known or counted on a raster."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orolith.operators import arrangement, polygons

RING = "ring array<struct<x: double, y: double>>"


def frame(spark, rings, extra=""):
    """rings: (job, [(x, y), ...], further values)."""
    return spark.createDataFrame([(j, None if r is None else [{"x": float(x), "y": float(y)} for x, y in r], *more) for j, r, *more in rings], f"job_id string, {RING}{extra}")


def square(x, y, a, b=None):
    return [(x, y), (x + a, y), (x + a, y + (b or a)), (x, y + (b or a))]


def of(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.job_id, []).append((round(r.area, 5), [(p.x, p.y) for p in r.ring]))
    return {j: sorted(v) for j, v in out.items()}


def test_unions_touch_overlap_and_keep_holes(spark):
    frame_of = square(0, 0, 10, 2), square(0, 8, 10, 2), square(0, 0, 2, 10), square(8, 0, 2, 10)[::-1]
    rings = [("two", square(0, 0, 2)), ("two", square(1, 1, 2)[::-1]), ("beside", square(0, 0, 2)), ("beside", square(2, 0, 3, 2)), ("apart", square(0, 0, 1)), ("apart", square(5, 5, 2)), ("same", square(0, 0, 2)), ("same", square(0, 0, 2)), ("inner", square(0, 0, 9)), ("inner", square(3, 3, 2)[::-1])]
    rings += [("frame", r) for r in frame_of] + [("none", None), ("none", [(0.0, 0.0), (1.0, 1.0)]), ("flat", [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])]
    got = of(arrangement.united(frame(spark, rings)))
    assert {j: [a for a, _ in v] for j, v in got.items()} == {"two": [7.0], "beside": [10.0], "apart": [1.0, 4.0], "same": [4.0], "inner": [81.0], "frame": [-36.0, 100.0]}
    assert len(got["beside"][0][1]) == 4 and len(got["two"][0][1]) == 8
    assert arrangement.united(frame(spark, rings).limit(0)).count() == 0


def test_crossed_rings_are_repaired(spark):
    star = [(math.cos(math.pi / 2 + 4 * math.pi * k / 5), math.sin(math.pi / 2 + 4 * math.pi * k / 5)) for k in range(5)]
    rings = [("bow", [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]), ("star", star), ("good", square(0, 0, 3)), ("twice", square(0, 0, 3) * 2), ("spike", [(0.0, 0.0), (4.0, 0.0), (9.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    got = of(arrangement.repaired(frame(spark, rings)))
    assert [a for a, _ in got["bow"]] == [4.0, 4.0] and all(len(r) == 3 for _, r in got["bow"])
    assert len(got["star"]) == 1 and len(got["star"][0][1]) == 10
    assert [a for a, _ in got["good"]] == [9.0] and [a for a, _ in got["twice"]] == [9.0] and [a for a, _ in got["spike"]] == [16.0]


def test_random_rings_against_a_raster(spark):
    rnd = random.Random(4)
    rings = {f"r{k}": [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(rnd.randint(3, 14))] for k in range(12)}
    got = of(arrangement.repaired(frame(spark, list(rings.items()))))
    n = 200
    xs = (np.arange(n) + 0.5) / n * 10
    x, y = np.meshgrid(xs, xs)
    for job, ring in rings.items():
        p, q = np.array(ring), np.roll(np.array(ring), -1, axis=0)
        wound = np.zeros((n, n), int)
        for (px, py), (qx, qy) in zip(p, q, strict=True):
            if py != qy:
                at = px + (y - py) * (qx - px) / (qy - py)
                wound += np.where((min(py, qy) <= y) & (max(py, qy) > y) & (at > x), 1 if qy > py else -1, 0)
        assert sum(a for a, _ in got[job]) == pytest.approx((wound != 0).sum() * (10 / n) ** 2, abs=0.6)
        inside = sum(sum(polygons.holds(np.array(r), x[i, j], y[i, j]) for _, r in got[job]) % 2 != (wound[i, j] != 0) for i in range(0, n, 9) for j in range(0, n, 9))
        assert inside <= 2


def test_offsets_have_the_known_areas(spark):
    corner = [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (4.0, 4.0), (4.0, 10.0), (0.0, 10.0)]
    rings = [("out", square(0, 0, 10), 2.0, 48), ("in", square(0, 0, 10), -2.0, 48), ("gone", square(0, 0, 3), -2.0, 16), ("corner", corner, 1.0, 48), ("split", square(0, 0, 4) + [(0.0, 2.1), (-6.0, 2.1), (-6.0, 4.0), (-10.0, 4.0), (-10.0, 0.0), (-6.0, 0.0), (-6.0, 1.9), (0.0, 1.9)], -0.5, 16)]
    got = of(arrangement.offset(frame(spark, rings, ", distance double, segs int"), "distance", "segs"))
    pi = math.pi
    assert [a for a, _ in got["out"]] == pytest.approx([100 + 80 + 4 * pi], rel=1e-4) and [a for a, _ in got["in"]] == pytest.approx([36.0])
    assert "gone" not in got
    assert [a for a, _ in got["corner"]] == pytest.approx([64 + 39 + 5 / 4 * pi], rel=1e-4)
    assert [a for a, _ in got["split"]] == pytest.approx([9.0, 9.0], rel=2e-4)  # the mouth of the neck leaves a little more


def test_closing_rounds_inner_corners_and_fills_bays(spark):
    corner = [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (4.0, 4.0), (4.0, 10.0), (0.0, 10.0)]
    bay = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.5, 10.0), (5.5, 3.0), (4.5, 3.0), (4.5, 10.0), (0.0, 10.0)]
    rings = frame(spark, [("corner", corner), ("bay", bay), ("square", square(0, 0, 5)), ("as it is", corner), ("unknown", corner)])
    radius = spark.createDataFrame([("corner", 2.0), ("bay", 1.0), ("square", 1.0), ("as it is", 0.0)], "job_id string, radius double")
    got = {r.job_id: (r.n, r.area) for r in arrangement.smoothed(rings, radius).select("job_id", F.size("ring").alias("n"), F.abs(arrangement.geo.ring_area(F.col("ring"))).alias("area")).collect()}
    assert got["corner"][1] == pytest.approx(64 + 4 - math.pi, rel=1e-3) and got["corner"][0] > 12
    assert 99 < got["bay"][1] <= 100 and got["square"][1] == pytest.approx(25, rel=1e-4)
    assert got["as it is"] == got["unknown"] == (6, 64.0)
