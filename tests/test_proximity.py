"""The closest place of a mesh against a plain version, and tops told by nearness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orolith.operators import mesh, proximity

VERTEX = "job_id string, vid long, x double, y double, z double, u double, v double"
FACE = "job_id string, fid long, v0 long, v1 long, v2 long"
POINT = "job_id string, pid long, x double, y double, z double"


def plain(p, a, b, c):
    """(d2, weights) by the region of the triangle's plane that p stands in."""
    ab, ac, ap, bp, cp = b - a, c - a, p - a, p - b, p - c
    d1, d2, d3, d4, d5, d6 = ab @ ap, ac @ ap, ab @ bp, ac @ bp, ab @ cp, ac @ cp
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    if d1 <= 0 and d2 <= 0:
        w = (1, 0, 0)
    elif d3 >= 0 and d4 <= d3:
        w = (0, 1, 0)
    elif d6 >= 0 and d5 <= d6:
        w = (0, 0, 1)
    elif vc <= 0 and d1 >= 0 and d3 <= 0:
        w = (1 - d1 / (d1 - d3), d1 / (d1 - d3), 0)
    elif vb <= 0 and d2 >= 0 and d6 <= 0:
        w = (1 - d2 / (d2 - d6), 0, d2 / (d2 - d6))
    elif va <= 0 and d4 >= d3 and d5 >= d6:
        t = (d4 - d3) / ((d4 - d3) + (d5 - d6))
        w = (0, 1 - t, t)
    else:
        w = np.array([va, vb, vc]) / (va + vb + vc)
    off = p - (w[0] * a + w[1] * b + w[2] * c)
    return off @ off, np.array(w, float)


def made(rng, n, spread, size):
    """n loose triangles of very different sizes, and a grid of joined ones."""
    v, f = [], []
    for k in range(n):
        at, wide = rng.uniform(-spread, spread, 3), size * 2.0 ** rng.integers(-4, 5)
        for m in range(3):
            v.append([3 * k + m, *(at + rng.uniform(-wide, wide, 3)), *rng.uniform(0, 1, 2)])
        f.append([k, 3 * k, 3 * k + 1, 3 * k + 2])
    return v, f


@pytest.mark.parametrize("n, spread", [(3, 5.0), (900, 40.0)])
def test_closest_place_equals_the_plain_version(spark, n, spread):
    rng = np.random.default_rng(n)
    v, f = made(rng, n, spread, 1.0)
    pts = [[k, *rng.uniform(-2 * spread, 2 * spread, 3)] for k in range(40)] + [[40, *v[4][1:4]], [41, 1e5, -1e5, 3.0]]
    got = proximity.closest(
        spark.createDataFrame([("s", p[0], *map(float, p[1:])) for p in pts], POINT),
        spark.createDataFrame([("s", r[0], *map(float, r[1:])) for r in v], VERTEX),
        spark.createDataFrame([("s", *r) for r in f], FACE),
        ["u", "v"],
    ).collect()
    assert len(got) == len(pts)
    at = np.array([r[1:4] for r in v], float)
    uv = np.array([r[4:] for r in v], float)
    by = {r.pid: r for r in got}
    for p in pts:
        seen = [plain(np.array(p[1:], float), *at[r[1:]]) for r in f]
        d2 = np.array([s[0] for s in seen])
        r = by[p[0]]
        assert r.d2 == pytest.approx(d2.min(), rel=1e-9, abs=1e-9)
        assert d2[r.fid] == pytest.approx(d2.min(), rel=1e-9, abs=1e-9)
        want = seen[r.fid][1] @ uv[f[r.fid][1:]]
        assert (r.u, r.v) == pytest.approx(tuple(want), abs=1e-6)


def test_ties_nulls_flat_faces_and_jobs_without_a_mesh(spark):
    v = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0, 0.0, 0.0), ("a", 1, 1.0, 0.0, 0.0, 1.0, 0.0), ("a", 2, 1.0, 1.0, 0.0, 1.0, 1.0), ("a", 3, 0.0, 1.0, 0.0, 0.0, 1.0), ("a", 4, None, 0.0, 0.0, 0.0, 0.0)], VERTEX)
    f = spark.createDataFrame([("a", 7, 0, 1, 2), ("a", 5, 0, 2, 3), ("a", 9, 1, 1, 2), ("a", 1, 0, 1, 4)], FACE)
    pts = [("a", 0, 0.5, 0.5, 2.0), ("a", 1, 2.0, 0.5, 0.0), ("a", 2, 0.25, 0.75, 1.0), ("a", 3, None, 0.0, 0.0), ("a", 4, float("nan"), 0.0, 0.0), ("b", 0, 0.0, 0.0, 0.0), ("a", 2, 0.25, 0.75, 1.0)]
    points = spark.createDataFrame(pts, POINT).withColumns({"fid": F.lit("old"), "note": F.lit("n")})
    got = proximity.closest(points, v, f, ["u"]).collect()
    assert sorted((r.job_id, r.pid, r.fid, r.d2, r.u, r.note) for r in got if r.fid is not None) == [("a", 0, 5, 4.0, 0.5, "n"), ("a", 1, 7, 1.0, 1.0, "n"), ("a", 2, 5, 1.0, 0.25, "n"), ("a", 2, 5, 1.0, 0.25, "n")]
    assert sorted((r.job_id, r.pid) for r in got if r.fid is None) == [("a", 3), ("a", 4), ("b", 0)]
    assert {r.fid for r in proximity.closest(points, v, f.limit(0)).collect()} == {None}
    assert proximity.closest(points.limit(0), v, f).count() == 0


def test_tops_by_nearness_where_no_normal_points_up(spark):
    surface_v = spark.createDataFrame([("a", k, float(x), float(y), 10.0, 0.0, 0.0) for k, (x, y) in enumerate(((0, 0), (4, 0), (4, 4), (0, 4)))], VERTEX)
    surface_f = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 0, 2, 3)], FACE)
    solid = surface_v.union(surface_v.withColumns({"vid": F.col("vid") + 4, "z": F.lit(0.0)}))
    turned = spark.createDataFrame([("a", 0, 0, 2, 1), ("a", 1, 0, 3, 2), ("a", 2, 4, 6, 5), ("a", 3, 4, 7, 6)], FACE)
    got = {r.fid: r.is_top for r in proximity.top_faces(turned, solid, (surface_v, surface_f)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}
    kept = {r.fid: r.is_top for r in proximity.top_faces(surface_f, surface_v, (surface_v, surface_f.limit(0))).collect()}
    assert kept == {0: True, 1: True}
    assert proximity.near_limit() == 0.75 and proximity.near_limit(2.0) == 3.0 and proximity.near_limit(2.0, 0.1) == 0.1
    assert mesh.top_faces(turned, solid).where("is_top").count() == 0


def test_cells_of_a_narrow_mesh_hold_few_faces(spark):
    n = 2048
    v = spark.range(2 * n + 2).select(F.lit("s").alias("job_id"), F.col("id").alias("vid"), (F.col("id") % 2).cast("double").alias("x"), F.floor(F.col("id") / 2).cast("double").alias("y"), F.lit(0.0).alias("z"))
    f = spark.range(2 * n).select(F.lit("s").alias("job_id"), F.col("id").alias("fid"), *[(F.col("id") + k).alias(f"v{k}") for k in range(3)])
    tri, _ = proximity.cells(f, v, [], ["job_id"])
    assert tri.count() == 2 * n
    assert tri.groupBy(proximity.CELL).count().agg(F.avg("count")).first()[0] <= proximity.LEAF
