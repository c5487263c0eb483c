"""Solids cut by planes: closed pieces, volumes that add up, straight edges; and triangles of rings."""

import math
import random

import numpy as np
import pytest

from orolith.operators import cutting, mesh, polygons


def tables(spark, solids):
    """vertices and faces of solids {job: (points, triangles)}."""
    v = [(j, k, *map(float, p), float(p[0]) / 7) for j, (ps, _) in solids.items() for k, p in enumerate(ps)]
    f = [(j, k, *map(int, t)) for j, (_, ts) in solids.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(v, "job_id string, vid long, x double, y double, z double, u double"), spark.createDataFrame(f, "job_id string, fid long, v0 long, v1 long, v2 long")


def torus(n=24, m=10, big=5.0, small=2.0):
    """A ring in the plane of x and y: a section across its middle has two loops, one along it has a hole."""
    at = lambda i, j: (i % n) * m + j % m
    ps = [((big + small * math.cos(b)) * math.cos(a), (big + small * math.cos(b)) * math.sin(a), small * math.sin(b)) for i in range(n) for j in range(m) for a, b in [(2 * math.pi * i / n + 0.01, 2 * math.pi * j / m + 0.02)]]
    ts = [t for i in range(n) for j in range(m) for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]
    return ps, ts


def terrain(h=9, w=13, seed=3):
    rnd = random.Random(seed)
    n = h * w
    ps = [(j, h - 1 - i, 1 + rnd.random() * 3) for i in range(h) for j in range(w)]
    quad = [(i * w + j, i * w + j + 1, (i + 1) * w + j, (i + 1) * w + j + 1) for i in range(h - 1) for j in range(w - 1)]
    top = [t for a, b, c, d in quad for t in ((a, c, b), (c, d, b))]
    rim = [(j, j + 1) for j in range(w - 1)] + [(i * w + w - 1, (i + 1) * w + w - 1) for i in range(h - 1)]
    rim += [((h - 1) * w + j + 1, (h - 1) * w + j) for j in range(w - 1)] + [((i + 1) * w, i * w) for i in range(h - 1)]
    walls = [t for a, b in rim for t in ((a, b, b + n), (a, b + n, a + n))]
    return ps + [(x, y, 0) for x, y, _ in ps], top + [(a + n, c + n, b + n) for a, b, c in top] + walls


def volume(points, tri):
    p = np.array(points, float)[np.array(tri)]
    return float(np.einsum("ij,ij->i", p[:, 0], np.cross(p[:, 1], p[:, 2])).sum() / 6)


def facts(v, f, by):
    if set(by) - set(v.columns):  # vertices that the pieces share
        v = f.select(*by, "v0", "v1", "v2").select(*by, mesh.F.explode(mesh.F.array("v0", "v1", "v2")).alias("vid")).distinct().join(v, ["job_id", "vid"])
    size = {tuple(r[k] for k in by): (r.volume, r.area) for r in mesh.volume(f, v, by).collect()}
    edges = {tuple(r[k] for k in by): (r.open_edges, r.non_manifold_edges) for r in mesh.edge_counts(f, by).collect()}
    return size, edges


def test_tiles_are_closed_and_add_up(spark):
    solids = {"torus": torus(), "terrain": terrain(), "box": ([(x, y, z) for z in (0, 1) for y in (0, 2) for x in (0, 3)], [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)])}
    v, f = tables(spark, solids)
    key = ["job_id", "tile", "ix", "iy"]
    tv, tf = cutting.tiles(v, f, 3, 2)
    tv, tf = tv.persist(), tf.persist()
    size, edges = facts(tv, tf, key)
    assert set(edges.values()) == {(0, 0)} and len(edges) == 18
    box = {r.job_id: r for r in mesh.bounds(v).collect()}
    for job, (ps, ts) in solids.items():
        mine = {k: s for k, s in size.items() if k[0] == job}
        assert sum(s[0] for s in mine.values()) == pytest.approx(volume(ps, ts)) and all(s[0] > 0 for s in mine.values())
        assert {k[1] for k in mine} == {1, 2, 3, 4, 5, 6} and all(k[1] == 1 + k[2] + 3 * k[3] for k in mine)
    for r in mesh.bounds(tv, key).collect():
        b, pad = box[r.job_id], mesh.TILE_PAD
        for axis, n, k in (("x", 3, r.ix), ("y", 2, r.iy)):
            lo, hi = b[f"min_{axis}"] - pad, b[f"max_{axis}"] + pad
            assert r[f"min_{axis}"] > lo + (hi - lo) * k / n - 1e-9 and r[f"max_{axis}"] < lo + (hi - lo) * (k + 1) / n + 1e-9
            if r.job_id == "torus":
                continue
            assert r[f"min_{axis}"] == pytest.approx(max(b[f"min_{axis}"], lo + (hi - lo) * k / n)) and r[f"max_{axis}"] == pytest.approx(min(b[f"max_{axis}"], lo + (hi - lo) * (k + 1) / n))
    assert tv.where("abs(u - x / 7) > 1e-9").count() == 0


def test_planes_through_corners_and_along_walls(spark):
    box = ([(x, y, z) for z in (0, 1) for y in (0, 2) for x in (0, 3)], [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)])
    v, f = tables(spark, {"box": box, "terrain": terrain()})
    lines = spark.createDataFrame([("box", [-1.0, 0.0, 1.5, 3.0, 4.0]), ("terrain", [0.0, 3.0, 4.5, 5.0, 12.0])], "job_id string, lines array<double>")
    sv, sf = cutting.split(v, f, lines, "x")
    size, edges = facts(sv, sf, ["job_id", "slab"])
    assert set(edges.values()) == {(0, 0)}
    assert {k[1]: round(s[0], 9) for k, s in size.items() if k[0] == "box"} == {2: 3.0, 3: 3.0}
    assert {k[1] for k in size if k[0] == "terrain"} == {1, 2, 3, 4} and sum(s[0] for k, s in size.items() if k[0] == "terrain") == pytest.approx(volume(*terrain()))


def test_open_and_empty_meshes(spark):
    ps, ts = torus()
    v, f = tables(spark, {"open": (ps, ts[5:])})
    lines = spark.createDataFrame([("open", [0.5])], "job_id string, lines array<double>")
    sv, sf = cutting.split(v, f, lines, "y")
    assert sf.groupBy("slab").count().count() == 2
    assert sum(e[0] for e in facts(sv, sf, ["job_id", "slab"])[1].values()) >= 5
    tv, tf = cutting.tiles(v, f.limit(0), 2, 2)
    assert tv.count() == 0 and tf.count() == 0
    tv, tf = cutting.tiles(v, f, 1, 1)
    assert tf.count() == len(ts) - 5 and tf.select("tile").distinct().collect()[0].tile == 1


def test_rings_with_holes_are_triangulated_with_all_their_corners():
    rnd = random.Random(8)
    for case in range(60):
        n = rnd.randint(3, 40)
        star = lambda n, r, x, y, sense: [(x + q * math.cos(sense * 2 * math.pi * k / n), y + q * math.sin(sense * 2 * math.pi * k / n)) for k in range(n) for q in [r * (0.6 + 0.4 * rnd.random())]]
        rings = [star(n, 10, 0, 0, 1)] + [star(rnd.randint(3, 9), 1, *c, -1) for c in ((-2, 0), (2, 1), (0, -2.5))[: case % 4 if n > 12 else 0]] + ([star(5, 3, 40, 0, 1)] if case % 3 == 0 else [])
        at, ids = [], []
        for r in rings:
            ids.append(list(range(len(at), len(at) + len(r))))
            at += r
        at = np.array(at)
        tri = polygons.triangles(ids, at)
        areas = [polygons.area2(at[list(t)]) for t in tri]
        assert all(a >= -1e-9 for a in areas) and sum(areas) == pytest.approx(sum(polygons.area2(at[r]) for r in ids))
        half = {(t[k], t[(k + 1) % 3]) for t in tri for k in range(3)}
        rim = {(a, b) for r in ids for a, b in zip(r, r[1:] + r[:1], strict=True)}
        assert rim <= half and all((b, a) in half for a, b in half - rim)


def test_corners_on_straight_sides_are_kept():
    at = np.array([(k, 0) for k in range(9)] + [(8, 3)] + [(k, 3 + k % 2) for k in range(7, 0, -1)] + [(0, 3)], float)
    tri = polygons.triangles([list(range(len(at)))], at)
    assert len(tri) == len(at) - 2 and min(polygons.area2(at[list(t)]) for t in tri) > 0


def test_loops_that_touch_stay_apart():
    place = {0: (0, 0), 1: (2, 0), 2: (1, 1), 3: (2, 2), 4: (0, 2)}
    found = polygons.loops([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (7, 8)], place | {7: (9, 9), 8: (9, 8)})
    assert sorted(map(sorted, found)) == [[0, 1, 2], [2, 3, 4]]
