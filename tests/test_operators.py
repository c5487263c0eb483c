"""Raster, palette, pond, mesh, shape, job and file operators on the small fixtures of the design."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from orolith.functions import color, geo, names
from orolith.operators import jobs, mesh, palette, ponds, raster, shapes
from orolith.sinks import files, meshes
from orolith.sources import artifacts, boundaries, imagery


def cells(spark, rgb, z=None, alpha=None, job="a"):
    """(job_id, i, j, r, g, b, z, a) of arrays."""
    h, w = rgb.shape[:2]
    rows = [(job, i, j, *map(int, rgb[i, j]), None if z is None else float(z[i, j]), 255 if alpha is None else int(alpha[i, j])) for i in range(h) for j in range(w)]
    out = spark.createDataFrame(rows, "job_id string, i int, j int, r int, g int, b int, z double, a int")
    return out.drop("z") if z is None else out


def plain(h, w, c):
    return np.tile(np.array(c), (h, w, 1))


def dark_pond():
    rgb = plain(48, 48, (70, 110, 45))
    rgb[18:26, 18:26] = (10, 17, 11)
    return rgb


def test_dark_pond_is_found(spark):
    got = {(r.i, r.j) for r in ponds.detect(cells(spark, dark_pond())).collect()}
    assert got == {(i, j) for i in range(18, 26) for j in range(18, 26)}


def test_pasture_has_no_pond(spark):
    rgb = plain(32, 32, (92, 118, 58))
    z = np.tile(np.linspace(138, 142, 32), (32, 1))
    assert ponds.detect(cells(spark, rgb, z)).count() < 80


def test_muddy_low_needs_an_eager_preset(spark):
    rgb = plain(48, 48, (92, 118, 58))
    rgb[16:30, 16:30] = (95, 100, 78)
    z = np.full((48, 48), 120.0)
    z[16:30, 16:30] = 118.2
    table = cells(spark, rgb, z)
    n = {s: ponds.detect(table, s).count() for s in ("conservative", "aggressive")}
    assert n["aggressive"] >= n["conservative"]


def brute_labels(lit):
    label, seen = {}, set()
    for start in sorted(lit):
        if start in seen:
            continue
        work = [start]
        seen.add(start)
        while work:
            i, j = work.pop()
            label[i, j] = start
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in lit and n not in seen:
                    seen.add(n)
                    work.append(n)
    return label


def test_components_like_flood_fill(spark):
    grid = np.random.default_rng(1).random((30, 30)) < 0.55
    lit = {(int(i), int(j)) for i, j in zip(*np.nonzero(grid), strict=True)}
    df = spark.createDataFrame([(job, i, j) for job in ("a", "b") for i, j in lit], "job_id string, i int, j int")
    rows = ponds.blobs(df).collect()
    for job in ("a", "b"):
        assert {(r.i, r.j): (r.blob_i, r.blob_j) for r in rows if r.job_id == job} == brute_labels(lit)


def test_cap_passes_over_what_does_not_fit(spark):
    found = spark.createDataFrame([("a", 0, 0, 60, 9.0), ("a", 1, 1, 50, 8.0), ("a", 2, 2, 40, 7.0), ("a", 3, 3, 40, 7.0)], "job_id string, blob_i int, blob_j int, size long, score double")
    assert {r.blob_i for r in ponds.capped(found, F.lit(100)).collect()} == {0, 2}


def test_focal_std_like_numpy(spark):
    z = np.random.default_rng(2).normal(size=(12, 9))
    pad = np.pad(z, 3, mode="symmetric")
    want = np.array([[pad[i : i + 7, j : j + 7].std() for j in range(9)] for i in range(12)])
    got = {(r.i, r.j): r.std for r in raster.focal_std(cells(spark, plain(12, 9, (0, 0, 0)), z), F.col("z"), 3).collect()}
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(12) for j in range(9))


def test_prepare_z_fills_holes(spark):
    z = np.array([[1.0, np.nan], [3.0, np.inf]])
    got = {(r.i, r.j): r.z for r in raster.prepare_z(cells(spark, plain(2, 2, (0, 0, 0)), z), 2.0).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 0.0, (1, 0): 4.0, (1, 1): 0.0}


QUADRANTS = [(40, 95, 143), (27, 77, 42), (90, 160, 70), (130, 130, 130)]


def quadrants():
    rgb = plain(16, 16, QUADRANTS[0])
    rgb[:8, 8:], rgb[8:, :8], rgb[8:, 8:] = QUADRANTS[1], QUADRANTS[2], QUADRANTS[3]
    return rgb


def test_median_cut_and_recommendation(spark):
    table = cells(spark, quadrants())
    assert {(r.r, r.g, r.b) for r in palette.median_cut(table, 4).collect()} == set(QUADRANTS)
    rows = palette.recommend(table, 4).orderBy("index").collect()
    assert [r.role for r in rows] == ["base", "land", "land", "land"] and rows[0].part_name == "01_base"
    free = palette.recommend(table, 4, reserve_base=False).collect()
    assert {(r.r, r.g, r.b) for r in free} == set(QUADRANTS) and {r.coverage_pct for r in free} == {25.0}


def test_recommendation_with_a_drawn_pond(spark):
    table = cells(spark, plain(48, 48, (70, 110, 45)))
    wet = table.where("i BETWEEN 18 AND 25 AND j BETWEEN 18 AND 25").select("job_id", "i", "j")
    rows = {r.role: r for r in palette.recommend(table, 4, True, wet, True).collect()}
    assert rows["pond"].pond_pixel_count == 64 and tuple(rows["pond"].rgb) == palette.POND_FILAMENT and rows["pond"]["index"] == 1
    assert rows["pond"].coverage_pct == round(100 * 64 / 48**2, 2)


def test_quantize_outside_is_zero(spark):
    alpha = np.zeros((16, 16))
    alpha[5:15, 5:15] = 255
    table = cells(spark, quadrants(), alpha=alpha)
    colors = palette.literal_palette(spark, QUADRANTS, "a")
    rows = palette.quantize(table, colors).collect()
    assert all(r.label == 0 for r in rows if r.a == 0)
    assert all(QUADRANTS[r.label] == (r.r, r.g, r.b) for r in rows if r.a)


def test_lab_round_trip(spark):
    df = spark.createDataFrame([(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)], "r int, g int, b int")
    lab = df.withColumn("l", color.lab(F.col("r"), F.col("g"), F.col("b")))
    back = lab.select("r", "g", "b", color.from_lab(F.col("l.L"), F.col("l.a"), F.col("l.b")).alias("c"))
    assert back.where("r <> c.r OR g <> c.g OR b <> c.b").count() == 0


def surface(spark, h=8, w=10):
    z = np.random.default_rng(0).random((h, w)) * 5 + 50
    rows = [("a", i, j, j * 10.0, (h - i) * 10.0, float(z[i, j])) for i in range(h) for j in range(w)]
    table = spark.createDataFrame(rows, "job_id string, i int, j int, x double, y double, z double")
    return table, mesh.grid_vertices(table), mesh.quad_faces(mesh.grid_quads(table))


def test_print_solid_is_closed(spark):
    _, v, f = surface(spark)
    sv, sf, surf, facts = mesh.print_solid(v, f, 200.0)
    r = facts.collect()[0]
    assert (r.print_open_edge_count, r.print_non_manifold_edge_count, r.print_component_count) == (0, 0, 1)
    assert abs(r.print_xy_extent_max_mm - 200) < 1e-6 and surf.agg(F.min("z")).first()[0] == pytest.approx(1.0)
    size = mesh.volume(sf, sv).collect()[0]
    mean = surf.agg(F.avg("z")).first()[0]
    assert size.volume == pytest.approx(r.size_x_mm * r.size_y_mm * mean, rel=0.05)


def test_clean_drops_repeated_and_flat_faces(spark):
    v = spark.createDataFrame([("a", k, float(x), float(y), 0.0, 0.0, 0.0) for k, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (0, 1), (5, 5)])], "job_id string, vid long, x double, y double, z double, u double, v double")
    f = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 1, 3, 0), ("a", 2, 2, 3, 0)], "job_id string, fid long, v0 long, v1 long, v2 long")
    cv, cf = mesh.clean(v, f)
    assert [(r.fid, r.v0, r.v1, r.v2) for r in cf.collect()] == [(0, 0, 1, 2)] and {r.vid for r in cv.collect()} == {0, 1, 2}


def test_clipped_mesh_has_the_boundary_area(spark):
    table, _, _ = surface(spark, 12, 12)
    corners = [(13.0, 21.0), (95.0, 30.0), (101.0, 88.0), (55.0, 62.0), (24.0, 104.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    edge = spark.range(1).select(F.lit("a").alias("job_id"), ring.alias("ring"))
    v, f = shapes.clipped_mesh(table.withColumn("z", F.lit(0.0)), edge)
    want = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(corners, corners[1:] + corners[:1], strict=True))) / 2
    assert mesh.volume(f, v).collect()[0].area == pytest.approx(want, rel=1e-6)
    assert v.count() == mesh.referenced(v, f).count()


def test_rasterised_rectangle_round_trip(spark):
    lit = spark.createDataFrame([("a", i, j) for i in range(10, 22) for j in range(12, 28)], "job_id string, i int, j int")
    shape = shapes.outlines(lit.join(ponds.blobs(lit), ["job_id", "i", "j"]))
    assert [len(r.ring) for r in shape.collect()] == [4]
    size = spark.createDataFrame([("a", 48, 48)], "job_id string, h int, w int")
    back = {(r.i, r.j) for r in shapes.rasterize(shape, size).collect()}
    assert back == {(r.i, r.j) for r in lit.collect()}


def test_overlapping_and_degenerate_shapes(spark):
    square = lambda a, b: [{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    rows = [("a", 0, None, None, square(5.0, 20.0)), ("a", 1, "s", "auto", square(15.0, 30.0)), ("a", 2, "t", "x", square(1.0, 2.0)[:2])]
    drawn = spark.createDataFrame(rows, "job_id string, ord int, id string, source string, ring array<struct<x: double, y: double>>")
    size = spark.createDataFrame([("a", 40, 40)], "job_id string, h int, w int")
    good = shapes.valid_shapes(drawn, size).collect()
    assert [(r.ord, r.source) for r in good] == [(0, "manual"), (1, "auto")] and len(good[0].id) == 64
    assert shapes.polygon_mask(drawn, size).count() == 15 * 15 * 2 - 25


def test_files(spark, tmp_path):
    _, v, f = surface(spark)
    sv, sf = mesh.numbered(*mesh.close_to_floor(v, f))
    labelled = sf.withColumn("label", (F.col("fid") % 2).cast("int"))
    colors = spark.createDataFrame([("a", 0, 1, 2, 3, "base", "Base", "01_base", "01_base", "#010203", 50.0, None), ("a", 1, 200, 0, 0, "pond", "Pond", "02_pond", "02_pond", "#C80000", 50.0, [45, 100, 135])], "job_id string, index int, r int, g int, b int, role string, name string, part_name string, material_name string, hex string, coverage_pct double, filament_rgb array<int>")
    image = cells(spark, quadrants()).select("job_id", "i", "j", "r", "g", "b", "a")
    pieces = (
        meshes.stl(sv, sf).unionByName(meshes.glb(sv, sf, "c.glb", mesh.vertex_colors(labelled, colors))).unionByName(meshes.threemf(sv, sf, "t.3mf", image))
        .unionByName(meshes.threemf_colored(sv, labelled, colors)).unionByName(meshes.obj_colored(sv, labelled, colors)).unionByName(meshes.obj_textured(sv, sf, image)).unionByName(files.image_pieces(image, "x.png"))
    )
    saved = {r.file: r.size for r in files.save(pieces, str(tmp_path)).collect()}
    nv, nf = sv.count(), sf.count()
    read = lambda n: (tmp_path / "a" / n).read_bytes()
    assert saved["print.stl"] == 84 + 50 * nf == len(read("print.stl")) and struct.unpack("<I", read("print.stl")[80:84])[0] == nf
    magic, _, whole, n, _ = struct.unpack("<4sIIII", read("c.glb")[:20])
    tree = json.loads(read("c.glb")[20 : 20 + n])
    assert magic == b"glTF" and whole == len(read("c.glb")) and tree["accessors"][0]["count"] == nv and tree["accessors"][-1]["count"] == 3 * nf
    obj = zipfile.ZipFile(io.BytesIO(read("print_ams.zip"))).read("terrain_ams.obj").decode().splitlines()
    assert sum(x.startswith("v ") for x in obj) == nv and sum(x.startswith("f ") for x in obj) == nf and obj.index("usemtl 02_pond") > obj.index("usemtl 01_base")
    assert "0.176471 0.392157 0.529412" in zipfile.ZipFile(io.BytesIO(read("print_ams.zip"))).read("terrain_ams.mtl").decode()
    assert read("x.png")[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", read("x.png")[16:24]) == (16, 16)
    rv, rf = artifacts.read_3mf(spark, str(tmp_path / "a" / "t.3mf"))
    assert rv.count() == nv and rf.count() == nf and rf.where("NOT textured").count() == 0
    cv, cf = artifacts.read_3mf(spark, str(tmp_path / "a" / "print_color.3mf"))
    assert cf.count() == nf and cv.count() >= nv
    xml = zipfile.ZipFile(io.BytesIO(read("t.3mf"))).read("3D/3dmodel.model").decode()
    got = meshes.inspect_textures(spark.createDataFrame([(xml,)], "xml string")).collect()[0]
    assert got.ok and got.n_coords == nv


def test_kml_and_grid(spark, tmp_path):
    text = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>
      -105.05,39.75,0 -104.95,39.75,0 -104.95,39.82,0 -105.05,39.82,0 -105.05,39.75,0 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""
    (tmp_path / "My Site.kml").write_text(text)
    got = boundaries.read_kml(spark, str(tmp_path)).collect()
    assert [(r.job_id, len(r.ring)) for r in got] == [("My_20Site", 4)] or got[0].job_id == "My_Site"
    ring = boundaries.boundaries(spark.createDataFrame([("a", text), ("b", "<kml/>"), ("c", None)], "job_id string, text string"))
    grid = boundaries.grids(boundaries.projected(ring), most=100).collect()
    assert len(grid) == 1 and grid[0].epsg == 32613 and (grid[0].width, grid[0].height) == (100, 91)


@pytest.mark.parametrize("box,cap,size", [((0, 0, 1000, 4000), 1024, (256, 1024)), ((0, 0, 4000, 1000), 512, (512, 128)), ((0, 0, 1, 1), 10, (64, 64)), ((0, 0, 1, 1), 9999, (2048, 2048))])
def test_grid_size(spark, box, cap, size):
    s = geo.grid_size(*[F.lit(float(x)) for x in box], F.lit(cap))
    assert tuple(spark.range(1).select(s.alias("s")).select("s.*").first()) == size


def test_names(spark):
    df = spark.createDataFrame([("My Site.kml",), (None,), ("..",), ("x" * 200 + ".kml",)], "n string")
    assert [r[0] for r in df.select(names.export_basename(F.col("n"))).collect()] == ["My_Site", "terrain", "terrain", "x" * 120]


def test_expiry(spark):
    now = 1_000_000.0
    rows = [
        ("done_old", "done", now - 100_000, now - 100_000, True), ("done_new", "done", now - 60, now - 60, False), ("stale", "running", now - 10_000, now - 10_000, True), ("long", "running", now - 4000, now - 60, True),
        ("fresh", "running", now - 60, now - 60, False), ("queued", "queued", now - 900_000, now - 900_000, False), ("none", None, None, None, True), ("active", "error", now - 900_000, now - 900_000, False),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "job_id string, status string, started_at double, updated_at double").withColumn("seen", F.lit(now - 90_000))
    gone = [r.job_id for r in jobs.expired(df, F.lit(now), active=spark.createDataFrame([("active",)], "job_id string")).collect()]
    assert gone == sorted(r[0] for r in rows if r[4])
    texts = spark.createDataFrame([('{"status": "done", "percent": 3}',), ("{broken",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(jobs.known_or_busy(jobs.snapshot(F.col("t")))["status"]).collect()] == ["done", "busy", "busy", "busy"]


def test_mosaic_and_warp(spark):
    tiles = spark.createDataFrame([("a", 12, x, 20, bytearray([127 + x] * (256 * 256 * 3))) for x in (10, 11)], "job_id string, z int, x long, y long, rgb binary")
    px = imagery.mosaic(tiles)
    assert px.agg(F.max("i"), F.max("j"), F.min("r"), F.max("r")).first()[:] == (255, 511, 137, 138)
    source = cells(spark, plain(4, 4, (0, 0, 0)), np.arange(16.0).reshape(4, 4)).select("job_id", "i", "j", "z")
    where = spark.createDataFrame([("a", 0.0, 4.0, 1.0, 1.0)], "job_id string, west double, north double, dx double, dy double")
    grid = spark.createDataFrame([("a", 0, 0, 1.0, 3.0, 1), ("a", 0, 1, 9.0, 9.0, 1)], "job_id string, i int, j int, x double, y double, epsg int")
    got = {r.j: r.z for r in imagery.warp(source, where, grid, ["z"], lambda x, y, e: F.struct(x.alias("x"), y.alias("y")), -1.0).collect()}
    assert got == {0: 2.5, 1: -1.0}


def test_nearest_vertices_far_away(spark):
    rng = np.random.default_rng(7)
    at, ask = rng.normal(size=(200, 2)), np.concatenate([rng.normal(size=(50, 2)), [[40.0, -3.0]]])
    v = spark.createDataFrame([("a", k, float(x), float(y)) for k, (x, y) in enumerate(at)], "job_id string, vid long, x double, y double")
    p = spark.createDataFrame([("a", k, float(x), float(y)) for k, (x, y) in enumerate(ask)], "job_id string, pid long, x double, y double")
    got = {r.pid: r.vid for r in mesh.nearest_vertices(p, v, []).collect()}
    assert got == {k: int(((at - q) ** 2).sum(1).argmin()) for k, q in enumerate(ask)}


def test_cap_like_a_plain_loop_over_many_blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(job, int(k), int(k % 7), int(s), float(z), most) for job, most in (("a", 400), ("b", 3), ("c", 100_000), ("d", 0)) for k, (s, z) in enumerate(zip(rng.integers(1, 90, 300), rng.integers(0, 5, 300), strict=True))]
    found = spark.createDataFrame(rows, "job_id string, blob_i int, blob_j int, size long, score double, most long")
    got = {(r.job_id, r.blob_i) for r in ponds.capped(found, F.col("most")).collect()}
    want, used = set(), {}
    for job, i, _, size, _, most in sorted(rows, key=lambda r: (r[0], -r[4], r[1], r[2])):
        if used.get(job, 0) + size <= most:
            used[job] = used.get(job, 0) + size
            want.add((job, i))
    assert got == want


def test_cap_folds_no_job_as_one_array(spark):
    found = spark.createDataFrame([("a", 0, 0, 60, 9.0)], "job_id string, blob_i int, blob_j int, size long, score double")
    assert "aggregate(" not in ponds.capped(found, F.lit(100))._jdf.queryExecution().optimizedPlan().toString()
