"""Stores of rasters and tiles, job files, and prints of several parts."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orolith.engine import Engine
from orolith.functions import geo
from orolith.operators import jobs, mesh, raster, shapes
from orolith.sinks.files import png_chunk
from orolith.sources import artifacts, boundaries, imagery, rasters


def stored_raster(spark, path, n=1024, levels=4):
    cells = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"z": (F.col("i") * 2 + F.col("j")).cast("double"), "source": F.lit("dem")})
    where = spark.createDataFrame([("dem", 10.0, 50.0, 0.001, 0.001)], "source string, west double, north double, dx double, dy double")
    rasters.save_rasters(cells, where, path, ["z"], levels)


def test_raster_store_reads_blocks_of_the_box(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    stored_raster(spark, path)
    box = lambda job, west, north, side: (job, "dem", west, north - side, west + side, north)
    kinds = "job_id string, source string, west double, south double, east double, north double"
    cells, where = rasters.read_rasters(spark, path, spark.createDataFrame([box("a", 10.3, 49.7, 0.05)], kinds))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "level" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(bi" in plan
    got = {(r.i, r.j): r.z for r in cells.collect()}
    assert len(got) == 256 * 256 and min(got) == (256, 256) and all(z == 2 * i + j for (i, j), z in got.items())
    coarse, where = rasters.read_rasters(spark, path, spark.createDataFrame([box("a", 10.0, 50.0, 1.0), box("b", 10.3, 49.7, 0.05)], kinds), 200)
    told = {r.job_id: r for r in where.collect()}
    assert told["a"].level == 2 and told["a"].dx == pytest.approx(0.004) and told["b"].level == 0
    means = {(r.i, r.j): r.z for r in coarse.where("job_id = 'a'").collect()}
    assert len(means) == 256 * 256 and all(z == pytest.approx(2 * (4 * i + 1.5) + 4 * j + 1.5) for (i, j), z in means.items())
    far = spark.createDataFrame([box("a", 10.01, 49.99, 0.002), box("b", 10.99, 49.01, 0.002)], kinds)
    both, _ = rasters.read_rasters(spark, path, far)
    assert {(r.job_id, r["count"] > 0) for r in both.groupBy("job_id").count().collect()} == {("a", True), ("b", True)}
    filters = both._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,dem)" in filters and "Or(" in filters  # a range for each box
    monkeypatch.setattr(rasters, "RANGES", 1)
    again, _ = rasters.read_rasters(spark, path, far)
    assert again.exceptAll(both).count() == 0 and both.exceptAll(again).count() == 0
    assert rasters.read_rasters(spark, path, spark.createDataFrame([box("x", 90.0, 5.0, 0.05)], kinds))[0].count() == 0


def test_elevation_from_a_store(spark, tmp_path):
    path = str(tmp_path / "store")
    stored_raster(spark, path)
    ring = [{"x": 10.3 + dx, "y": 49.6 + dy} for dx, dy in ((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01))]
    engine = Engine(spark, str(tmp_path))
    _, grid = engine.frames(spark.createDataFrame([("s", ring)], "job_id string, ring array<struct<x: double, y: double>>"))
    z = {(r.i, r.j): r.z for r in engine.stored_elevation(path, grid).collect()}
    at = boundaries.grid_cells(grid).join(grid.select("job_id", "epsg"), "job_id").collect()
    from orolith.functions import geo
    spots = spark.createDataFrame([(r.i, r.j, r.x, r.y, r.epsg) for r in at[:: max(1, len(at) // 50)]], "i int, j int, x double, y double, epsg int")
    for r in spots.withColumn("p", geo.lonlat(F.col("x"), F.col("y"), F.col("epsg"))).collect():
        assert z[r.i, r.j] == pytest.approx(2 * ((50.0 - r.p.y) / 0.001 - 0.5) + (r.p.x - 10.0) / 0.001 - 0.5, abs=1e-3)


def png(px, kind, filters, swatches=None):
    """A PNG whose scan lines go through the filters in turn."""
    n = px.shape[2]
    out, before = b"", np.zeros(px.shape[1] * n, int)
    for y, line in enumerate(px.reshape(len(px), -1).astype(int)):
        f, left, corner = filters[y % len(filters)], np.concatenate([np.zeros(n, int), line[:-n]]), np.concatenate([np.zeros(n, int), before[:-n]])
        p = left + before - corner
        d = np.abs(np.stack([p - left, p - before, p - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, corner))
        guess = [np.zeros_like(line), left, before, (left + before) // 2, paeth][f]
        out, before = out + bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes(), line
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, kind, 0, 0, 0)
    table = png_chunk(b"PLTE", swatches.tobytes()) if swatches is not None else b""
    return b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", head) + table + png_chunk(b"IDAT", zlib.compress(out)) + png_chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 1, 3, 2, 0]])
def test_png_pixels(filters):
    px = np.random.default_rng(4).integers(0, 256, (9, 7, 4)).astype(np.uint8)
    assert (imagery.png_pixels(png(px, 6, filters)) == px[:, :, :3]).all()
    assert (imagery.png_pixels(png(px[:, :, :3], 2, filters)) == px[:, :, :3]).all()
    assert (imagery.png_pixels(png(px[:, :, :1], 0, filters)) == px[:, :, :1]).all()
    swatches = px[0, :4, :3].copy()
    assert (imagery.png_pixels(png(px[:, :, :1] % 4, 3, filters, swatches)) == swatches[px[:, :, 0] % 4]).all()
    assert imagery.png_pixels(b"\xff\xd8\xff") is None and imagery.png_pixels(png(px, 6, filters)[:60]) is None


def test_tiles_from_png_files(spark, tmp_path):
    px = np.random.default_rng(5).integers(0, 256, (256, 256, 3)).astype(np.uint8)
    (tmp_path / "3/4").mkdir(parents=True)
    (tmp_path / "3/4/5.png").write_bytes(png(px, 2, [1, 2]))
    (tmp_path / "3/4/6.rgb").write_bytes(px.tobytes())
    (tmp_path / "3/4/7.png").write_bytes(png(px[:9, :9], 2, [0]))
    got = {(r.z, r.x, r.y): bytes(r.rgb) for r in imagery.read_tiles(spark, str(tmp_path)).collect()}
    assert got == {(3, 4, 5): px.tobytes(), (3, 4, 6): px.tobytes()}


def trap(root, *tiles):
    """Tiles that fail whoever opens them: folders of a tile file's name."""
    for t in tiles:
        (root / f"{t}.rgb").mkdir(parents=True)


WANTED = "job_id string, z int, x long, y long"


def test_only_wanted_tiles_are_opened(spark, tmp_path):
    px = np.random.default_rng(6).integers(0, 256, (256, 256, 3)).astype(np.uint8)
    trap(tmp_path, "3/4/1", "3/5/5", "2/4/5")
    (tmp_path / "3/4/5.png").write_bytes(png(px, 2, [1, 2]))
    (tmp_path / "3/4/6.rgb").write_bytes(px[::-1].tobytes())
    (tmp_path / "3/4/7.rgb").write_bytes(b"short")
    (tmp_path / "3/4/7.png").write_bytes(png(px, 2, [0]))
    rows = [("a", 3, 4, 5), ("b", 3, 4, 5), ("b", 3, 4, 6), ("b", 3, 4, 7), ("b", 3, 9, 9), ("b", 3, None, 5), ("a", 3, 4, 5)]
    want = {(3, 4, 5): px.tobytes(), (3, 4, 6): px[::-1].tobytes(), (3, 4, 7): px.tobytes()}
    for root in (str(tmp_path), f"file:{tmp_path}/", tmp_path.as_uri()):
        got = imagery.wanted_tiles(spark.createDataFrame(rows, WANTED), root).collect()
        assert len(got) == 3 and {(r.z, r.x, r.y): bytes(r.rgb) for r in got} == want
    assert imagery.wanted_tiles(spark.createDataFrame([], WANTED), str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="3/5/5"):
        imagery.wanted_tiles(spark.createDataFrame([("a", 3, 5, 5)], WANTED), str(tmp_path)).collect()


def test_next_store_is_asked_only_for_jobs_without_a_picture(spark, tmp_path):
    """Job lit is shown by the first store, dark and none only by the second, lost by neither."""
    first, second = tmp_path / "first", tmp_path / "second"
    black, grey = bytes(256 * 256 * 3), bytes([7]) * (256 * 256 * 3)
    for root, tile, content in ((first, "1/0/0", grey), (first, "1/0/1", black), (first, "1/1/0", black), (second, "1/1/0", grey), (second, "1/1/1", black[:-1] + b"\1"), (second, "2/0/0", black)):
        (root / tile).parent.mkdir(parents=True, exist_ok=True)
        (root / f"{tile}.rgb").write_bytes(content)
    trap(second, "1/0/0", "1/0/1")
    trap(tmp_path / "third", "1/0/0", "1/0/1", "1/1/0", "1/1/1")
    rows = [("lit", 1, 0, 0), ("lit", 1, 0, 1), ("dark", 1, 1, 0), ("none", 1, 1, 1), ("lost", 2, 0, 0)]
    roots = [str(first), str(second), str(tmp_path / "third")]
    got = imagery.first_shown(spark.createDataFrame(rows + rows[:1], WANTED), roots)
    assert sorted((r.job_id, r.x, r.y, r.source) for r in got.collect()) == [("dark", 1, 0, 1), ("lit", 0, 0, 0), ("lit", 0, 1, 0), ("none", 1, 1, 1)]
    grid = spark.createDataFrame([("a", 32613, 500_000.0, 4_400_000.0, 500_640.0, 4_400_500.0, 8, 8, 80.0, 62.5)], "job_id string, epsg int, west double, south double, east double, north double, width int, height int, dx double, dy double")
    low, high = geo.lonlat(F.col("west"), F.col("south"), F.col("epsg")), geo.lonlat(F.col("east"), F.col("north"), F.col("epsg"))
    for r in imagery.cover(grid.select("job_id", low["x"].alias("west"), low["y"].alias("south"), high["x"].alias("east"), high["y"].alias("north"))).collect():
        at = second / f"{r.z}/{r.x}/{r.y}.rgb"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bytes([9, 80, 200]) * (256 * 256))
    shown = Engine(spark, str(tmp_path)).stored_imagery(roots, grid)
    assert shown.count() == 64 and [tuple(r) for r in shown.select("r", "g", "b").distinct().collect()] == [(9, 80, 200)]


def test_blur_is_each_jobs_own(spark):
    cells = spark.range(12).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("alpha", F.when((F.col("i") > 4) & (F.col("j") > 3), 255).otherwise(0))
    both = cells.withColumn("job_id", F.lit("a")).unionByName(cells.withColumn("job_id", F.lit("b")))
    sigmas = spark.createDataFrame([("a", 0.75), ("b", 2.0)], "job_id string, sigma double")
    got = {(r.job_id, r.i, r.j): r.blurred for r in raster.gaussian(both, F.col("alpha"), sigmas).collect()}
    for job, sigma in (("a", 0.75), ("b", 2.0)):
        alone = raster.gaussian(both.where(F.col("job_id") == job), F.col("alpha"), sigma).collect()
        assert all(got[job, r.i, r.j] == pytest.approx(r.blurred, abs=1e-9) for r in alone) and len(alone) == 120
    assert shapes.soft_alpha(both, sigmas).count() == 240


@pytest.mark.parametrize("sigma", [1.3, 4.0, 16.0])
def test_blur_reflects_as_often_as_it_reaches(spark, sigma):
    h, w = 5, 8
    rng = np.random.default_rng(2)
    z = rng.integers(0, 256, (h, w)).astype(float)
    cells = spark.createDataFrame([("a", i, j, float(z[i, j])) for i in range(h) for j in range(w)], "job_id string, i int, j int, v double")
    got = {(r.i, r.j): r.blurred for r in raster.gaussian(cells, F.col("v"), sigma).collect()}
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    wide = np.pad(z, reach, mode="symmetric")
    rows = np.apply_along_axis(lambda r: np.convolve(r, kernel, "valid"), 0, wide)
    want = np.apply_along_axis(lambda r: np.convolve(r, kernel, "valid"), 1, rows)
    assert all(got[i, j] == pytest.approx(want[i, j]) for i in range(h) for j in range(w))
    flat = raster.gaussian(cells.withColumn("v", F.lit(100.0)), F.col("v"), sigma).collect()
    assert len(flat) == h * w and all(r.blurred == pytest.approx(100.0) for r in flat)


def test_flat_imagery_stays_flat(spark, tmp_path):
    grid = spark.createDataFrame([("a", 32613, 500_000.0, 4_400_000.0, 500_640.0, 4_400_500.0, 40, 32, 16.0, 15.625)], "job_id string, epsg int, west double, south double, east double, north double, width int, height int, dx double, dy double")
    at = Engine.cells_of(grid)
    source = spark.range(64).select(F.lit("a").alias("job_id"), F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(63)))).select("*", F.lit(10).alias("r"), F.lit(200).alias("g"), F.lit(30).alias("b"))
    low = at.select(geo.let(geo.lonlat(F.col("x"), F.col("y"), F.col("epsg")), lambda p: imagery.mercator(p["x"], p["y"])).alias("p")).agg(F.min("p.x").alias("west"), F.max("p.y").alias("north"))
    where = low.select(F.lit("a").alias("job_id"), (F.col("west") - 50).alias("west"), (F.col("north") + 50).alias("north"), F.lit(17.3).alias("dx"), F.lit(17.3).alias("dy"))
    got = Engine(spark, str(tmp_path)).imagery_on_grid(source, where, grid)
    assert got.count() == 1280 and [tuple(r) for r in got.select("r", "g", "b").distinct().collect()] == [(10, 200, 30)]


def test_prints_of_several_parts_are_made_one(spark):
    grid = spark.range(6).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(13))))
    cells = grid.select(F.lit("two").alias("job_id"), "i", "j", (F.col("j") * 10.0).alias("x"), (F.col("i") * -10.0).alias("y"), F.lit(30.0).alias("z"))
    cells = cells.unionByName(cells.withColumn("job_id", F.lit("one")))
    v, f = mesh.grid_vertices(cells), mesh.quad_faces(mesh.grid_quads(cells))
    gap = mesh.corners(f, v).where("job_id = 'two' AND (p0.x = 60 AND p2.x = 70 OR p0.x = 60 AND p1.x = 70)").select("job_id", "fid")
    *_, facts = mesh.print_solid(v, f.join(gap, ["job_id", "fid"], "left_anti"), 50.0, fuse=False)
    apart = {r.job_id: r.print_component_count for r in facts.collect()}
    assert apart == {"one": 1, "two": 2}
    sv, sf, _, facts = mesh.print_solid(v, f.join(gap, ["job_id", "fid"], "left_anti"), 50.0, fuse=True)
    told = {r.job_id: r for r in facts.collect()}
    assert told["one"].print_fused_by == "none" and told["two"].print_fused_by == "voxels"
    assert told["one"].print_component_count == 1 and told["two"].print_component_count >= 1 and all(r.print_open_edge_count == 0 for r in told.values())
    assert sv.where("job_id = 'two'").count() > 0 and sf.where("job_id = 'two'").count() > 0


def test_job_files_and_sweep(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    snapshots = spark.createDataFrame([("a", 1, "running", 10, 100.0), ("a", 2, "done", 130, 200.0), ("b", 3, "running", 50, 9_000_000.0)], "job_id string, event_id long, status string, percent int, updated_at double")
    engine.report(snapshots).collect()
    read = spark.read.text(str(tmp_path / "*/progress.json"), wholetext=True).select(jobs.snapshot(F.col("value")).alias("s")).select("s.*")
    assert {(r.status, r.percent, r.started_at) for r in read.collect()} == {("done", 100, 100.0), ("running", 50, 9_000_000.0)}
    meta = spark.createDataFrame([("a", 32632, 7)], "job_id string, epsg int, grid_width int")
    engine.save_json(meta, "meta.json").collect()
    assert [(r.job_id, r.epsg, r.grid_width) for r in artifacts.read_meta(spark, str(tmp_path / "a/meta.json")).collect()] == [("a", 32632, 7)]
    assert [r.job_id for r in engine.sweep(snapshots, F.lit(9_000_100.0)).collect()] == ["a"]
    assert not (tmp_path / "a").exists() and (tmp_path / "b").exists()
    assert engine.remove(spark.createDataFrame([("..",), ("",), (None,)], "job_id string")).count() == 0 and tmp_path.exists()
