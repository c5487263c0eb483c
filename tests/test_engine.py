"""The engine's two jobs from a boundary to files, on a small site."""

from pyspark.sql import functions as F

from orolith.engine import Engine, Options
from orolith.sources import boundaries


def test_site_to_files(spark, tmp_path):
    ring = [{"x": -105.0 + dx, "y": 39.78 + dy} for dx, dy in ((0, 0), (0.01, 0.001), (0.011, 0.008), (0.001, 0.009))]
    rings = spark.createDataFrame([("site", ring)], "job_id string, ring array<struct<x: double, y: double>>")
    engine, options = Engine(spark, str(tmp_path)), Options(grid_size=64, n_colors=3, quality="low", split_x=2)
    _, grid = engine.frames(rings, options)
    at = boundaries.grid_cells(grid)
    pond = F.col("i").between(20, 30) & F.col("j").between(20, 32)
    elevation = at.select("job_id", "i", "j", F.when(pond, 100.0).otherwise(F.lit(110.0) + F.col("i") / 10).alias("z"))
    pixels = at.select("job_id", "i", "j", *[F.when(pond, F.lit(p)).otherwise(F.lit(q) + (F.col("i") * 7 + F.col("j") * 3) % 9).alias(c) for c, p, q in (("r", 10, 92), ("g", 18, 118), ("b", 24, 58))])
    site = engine.process(rings, elevation, pixels, options)
    meta = site.meta.collect()[0]
    assert meta.epsg == 32613 and meta.print_open_edge_count == 0 and meta.print_component_count == 1 and meta.n_pond_shapes == 1
    colors, labelled, faces = engine.build_ams(site, site.ponds, options)
    rows = {r.role: r for r in colors.collect()}
    assert rows["pond"].triangle_count > 0 and sum(r.triangle_count for r in rows.values()) > 0 and colors.count() == 3
    saved = {r.file: r.size for r in engine.export(site, {"print_pieces": True, "quad_mask": True}, options).collect()}
    saved |= {r.file: r.size for r in engine.export_ams(site, colors, labelled, faces, site.solid[0]).collect()}
    assert saved["quad_mask.bin"] == (meta.height - 1) * (meta.width - 1)
    assert {"print.stl", "print_pieces.zip", "print_ams.zip", "print_ams.glb", "print_color.3mf", "ams_preview.png"} <= set(saved) and all(saved.values())
