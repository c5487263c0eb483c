"""Registered mesh, shape and export queries and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from orolith.functions import geo, names
from orolith.operators import collapse, cutting, mesh, palette, proximity, raster, shapes, solids, winding
from orolith.plans.palette_queries import COLORS
from orolith.plans.raster_queries import FOOTPRINT, PX_FULL
from orolith.sinks import files, meshes
from orolith.sources import views
from orolith.sources.views import sql, table
from orolith.storage import shared_dir, stored


def surface_cells(spark, sf_dir):
    """All embeddings as a surface in metres: 10 m a cell, heights times 40."""
    return views.emb_grid(spark, sf_dir).select("job_id", "i", "j", (F.col("j") * 10.0 + 5).alias("x"), (315.0 - F.col("i") * 10).alias("y"), (F.col("z") * 40).alias("z"))


def surface(spark, sf_dir):
    cells = surface_cells(spark, sf_dir)
    return mesh.grid_vertices(cells), mesh.quad_faces(mesh.grid_quads(cells))


def solid(spark, sf_dir):
    """The surface as a closed print. Its tables are stored: what reads them several times neither works
    them out again nor carries their plans along."""
    v, f = surface(spark, sf_dir)
    v, f = stored(mesh.to_print(stored(v, "vertices")), "print"), stored(f, "faces")
    solid_v, solid_f = mesh.close_to_floor(v, f)
    return stored(solid_v, "solid-vertices"), stored(solid_f, "solid-faces")


def disc_cells(spark, sf_dir):
    """The surface's cells with a flag: within 11 cells of the middle of each 32 rows."""
    near = F.pow(F.col("i") % 32 - 15.5, F.lit(2.0)) + F.pow(F.col("j") - 31.5, F.lit(2.0)) <= 121
    return surface_cells(spark, sf_dir).withColumn("flag", near)


def cell_centres(spark, sf_dir):
    centre = geo.cell_centre(F.col("i"), F.col("j"), F.lit(500_000.0), F.lit(4_400_000.0), F.lit(7.5), F.lit(2.5))
    return views.emb_grid(spark, sf_dir).select("i", "j", centre.alias("c")).select("i", "j", "c.x", "c.y")


def uv_coords(spark, sf_dir):
    return mesh.grid_vertices(surface_cells(spark, sf_dir)).select("vid", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


def mesh_vertices(spark, sf_dir):
    return surface(spark, sf_dir)[0].select("vid", "x", "y", F.round("z", 6).alias("z"))


def mesh_faces(spark, sf_dir):
    return surface(spark, sf_dir)[1].drop("job_id")


def edge_incidence(spark, sf_dir):
    return mesh.edges(surface(spark, sf_dir)[1]).drop("job_id")


def open_edges(spark, sf_dir):
    return mesh.edges(surface(spark, sf_dir)[1]).where("n = 1").select("a", "b")


def edge_counts(spark, sf_dir):
    return mesh.edge_counts(surface(spark, sf_dir)[1]).drop("job_id")


def non_manifold(spark, sf_dir):
    """Edges of three faces and more, in a mesh with a fin on one row of quads."""
    v, f = surface(spark, sf_dir)
    fin = f.where("v0 < 64 AND fid % 2 = 0").select("job_id", (F.col("fid") + 1_000_000).alias("fid"), "v0", "v1", (F.col("v2") + 1000).alias("v2"))
    fin = fin.unionByName(fin.withColumn("fid", F.col("fid") + 1_000_000))
    return mesh.edges(f.unionByName(fin)).where("n > 2").select("a", "b", "n")


def clipped_faces(spark, sf_dir):
    """Faces of quads with any flagged corner."""
    kept = mesh.corner_flags(disc_cells(spark, sf_dir), F.col("flag")).where("kept")
    return mesh.quad_faces(kept).drop("job_id")


def referenced_vertices(spark, sf_dir):
    cells = disc_cells(spark, sf_dir)
    faces = mesh.quad_faces(mesh.corner_flags(cells, F.col("flag")).where("kept"))
    return mesh.referenced(mesh.grid_vertices(cells), faces).select("vid")


def close_heightfield(spark, sf_dir):
    """Counts of a closed solid: vertices, faces, edges, open edges and edges of three faces."""
    v, f = mesh.close_to_floor(*surface(spark, sf_dir))
    counts = mesh.edge_counts(f)
    return v.groupBy("job_id").agg(F.count("*").alias("n_vertices")).join(f.groupBy("job_id").agg(F.count("*").alias("n_faces")), "job_id").join(counts, "job_id").drop("job_id")


def solid_volume(spark, sf_dir):
    v, f = solid(spark, sf_dir)
    out = mesh.volume(f, v)
    return out.select(F.round("volume", 3).alias("volume"), F.round("area", 3).alias("area"))


def winding_repair(spark, sf_dir):
    """The surface's faces after three in seven faces of its solid were turned and wound again."""
    solid_v, solid_f = solid(spark, sf_dir)
    f = surface(spark, sf_dir)[1]
    fixed, _ = winding.wound(solid_v, winding.turned(solid_f, F.col("fid") * F.col("fid") % 7 < 2))
    return fixed.join(f.select("job_id", "fid"), ["job_id", "fid"], "left_semi").select("fid", "v0", "v1", "v2")


def print_scale(spark, sf_dir):
    box = mesh.bounds(surface(spark, sf_dir)[0])
    return box.select(*[F.round(mesh.print_scale(200.0, nx, ny), 9).alias(f"s_{nx}x{ny}") for nx, ny in ((1, 1), (3, 1), (4, 3))])


def mesh_bounds(spark, sf_dir):
    v = mesh.to_print(surface(spark, sf_dir)[0])
    return mesh.bounds(v).select(*[F.round(f"{k}_{c}", 6).alias(f"{k}_{c}") for k in ("min", "max") for c in "xyz"])


def print_solid(spark, sf_dir):
    *_, facts = mesh.print_solid(*surface(spark, sf_dir), 200.0, 2, 1)
    return facts.select("print_component_count", "print_non_manifold_edge_count", "print_open_edge_count", "print_scale_for_puzzle_grid", *[F.round(c, 6).alias(c) for c in ("scale_meters_to_print_mm", "size_x_mm", "size_y_mm", "print_voxel_size_mm")])


def tile_assign(spark, sf_dir):
    v, f = surface(spark, sf_dir)
    return mesh.assign_tiles(f, mesh.to_print(v), 3, 2).select("fid", "ix", "iy", "tile")


def tile_cut(spark, sf_dir):
    """The print cut into 3 by 2 closed tiles: their boxes, open edges, and the volume of all together."""
    v, f = solid(spark, sf_dir)
    _, f = cutting.tiles(v.select("job_id", "vid", "x", "y", "z"), f, 3, 2)
    key = ["job_id", "tile", "ix", "iy"]
    corner = f.select(*key, F.inline(F.array("p0", "p1", "p2")))
    facts = mesh.bounds(corner, key).join(mesh.edge_counts(f, key), key).join(mesh.volume(f, by=key), key)
    box = [F.round(f"{k}_{c}", 6).alias(f"{k}_{c}") for k in ("min", "max") for c in "xy"]
    return facts.select("tile", "ix", "iy", *box, "open_edges", "non_manifold_edges", F.round(F.sum("volume").over(Window.partitionBy("job_id")), 3).alias("total_volume"))


def voxel_clamp(spark, sf_dir):
    """Voxel sizes for solids as large as suppliers' keys make them."""
    key = F.col("s_suppkey")
    ext = [(key * k % 900 + 100).cast("double") for k in (7, 11, 13)]
    size = mesh.clamp_voxel((key % 10 / 10.0).cast("double"), ext, F.lit(200.0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(size, 9).alias("voxel"))


def voxel_fill(spark, sf_dir):
    v, f = solid(spark, sf_dir)
    return mesh.voxels(v, f, voxel_sizes(v)).drop("job_id", "voxel_mm")


def voxel_sizes(v):
    """A sixteenth of a print's shorter side."""
    span = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")
    return stored(mesh.bounds(v).select("job_id", (F.least(span("x"), span("y")) / 16).alias("voxel_mm")), "voxel-sizes")


def voxel_shell(spark, sf_dir):
    v, f = solid(spark, sf_dir)
    size = voxel_sizes(v)
    filled = stored(mesh.voxel_spans(v, f, size), "spans")
    shell = mesh.span_faces(stored(mesh.span_sides(filled), "sides"), size)
    n_voxels = filled.groupBy("job_id").agg(F.sum(F.col("last").cast("long") - F.col("first") + 1).alias("n_voxels"))
    return mesh.volume(shell).join(mesh.edge_counts(shell), "job_id").join(n_voxels, "job_id").select("n_voxels", F.round("volume", 3).alias("volume"), "open_edges")


def decimate(spark, sf_dir):
    """A coarser surface of at most 800 faces: what is left of vertices and faces."""
    v, f = collapse.decimate(*surface(spark, sf_dir), 800)
    return v.groupBy("job_id").agg(F.count("*").alias("n_vertices")).join(f.groupBy("job_id").agg(F.count("*").alias("n_faces")), "job_id").select("n_vertices", "n_faces")


def decimate_shape(spark, sf_dir):
    """What collapsing edges must keep on the way to a quarter of 20,000 faces: the surface stays one piece with one
    rim and its corners, and reaches the target."""
    v, f = (stored(df, "coarse") for df in collapse.decimate(*surface(spark, sf_dir), 5000))
    euler = v.groupBy("job_id").agg(F.count("*").alias("nv")).join(f.groupBy("job_id").agg(F.count("*").alias("nf")), "job_id").join(mesh.edge_counts(f), "job_id")
    n_parts = mesh.parts(f).groupBy("job_id").agg(F.count_distinct("part").alias("n_parts"))
    return euler.join(n_parts, "job_id").select((F.col("nv") - F.col("n_edges") + F.col("nf")).alias("euler"), "n_parts", "non_manifold_edges", F.col("nf").between(4900, 5000).alias("reached"))


def footprint_solid(spark, sf_dir):
    """Each drawn shape as a job of its own, raised by 1 to 5: volume and open edges."""
    shape = drawn(spark, sf_dir).select(F.col("ord").cast("string").alias("job_id"), "ring").where(F.abs(geo.ring_area(F.col("ring"))) > 0)
    heights = shape.select("job_id", F.lit(0.0).alias("low"), (1.0 + F.col("job_id").cast("int") % 5).alias("high"))
    v, f = (stored(df, "raised") for df in solids.extruded(shape, heights))
    return mesh.volume(f, v).join(mesh.edge_counts(f), "job_id").select("job_id", F.round("volume", 4).alias("volume"), "open_edges")


def hole_filling(spark, sf_dir):
    """The print without every 997th face, its holes filled again: faces, open edges and volume."""
    v, f = solid(spark, sf_dir)
    out = stored(solids.fill_holes(v, f.where("fid % 997 <> 0")), "filled")
    return out.groupBy("job_id").agg(F.count("*").alias("n_faces")).join(mesh.edge_counts(out), "job_id").join(mesh.volume(out, v), "job_id").select("n_faces", "open_edges", F.round("volume", 3).alias("volume"))


def vertex_merge(spark, sf_dir):
    """Vertices left when each quad brings its own four and coincident ones are merged."""
    v, f = surface(spark, sf_dir)
    own = mesh.directed_edges(f).select("job_id", "fid", F.col("a").alias("old")).withColumn("vid", F.shiftleft("fid", 32) + F.col("old"))
    soup = own.join(v.withColumnRenamed("vid", "old"), ["job_id", "old"]).select("job_id", "vid", "x", "y", "z", "u", "v")
    faces = f.select("job_id", "fid", *[(F.shiftleft("fid", 32) + F.col(f"v{k}")).alias(f"v{k}") for k in range(3)])
    mv, mf = mesh.clean(soup, faces)
    return mv.groupBy("job_id").agg(F.count("*").alias("n_vertices")).join(mesh.edge_counts(mf), "job_id").drop("job_id")


def mesh_parts(spark, sf_dir):
    """Connected parts of the surface without every fifth row of quads."""
    f = surface(spark, sf_dir)[1].where("(fid div 126) % 5 <> 4")
    return mesh.parts(f).groupBy("part").agg(F.count("*").alias("n_vertices"))


def gap_closing(spark, sf_dir):
    """Lowest and highest point of the same parts, each lifted by its number, after closing gaps."""
    v, f = surface(spark, sf_dir)
    f = f.where("(fid div 126) % 5 <> 4")
    used = mesh.referenced(v, f)
    lifted = used.withColumn("z", F.col("z") + F.floor(F.col("vid") / 320) * 100)
    moved = mesh.close_gaps(lifted, f)
    return moved.groupBy(F.floor(F.col("vid") / 320).cast("int").alias("band")).agg(F.round(F.min("z"), 6).alias("low"), F.round(F.max("z"), 6).alias("high"))


def boundary_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in views.BOUNDARY])
    return spark.range(1).select(F.lit("px").alias("job_id"), ring.alias("ring"))


def px_cells(spark, sf_dir):
    return raster.full_grid(views.px_grid(spark, sf_dir)).select("job_id", "i", "j", (F.col("j") + 0.5).alias("x"), (F.lit(99.5) - F.col("i")).alias("y"), F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("r", F.lit(0)).alias("r"))


def quad_mask_corners(spark, sf_dir):
    return mesh.corner_flags(px_cells(spark, sf_dir), F.col("r") >= 128).select("i", "j", F.col("kept").cast("int").alias("kept"))


def quad_mask_polygon(spark, sf_dir):
    return shapes.quad_mask(px_cells(spark, sf_dir), boundary_ring(spark)).select("i", "j", F.col("included").cast("int").alias("included"))


def all_touched(spark, sf_dir):
    cells = px_cells(spark, sf_dir).withColumns({"dx": F.lit(1.0), "dy": F.lit(1.0)})
    return shapes.touched(cells, boundary_ring(spark)).select("i", "j")


def point_in_polygon(spark, sf_dir):
    cells = raster.full_grid(views.px_grid(spark, sf_dir)).select("i", "j")
    return cells.withColumn("inside", geo.inside(F.col("j") + 0.5, F.col("i") + 0.5, views.BOUNDARY))


def drawn(spark, sf_dir):
    """Shapes by supplier: triangles and squares, some too small, of two corners, or off the raster."""
    key = F.col("s_suppkey")
    x, y, s = (key * 13 % 110 - 5).cast("double"), (key * 29 % 110 - 5).cast("double"), (key % 9).cast("double")
    p = lambda dx, dy: F.struct((x + s * dx).alias("x"), (y + s * dy).alias("y"))
    ring = F.when(key % 10 == 0, F.array(p(0, 0), p(1, 1))).when(key % 2 == 0, F.array(p(0, 0), p(1, 0), p(0.25, 1))).otherwise(F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1)))
    source = F.when(key % 3 == 0, "auto").when(key % 3 == 1, "manual").otherwise("other")
    return table(spark, sf_dir, "supplier").select(F.lit("px").alias("job_id"), key.alias("ord"), key.cast("string").alias("id"), source.alias("source"), ring.alias("ring"))


def raster_size(spark):
    return spark.range(1).select(F.lit("px").alias("job_id"), F.lit(100).alias("h"), F.lit(100).alias("w"))


def validate_shapes(spark, sf_dir):
    good = shapes.valid_shapes(drawn(spark, sf_dir), raster_size(spark))
    return good.select("ord", "id", "source", F.size("ring").alias("n_corners"), F.round(F.abs(geo.ring_area(F.col("ring"))), 6).alias("area"))


def polygons_to_mask(spark, sf_dir):
    foot = px_cells(spark, sf_dir).where("r > 60")
    return shapes.polygon_mask(drawn(spark, sf_dir), raster_size(spark), foot).select("i", "j")


def delete_at(spark, sf_dir):
    click = spark.range(1).select(F.lit("px").alias("job_id"), F.lit(22.2).alias("x"), F.lit(40.1).alias("y"))
    return shapes.delete_at(drawn(spark, sf_dir).where("size(ring) >= 3"), click).select("ord", "id")


def closed_mask(spark, sf_dir):
    cells = raster.full_grid(views.px_grid(spark, sf_dir)).where(geo.inside(F.col("j") + 0.5, F.col("i") + 0.5, views.BOUNDARY))
    return shapes.closed_mask(cells, 3.0).select("i", "j")


def clipped_surface(spark, sf_dir):
    """Vertices, faces and area of a flat grid cut to the boundary."""
    v, f = shapes.clipped_mesh(px_cells(spark, sf_dir).withColumn("z", F.lit(0.0)), boundary_ring(spark))
    area = mesh.volume(f, v)
    counts = v.groupBy("job_id").agg(F.count("*").alias("n_vertices")).join(f.groupBy("job_id").agg(F.count("*").alias("n_faces")), "job_id")
    return counts.join(area, "job_id").select("n_vertices", "n_faces", F.round("area", 4).alias("area"))


def sites(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.lit("emb").alias("job_id"), key.alias("pid"), (key * 37 % 640 + 0.25).cast("double").alias("x"), (key * 53 % 320 + 0.125).cast("double").alias("y"))


def nearest_vertex(spark, sf_dir):
    return mesh.nearest_vertices(sites(spark, sf_dir), surface(spark, sf_dir)[0], ["u", "v"]).select("pid", "vid", F.round("d2", 6).alias("d2"), F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


def closest_place(spark, sf_dir):
    points = sites(spark, sf_dir).withColumn("z", (F.col("pid") * 29 % 160 - 60).cast("double"))
    out = proximity.closest(points, *surface(spark, sf_dir), ["u", "v"])
    return out.select("pid", F.round(F.sqrt("d2"), 6).alias("distance"), F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


def bary_height(spark, sf_dir):
    grid = surface_cells(spark, sf_dir).groupBy("job_id").agg((F.max("i") + 1).alias("h"))
    grid = grid.select("job_id", "h", F.lit(64).alias("w"), F.lit(5.0).alias("west"), F.lit(315.0).alias("north"), F.lit(10.0).alias("dx"), F.lit(10.0).alias("dy"))
    return mesh.heights_at(sites(spark, sf_dir), surface(spark, sf_dir)[0], grid).select("pid", *[F.round(c, 6).alias(c) for c in "zuv"])


def px_labels(spark, sf_dir):
    return views.px_grid(spark, sf_dir).select(F.lit("emb").alias("job_id"), "i", "j", (F.floor(F.col("r") / 32) % 4).cast("int").alias("label"))


def labelled_faces(spark, sf_dir):
    v, f = surface(spark, sf_dir)
    return mesh.label_faces(mesh.top_faces(f, v), v, px_labels(spark, sf_dir), 0)


def face_labels_mode(spark, sf_dir):
    v, f = surface(spark, sf_dir)
    return mesh.label_faces(f, v, px_labels(spark, sf_dir), 0).select("fid", "label")


def top_faces(spark, sf_dir):
    v, f = surface(spark, sf_dir)
    return mesh.top_faces(f, v.withColumn("z", F.col("z") * 2)).select("fid", "is_top")


def tri_counts(spark, sf_dir):
    counts = labelled_faces(spark, sf_dir).groupBy("job_id", F.col("label").alias("index")).agg(F.count("*").alias("n"))
    slots = spark.range(5).select(F.lit("emb").alias("job_id"), F.col("id").cast("int").alias("index"))
    return slots.join(counts, ["job_id", "index"], "left").select("index", F.coalesce("n", F.lit(0).cast("long")).alias("triangle_count"))


def submeshes(spark, sf_dir):
    v, f = surface(spark, sf_dir)
    faces, _ = mesh.submeshes(mesh.label_faces(f, v, px_labels(spark, sf_dir), 0))
    return faces.select("label", "fid", "v0", "v1", "v2")


def vertex_colors(spark, sf_dir):
    v, f = surface(spark, sf_dir)
    colors = palette.literal_palette(spark, COLORS, "emb")
    return mesh.vertex_colors(mesh.label_faces(f, v, px_labels(spark, sf_dir), 0), colors).drop("job_id")


def export_obj(spark, sf_dir):
    v, f = surface(spark, sf_dir)
    lines = meshes.vertex_lines(v).select(F.lit("v").alias("kind"), "n", "line")
    return lines.unionByName(f.select(F.lit("f").alias("kind"), F.col("fid").alias("n"), meshes.face_line().alias("line")))


def export_3mf(spark, sf_dir):
    v, f = surface(spark, sf_dir)
    lines = meshes.xml_vertices(v).select(F.lit("v").alias("kind"), "n", "line")
    return lines.unionByName(f.select(F.lit("t").alias("kind"), F.col("fid").alias("n"), meshes.xml_triangle().alias("line")))


def coordinate_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.coordinate(F.col("p_retailprice") / 7).alias("text"))


def saved_files(spark, sf_dir):
    """Files of the surface and its closed solid written by tasks: their names and sizes."""
    v, f = surface(spark, sf_dir)
    v = stored(mesh.to_print(v), "surface")
    solid_v, solid_f = mesh.numbered(*mesh.close_to_floor(v, f))
    solid_f = stored(solid_f, "solid-faces")
    colors = palette.literal_palette(spark, COLORS, "emb").withColumns({"role": F.lit("land"), "filament_rgb": F.lit(None).cast("array<int>"), "name": F.lit("x"), "part_name": F.format_string("%02d_x", F.col("index") + 1), "material_name": F.format_string("%02d_x", F.col("index") + 1), "hex": F.lit(""), "coverage_pct": F.lit(0.0)})
    labelled = stored(mesh.label_faces(f, v, px_labels(spark, sf_dir), 0), "labelled")
    pieces = meshes.stl(solid_v, solid_f, total=solid_f.count()).unionByName(meshes.glb(v, f)).unionByName(meshes.threemf(solid_v, solid_f)).unionByName(meshes.obj_colored(v, labelled, colors))
    return stored(files.save(pieces, f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/files-{uuid.uuid4().hex}"), "saved").select("file", F.when(F.col("file").endswith(".stl"), F.col("size")).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        cell_centres, uv_coords, mesh_vertices, mesh_faces, edge_incidence, open_edges, edge_counts, non_manifold, clipped_faces, referenced_vertices, close_heightfield, solid_volume, winding_repair,
        print_scale, mesh_bounds, print_solid, tile_assign, tile_cut, voxel_clamp, voxel_fill, voxel_shell, decimate, decimate_shape, footprint_solid, hole_filling, vertex_merge, mesh_parts, gap_closing, quad_mask_corners,
        quad_mask_polygon, all_touched, point_in_polygon, validate_shapes, polygons_to_mask, delete_at, closed_mask, clipped_surface, nearest_vertex, closest_place, bary_height,
        face_labels_mode, top_faces, tri_counts, submeshes, vertex_colors, export_obj, export_3mf, coordinate_text, saved_files,
    )
}

#: The surface as CTEs: cells c, vertices v, faces f, edges e.
C = "c AS (SELECT i, j, j * 10.0 + 5 AS x, 315.0 - i * 10 AS y, z * 40 AS z FROM emb)"
V = f"{C}, v AS (SELECT CAST(i AS BIGINT) * 64 + j AS vid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, z, (j + 0.5::DOUBLE) / 64 AS u, 1 - (i + 0.5::DOUBLE) / (SELECT max(i) + 1 FROM c) AS v FROM c)"
QF = "SELECT (i * 63 + j) * 2::BIGINT + k AS fid, CASE k WHEN 0 THEN i * 64 + j ELSE (i + 1) * 64 + j END::BIGINT AS v0, CASE k WHEN 0 THEN (i + 1) * 64 + j ELSE (i + 1) * 64 + j + 1 END::BIGINT AS v1, (i * 64 + j + 1)::BIGINT AS v2"
VF = f"{V}, f AS ({QF} FROM c, (SELECT unnest([0, 1]) AS k) WHERE i < (SELECT max(i) FROM c) AND j < 63)"
EDGES = "d AS (SELECT fid, v0 AS a, v1 AS b FROM f UNION ALL SELECT fid, v1, v2 FROM f UNION ALL SELECT fid, v2, v0 FROM f), e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM d GROUP BY 1, 2)"
DISC = f"""{V}, k AS (SELECT i, j FROM c WHERE (i % 32 - 15.5) ** 2 + (j - 31.5) ** 2 <= 121),
    q AS (SELECT DISTINCT i - a.d AS i, j - b.d AS j FROM k, (SELECT unnest([0, 1]) AS d) a, (SELECT unnest([0, 1]) AS d) b), f AS ({QF} FROM q, (SELECT unnest([0, 1]) AS k) WHERE i BETWEEN 0 AND (SELECT max(i) - 1 FROM c) AND j BETWEEN 0 AND 62)"""
PRINT = "s AS (SELECT 200 / greatest(max(x) - min(x), max(y) - min(y)) AS s, (max(x) + min(x)) / 2 AS mx, (max(y) + min(y)) / 2 AS my, min(z) AS lo FROM v), p AS (SELECT vid, (x - mx) * s AS x, (y - my) * s AS y, (z - lo) * s + 1 AS z FROM v, s)"
LABELS = "lab AS (SELECT i, j, CAST(floor(r / 32) % 4 AS INT) AS label FROM px)"
SPOTS = "w AS (SELECT * FROM (VALUES (0, 1/3::DOUBLE, 1/3::DOUBLE, 1/3::DOUBLE), (1, 2/3::DOUBLE, 1/6::DOUBLE, 1/6::DOUBLE), (2, 1/6::DOUBLE, 2/3::DOUBLE, 1/6::DOUBLE), (3, 1/6::DOUBLE, 1/6::DOUBLE, 2/3::DOUBLE)) AS t(k, w0, w1, w2))"
VOTES = f"""{LABELS}, {SPOTS}, size AS (SELECT max(i) + 1 AS h, max(j) + 1 AS w FROM lab),
    spot AS (SELECT fid, CAST(greatest(0, least(h - 1, trunc((1 - (w0 * a.v + w1 * b.v + w2 * c2.v)) * h))) AS INT) AS i, CAST(greatest(0, least(size.w - 1, trunc((w0 * a.u + w1 * b.u + w2 * c2.u) * size.w))) AS INT) AS j
        FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c2 ON c2.vid = v2, w, size),
    n AS MATERIALIZED (SELECT fid, label, count(*) AS n FROM spot JOIN lab USING (i, j) GROUP BY 1, 2), best AS (SELECT fid, arg_min(label, (-n, label)) AS label FROM n GROUP BY 1),
    fl AS MATERIALIZED (SELECT f.*, coalesce(label, 0) AS label FROM f LEFT JOIN best USING (fid))"""
CROSS = """t AS (SELECT fid, (b.y - a.y) * (c2.z - a.z) - (b.z - a.z) * (c2.y - a.y) AS nx, (b.z - a.z) * (c2.x - a.x) - (b.x - a.x) * (c2.z - a.z) AS ny, (b.x - a.x) * (c2.y - a.y) - (b.y - a.y) * (c2.x - a.x) AS nz,
    a.z AS za, b.z AS zb, c2.z AS zc, a.x AS xa, b.x AS xb, c2.x AS xc, a.y AS ya, b.y AS yb, c2.y AS yc FROM f JOIN {0} a ON a.vid = v0 JOIN {0} b ON b.vid = v1 JOIN {0} c2 ON c2.vid = v2)"""
POINTS = "pts AS (SELECT s_suppkey AS pid, CAST(s_suppkey * 37 % 640 + 0.25 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 320 + 0.125 AS DOUBLE) AS y FROM supplier)"
G10 = "regexp_replace(regexp_replace(printf('%.10g', {0}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
RING = ", ".join(f"({k}, {x!r}, {y!r})" for k, (x, y) in enumerate(views.BOUNDARY))
SIDES = f"ring AS (SELECT * FROM (VALUES {RING}) AS t(k, x, y)), side AS (SELECT a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM ring a JOIN ring b ON b.k = (a.k + 1) % {len(views.BOUNDARY)})"
#: Whether boxes (x0, y0, x1, y1, i, j) meet the ring: a corner of it inside, a crossing of sides, or the middle inside.
MEETS = """meets AS (SELECT i, j, bool_or((px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1)
        OR (SELECT true WHERE greatest(0, CASE WHEN qx = px THEN CASE WHEN px BETWEEN x0 AND x1 THEN 0 ELSE 2 END ELSE least((x0 - px) / (qx - px), (x1 - px) / (qx - px)) END, CASE WHEN qy = py THEN CASE WHEN py BETWEEN y0 AND y1 THEN 0 ELSE 2 END ELSE least((y0 - py) / (qy - py), (y1 - py) / (qy - py)) END)
            <= least(1, CASE WHEN qx = px THEN 1 ELSE greatest((x0 - px) / (qx - px), (x1 - px) / (qx - px)) END, CASE WHEN qy = py THEN 1 ELSE greatest((y0 - py) / (qy - py), (y1 - py) / (qy - py)) END)) IS NOT NULL)
        OR sum(CASE WHEN (py > (y0 + y1) / 2) <> (qy > (y0 + y1) / 2) AND (x0 + x1) / 2 < px + ((y0 + y1) / 2 - py) * (qx - px) / (qy - py) THEN 1 ELSE 0 END) % 2 = 1 AS meets FROM box, side GROUP BY i, j)"""
DRAWN = """k AS (SELECT s_suppkey AS ord, s_suppkey * 13 % 110 - 5 AS x, s_suppkey * 29 % 110 - 5 AS y, s_suppkey % 9 AS s FROM supplier),
    corner AS (SELECT ord, n, x + s * dx AS x, y + s * dy AS y FROM k, (VALUES (0, 0, 0::DOUBLE, 0::DOUBLE), (0, 1, 1, 0), (0, 2, 0.25, 1), (1, 0, 0, 0), (1, 1, 1, 0), (1, 2, 1, 1), (1, 3, 0, 1)) AS t(odd, n, dx, dy) WHERE ord % 2 = odd AND ord % 10 <> 0)"""
GOOD = f"""{DRAWN}, clamped AS (SELECT ord, n, greatest(0, least(99, x)) AS x, greatest(0, least(99, y)) AS y FROM corner),
    ringside AS (SELECT ord, n, x AS px, y AS py, coalesce(lead(x) OVER w, first(x) OVER w) AS qx, coalesce(lead(y) OVER w, first(y) OVER w) AS qy FROM clamped WINDOW w AS (PARTITION BY ord ORDER BY n)),
    area AS (SELECT ord, count(*) AS n_corners, abs(sum(px * qy - qx * py)) / 2 AS area FROM ringside GROUP BY 1),
    good AS (SELECT *, row_number() OVER (ORDER BY ord) AS rank FROM area WHERE area >= 1 QUALIFY rank <= 64)"""

SQL = {
    "cell_centres": sql("emb", "SELECT i, j, 500000 + (j + 0.5::DOUBLE) * 7.5 AS x, 4400000 - (i + 0.5::DOUBLE) * 2.5 AS y FROM emb"),
    "uv_coords": sql("emb", f", {V} SELECT vid, round(u, 9) AS u, round(v, 9) AS v FROM v"),
    "mesh_vertices": sql("emb", f", {V} SELECT vid, x, y, round(z, 6) AS z FROM v"),
    "mesh_faces": sql("emb", f", {VF} SELECT * FROM f"),
    "edge_incidence": sql("emb", f", {VF}, {EDGES} SELECT * FROM e"),
    "open_edges": sql("emb", f", {VF}, {EDGES} SELECT a, b FROM e WHERE n = 1"),
    "edge_counts": sql("emb", f", {VF}, {EDGES} SELECT count(*) AS n_edges, count(*) FILTER (WHERE n = 1) AS open_edges, count(*) FILTER (WHERE n > 2) AS non_manifold_edges FROM e"),
    "non_manifold": sql("emb", f""", {VF}, d AS (SELECT v0 AS a, v1 AS b FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v0 FROM f
        UNION ALL SELECT v0, v1 FROM f, (SELECT unnest([1, 2])) WHERE v0 < 64 AND fid % 2 = 0 UNION ALL SELECT v1, v2 + 1000 FROM f, (SELECT unnest([1, 2])) WHERE v0 < 64 AND fid % 2 = 0 UNION ALL SELECT v2 + 1000, v0 FROM f, (SELECT unnest([1, 2])) WHERE v0 < 64 AND fid % 2 = 0)
        SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) > 2"""),
    "clipped_faces": sql("emb", f", {DISC} SELECT * FROM f"),
    "referenced_vertices": sql("emb", f", {DISC} SELECT v0 AS vid FROM f UNION SELECT v1 FROM f UNION SELECT v2 FROM f"),
    "close_heightfield": sql("emb", f", {VF}, {EDGES}, r AS (SELECT count(*) AS rim FROM e WHERE n = 1) SELECT 2 * (SELECT count(*) FROM v) AS n_vertices, 2 * (SELECT count(*) FROM f) + 2 * rim AS n_faces, 3 * (2 * (SELECT count(*) FROM f) + 2 * rim) // 2 AS n_edges, 0::BIGINT AS open_edges, 0::BIGINT AS non_manifold_edges FROM r"),
    "solid_volume": sql("emb", f""", {VF}, {PRINT}, {CROSS.format('p')}, {EDGES}
        SELECT round((SELECT sum((za + zb + zc) / 3 * nz / 2) FROM t), 3) AS volume, round((SELECT sum(sqrt(nx * nx + ny * ny + nz * nz)) / 2 + sum(nz) / 2 FROM t)
        + (SELECT sum(sqrt((a1.x - b1.x) ** 2 + (a1.y - b1.y) ** 2) * (a1.z + b1.z) / 2) FROM e JOIN p a1 ON a1.vid = e.a JOIN p b1 ON b1.vid = e.b WHERE n = 1), 3) AS area"""),
    "winding_repair": sql("emb", f", {VF} SELECT fid, v0, v1, v2 FROM f"),
    "print_scale": sql("emb", f", {V}, s AS (SELECT max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM v) SELECT round(200 / greatest(dx, dy), 9) AS s_1x1, round(200 / greatest(dx / 3, dy), 9) AS s_3x1, round(200 / greatest(dx / 4, dy / 3), 9) AS s_4x3 FROM s"),
    "mesh_bounds": sql("emb", f", {V}, {PRINT} SELECT " + ", ".join(f"round({k}({c}), 6) AS {k}_{c}" for k in ("min", "max") for c in "xyz") + " FROM p"),
    "tile_assign": sql("emb", f""", {VF}, {PRINT}, b AS (SELECT min(x) - 0.02 AS x0, max(x) + 0.02 AS x1, min(y) - 0.02 AS y0, max(y) + 0.02 AS y1 FROM p), {CROSS.format('p')},
        g AS (SELECT fid, CAST(least(2, floor(((xa + xb + xc) / 3 - x0) / ((x1 - x0) / 3))) AS INT) AS ix, CAST(least(1, floor(((ya + yb + yc) / 3 - y0) / ((y1 - y0) / 2))) AS INT) AS iy FROM t, b)
        SELECT fid, ix, iy, 1 + ix + iy * 3 AS tile FROM g"""),
    "tile_cut": sql("emb", f""", {VF}, {PRINT}, b AS (SELECT min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM p), {CROSS.format('p')}, total AS (SELECT round(sum((za + zb + zc) / 3 * nz / 2), 3) AS total_volume FROM t),
        k AS (SELECT *, (bx1 - bx0 + 0.04) / 3 AS dx, (by1 - by0 + 0.04) / 2 AS dy FROM b, (SELECT unnest([0, 1, 2]) AS ix), (SELECT unnest([0, 1]) AS iy))
        SELECT 1 + ix + iy * 3 AS tile, ix, iy, round(greatest(bx0, bx0 - 0.02 + ix * dx), 6) AS min_x, round(least(bx1, bx0 - 0.02 + (ix + 1) * dx), 6) AS max_x,
        round(greatest(by0, by0 - 0.02 + iy * dy), 6) AS min_y, round(least(by1, by0 - 0.02 + (iy + 1) * dy), 6) AS max_y, 0::BIGINT AS open_edges, 0::BIGINT AS non_manifold_edges, total_volume FROM k, total"""),
    "decimate_shape": sql("emb", f", {VF}, {EDGES} SELECT (SELECT count(*) FROM v) - (SELECT count(*) FROM e) + (SELECT count(*) FROM f) AS euler, 1::BIGINT AS n_parts, 0::BIGINT AS non_manifold_edges, true AS reached"),
    "hole_filling": sql("emb", f""", {VF}, {PRINT}, {CROSS.format('p')}, {EDGES}
        SELECT 2 * (SELECT count(*) FROM f) + 2 * (SELECT count(*) FROM e WHERE n = 1) AS n_faces, 0::BIGINT AS open_edges, (SELECT round(sum((za + zb + zc) / 3 * nz / 2), 3) FROM t) AS volume"""),
    "footprint_solid": f"""WITH {DRAWN}, side AS (SELECT ord, x AS px, y AS py, coalesce(lead(x) OVER w, first(x) OVER w) AS qx, coalesce(lead(y) OVER w, first(y) OVER w) AS qy FROM corner WINDOW w AS (PARTITION BY ord ORDER BY n)),
        area AS (SELECT ord, abs(sum(px * qy - qx * py)) / 2 AS area FROM side GROUP BY 1) SELECT CAST(ord AS VARCHAR) AS job_id, round(area * (1 + ord % 5), 4) AS volume, 0::BIGINT AS open_edges FROM area WHERE area > 0""",
    "mesh_parts": sql("emb", """, r AS (SELECT DISTINCT CAST(i AS BIGINT) AS i, j FROM emb), q AS (SELECT DISTINCT i, i // 5 AS band FROM (SELECT i FROM r WHERE i < (SELECT max(i) FROM r)) WHERE i % 5 <> 4),
        u AS (SELECT DISTINCT band, i + d AS i FROM q, (SELECT unnest([0, 1]) AS d)) SELECT CAST(min(u.i) * 64 AS BIGINT) AS part, count(*) AS n_vertices FROM u JOIN r USING (i) GROUP BY band"""),
    "voxel_clamp": "WITH RECURSIVE s AS (SELECT s_suppkey, CAST(s_suppkey * 7 % 900 + 100 AS DOUBLE) AS a, CAST(s_suppkey * 11 % 900 + 100 AS DOUBLE) AS b, CAST(s_suppkey * 13 % 900 + 100 AS DOUBLE) AS c FROM supplier), g AS (SELECT s_suppkey, a, b, c, 0 AS k, greatest(s_suppkey % 10 / 10.0::DOUBLE, 0.35::DOUBLE, 2.5::DOUBLE) AS vs FROM s UNION ALL SELECT s_suppkey, a, b, c, k + 1, CASE WHEN (ceil(a / vs) + 1) * (ceil(b / vs) + 1) * (ceil(c / vs) + 1) > 48000000 THEN vs * 1.35 ELSE vs END FROM g WHERE k < 12) SELECT s_suppkey, round(vs, 9) AS voxel FROM g WHERE k = 12",
    "vertex_merge": sql("emb", f", {VF}, {EDGES} SELECT (SELECT count(*) FROM v) AS n_vertices, count(*) AS n_edges, count(*) FILTER (WHERE n = 1) AS open_edges, count(*) FILTER (WHERE n > 2) AS non_manifold_edges FROM e"),
    "quad_mask_corners": sql("px", f", {PX_FULL}, k AS (SELECT DISTINCT i - a.d AS i, j - b.d AS j FROM full_px, (SELECT unnest([0, 1]) AS d) a, (SELECT unnest([0, 1]) AS d) b WHERE r >= 128) SELECT f.i, f.j, CASE WHEN k.i IS NULL THEN 0 ELSE 1 END AS kept FROM full_px f LEFT JOIN k ON k.i = f.i AND k.j = f.j WHERE f.i < (SELECT max(i) FROM full_px) AND f.j < (SELECT max(j) FROM full_px)"),
    "quad_mask_polygon": sql("px", f", {PX_FULL}, {SIDES}, box AS (SELECT i, j, j + 0.5 AS x0, j + 1.5 AS x1, 98.5 - i AS y0, 99.5 - i AS y1 FROM full_px WHERE i < (SELECT max(i) FROM full_px) AND j < (SELECT max(j) FROM full_px)), {MEETS} SELECT i, j, CAST(meets AS INT) AS included FROM meets"),
    "all_touched": sql("px", f", {PX_FULL}, {SIDES}, box AS (SELECT i, j, CAST(j AS DOUBLE) AS x0, j + 1.0 AS x1, 99.0 - i AS y0, 100.0 - i AS y1 FROM full_px), {MEETS} SELECT i, j FROM meets WHERE meets"),
    "point_in_polygon": sql("px", f", {PX_FULL}, {FOOTPRINT} SELECT i, j, inside FROM fp"),
    "validate_shapes": f"WITH {GOOD} SELECT ord, CAST(ord AS VARCHAR) AS id, CASE ord % 3 WHEN 0 THEN 'auto' ELSE 'manual' END AS source, CAST(n_corners AS INT) AS n_corners, round(area, 6) AS area FROM good",
    "polygons_to_mask": sql("px", f""", {PX_FULL}, {GOOD}, hit AS (SELECT c.i, c.j, s.ord, count(*) AS n FROM full_px c JOIN ringside s ON (s.py > c.i + 0.5) <> (s.qy > c.i + 0.5) AND c.j + 0.5 < s.px + (c.i + 0.5 - s.py) * (s.qx - s.px) / (s.qy - s.py) JOIN good USING (ord) WHERE c.r > 60 AND c.j < 100 GROUP BY 1, 2, 3)
        SELECT DISTINCT i, j FROM hit WHERE n % 2 = 1"""),
    "delete_at": f"""WITH {DRAWN}, rs AS (SELECT ord, x AS px, y AS py, coalesce(lead(x) OVER w, first(x) OVER w) AS qx, coalesce(lead(y) OVER w, first(y) OVER w) AS qy FROM corner WINDOW w AS (PARTITION BY ord ORDER BY n)),
        hit AS (SELECT ord FROM rs WHERE (py > 40.1) <> (qy > 40.1) AND 22.2 < px + (40.1 - py) * (qx - px) / (qy - py) GROUP BY 1 HAVING count(*) % 2 = 1)
        SELECT DISTINCT ord, CAST(ord AS VARCHAR) AS id FROM rs WHERE ord IS DISTINCT FROM (SELECT max(ord) FROM hit)""",
    "nearest_vertex": sql("emb", f", {V}, {POINTS}, n AS (SELECT pid, vid, (p.x - v.x) ** 2 + (p.y - v.y) ** 2 AS d2, u, v.v, row_number() OVER (PARTITION BY pid ORDER BY (p.x - v.x) ** 2 + (p.y - v.y) ** 2, vid) AS k FROM pts p, v) SELECT pid, vid, round(d2, 6) AS d2, round(u, 9) AS u, round(v, 9) AS v FROM n WHERE k = 1"),
    "closest_place": sql("emb", f""", {VF}, {POINTS}, q AS (SELECT pid, x, y, CAST(pid * 29 % 160 - 60 AS DOUBLE) AS z FROM pts),
        t AS (SELECT pid, fid, {', '.join(f"q.{c} AS p{c}, a.{c} AS a{c}, b.{c} - a.{c} AS e{c}, k.{c} - a.{c} AS f{c}, q.{c} - a.{c} AS g{c}" for c in 'xyz')}, a.u AS au, a.v AS av, b.u - a.u AS eu, b.v - a.v AS ev, k.u - a.u AS fu, k.v - a.v AS fv
          FROM q, f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v k ON k.vid = v2),
        d AS (SELECT *, {', '.join(' + '.join(f"{a}{c} * {b}{c}" for c in 'xyz') + f" AS {a}{b}" for a, b in ('ee', 'ef', 'ff', 'ge', 'gf'))} FROM t),
        s AS (SELECT *, unnest([
          struct_pack(s := greatest(0, least(1, ge / ee)), t := 0.0::DOUBLE), struct_pack(s := 0.0::DOUBLE, t := greatest(0, least(1, gf / ff))),
          struct_pack(s := 1 - greatest(0, least(1, (gf - ge - ef + ee) / (ee - 2 * ef + ff))), t := greatest(0, least(1, (gf - ge - ef + ee) / (ee - 2 * ef + ff)))),
          CASE WHEN ff * ge - ef * gf >= 0 AND ee * gf - ef * ge >= 0 AND ff * ge - ef * gf + ee * gf - ef * ge <= ee * ff - ef * ef THEN struct_pack(s := (ff * ge - ef * gf) / (ee * ff - ef * ef), t := (ee * gf - ef * ge) / (ee * ff - ef * ef)) END]) AS w FROM d),
        r AS (SELECT pid, fid, {' + '.join(f"(g{c} - w.s * e{c} - w.t * f{c}) ** 2" for c in 'xyz')} AS d2, au + w.s * eu + w.t * fu AS u, av + w.s * ev + w.t * fv AS v FROM s WHERE w IS NOT NULL),
        o AS (SELECT pid, min((round(d2, 12), fid, d2, u, v)) AS m FROM r GROUP BY pid)
        SELECT pid, round(sqrt(m[3]), 6) AS distance, round(m[4], 6) AS u, round(m[5], 6) AS v FROM o"""),
    "bary_height": sql("emb", f""", {V}, {POINTS}, g AS (SELECT pid, (315 - y) / 10 AS fi, (x - 5) / 10 AS fj FROM pts), h AS (SELECT *, least(floor(fi), (SELECT max(i) - 1 FROM c))::BIGINT AS a, least(floor(fj), 62)::BIGINT AS b FROM g WHERE fi BETWEEN 0 AND (SELECT max(i) FROM c) AND fj BETWEEN 0 AND 63),
        k AS (SELECT pid, fi - a AS s, fj - b AS t, a * 64 + b AS vid FROM h)
        SELECT pid, {', '.join(f"round(CASE WHEN s + t <= 1 THEN (1 - s - t) * v00.{c} + s * v10.{c} + t * v01.{c} ELSE (1 - t) * v10.{c} + (s + t - 1) * v11.{c} + (1 - s) * v01.{c} END, 6) AS {c}" for c in 'zuv')}
        FROM k JOIN v v00 ON v00.vid = k.vid JOIN v v10 ON v10.vid = k.vid + 64 JOIN v v01 ON v01.vid = k.vid + 1 JOIN v v11 ON v11.vid = k.vid + 65"""),
    "face_labels_mode": sql("emb px", f", {VF}, {VOTES} SELECT fid, label FROM fl"),
    "top_faces": sql("emb", f", {VF.replace('z * 40 AS z', 'z * 80 AS z')}, {CROSS.format('v')} SELECT fid, CASE WHEN nx * nx + ny * ny + nz * nz > 0 THEN nz / sqrt(nx * nx + ny * ny + nz * nz) > 0.35 ELSE false END AS is_top FROM t"),
    "tri_counts": sql("emb px", f", {VF}, {VOTES}, {CROSS.format('v')}, l AS (SELECT CASE WHEN nz / sqrt(nx * nx + ny * ny + nz * nz) > 0.35 THEN label ELSE 0 END AS label FROM fl JOIN t USING (fid)) SELECT CAST(k AS INT) AS index, count(label) AS triangle_count FROM (SELECT unnest(range(5)) AS k) LEFT JOIN l ON label = k GROUP BY 1"),
    "submeshes": sql("emb px", f""", {VF}, {VOTES}, o AS MATERIALIZED (SELECT fid, label, 0 AS k, v0 AS vid FROM fl UNION ALL SELECT fid, label, 1, v1 FROM fl UNION ALL SELECT fid, label, 2, v2 FROM fl),
        r AS MATERIALIZED (SELECT label, vid, row_number() OVER (PARTITION BY label ORDER BY vid) - 1 AS n FROM (SELECT DISTINCT label, vid FROM o))
        SELECT label, fid, max(CASE k WHEN 0 THEN n END) AS v0, max(CASE k WHEN 1 THEN n END) AS v1, max(CASE k WHEN 2 THEN n END) AS v2 FROM o JOIN r USING (label, vid) GROUP BY label, fid"""),
    "vertex_colors": sql("emb px", f", {VF}, {VOTES}, o AS (SELECT v0 AS vid, 0 AS k, fid, label FROM fl UNION ALL SELECT v1, 1, fid, label FROM fl UNION ALL SELECT v2, 2, fid, label FROM fl), w2 AS (SELECT vid, arg_max(label, (k, fid)) AS label FROM o GROUP BY 1) SELECT vid, p.r, p.g, p.b FROM w2 JOIN (VALUES {', '.join(str((k, *c)) for k, c in enumerate(COLORS))}) AS p(index, r, g, b) ON index = label"),
    "closed_mask": sql("px", f""", {PX_FULL}, {FOOTPRINT}, d AS (SELECT di, dj FROM (SELECT unnest(range(-3, 4)) AS di), (SELECT unnest(range(-3, 4)) AS dj) WHERE di * di + dj * dj <= 9),
        grown AS MATERIALIZED (SELECT DISTINCT i + di AS i, j + dj AS j FROM fp, d WHERE inside)
        SELECT CAST(g.i AS INT) AS i, CAST(g.j AS INT) AS j FROM grown g, d JOIN grown n ON n.i = g.i + di AND n.j = g.j + dj GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM d)"""),
    "coordinate_text": f"SELECT p_partkey, {G10.format('p_retailprice / 7')} AS text FROM part",
}
