"""The two jobs of this library over many sites at once: from boundaries and rasters to a print, and
from a print and pond shapes to a colour package. Every table is keyed by job_id."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orolith.functions import geo, names
from orolith.operators import arrangement, collapse, cutting, jobs, mesh, palette, ponds, proximity, raster, shapes, winding
from orolith.sinks import files, meshes
from orolith.sources import boundaries, imagery, rasters
from orolith.storage import sized, stored


@dataclass(frozen=True)
class Options:
    """What a run asks for; numbers out of range are moved into it."""

    grid_size: int = 512
    buffer_m: float = 50.0
    exaggeration: float = 3.0
    offset: str = "min"
    print_mm: float = 200.0
    split_x: int = 1
    split_y: int = 1
    center: bool = True
    voxel_mm: float | None = None
    smooth_m: float | None = None
    sensitivity: str = "conservative"
    n_colors: int = 4
    quality: str = "medium"
    repair: bool = False  # clean the solid, fill its holes and turn its faces outwards

    def checked(self) -> Options:
        return Options(
            grid_size=max(64, min(2048, self.grid_size)), buffer_m=max(0.0, self.buffer_m), exaggeration=max(0.01, self.exaggeration), offset="mean" if self.offset == "mean" else "min",
            print_mm=max(1e-3, self.print_mm), split_x=max(1, self.split_x), split_y=max(1, self.split_y), center=self.center, voxel_mm=self.voxel_mm, smooth_m=self.smooth_m,
            sensitivity=self.sensitivity.strip().lower() if self.sensitivity.strip().lower() in ponds.PRESETS else "conservative",
            n_colors=max(2, min(palette.MOST_COLORS, self.n_colors)), quality=self.quality if self.quality in mesh.FACE_TARGETS else "medium", repair=self.repair,
        )


@dataclass(frozen=True)
class Site:
    """The tables of processed jobs."""

    grid: DataFrame  # job_id, epsg, west .. north, width, height, dx, dy
    cells: DataFrame  # job_id, i, j, x, y, z, r, g, b, a
    surface: tuple[DataFrame, DataFrame]  # vertices and faces in metres
    solid: tuple[DataFrame, DataFrame]  # vertices and faces in millimetres
    print_surface: DataFrame  # the surface's vertices in millimetres
    ponds: DataFrame  # proposed shapes
    meta: DataFrame  # a row a job


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        """folder: where files go; all executors must share it."""
        self.spark, self.folder = spark, folder.rstrip("/")

    def frames(self, rings: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
        """(rings in metres, grids) of boundaries (job_id, ring) in degrees."""
        o = (options or Options()).checked()
        flat = stored(boundaries.projected(rings), "rings")
        return flat, stored(boundaries.grids(flat, o.buffer_m, o.grid_size), "grids")

    def process(self, rings: DataFrame, elevation: DataFrame, pixels: DataFrame, options: Options | None = None) -> Site:
        """Boundaries, elevation (job_id, i, j, z) and imagery (job_id, i, j, r, g, b), both already
        on the boundaries' grids, as surfaces, solids, pond proposals and facts."""
        o = (options or Options()).checked()
        flat, grid = self.frames(rings, o)
        smooth = shapes.smooth_radius(*[F.col(c) for c in ("west", "south", "east", "north", "width", "height")]) if o.smooth_m is None else F.lit(float(o.smooth_m))
        edge = flat.select("job_id", "ring")
        if o.smooth_m is None or o.smooth_m > 0:
            edge = stored(arrangement.smoothed(edge, grid.select("job_id", smooth.alias("radius"))), "smoothed-rings")
        at = boundaries.grid_cells(grid)
        z = elevation.select("job_id", "i", "j", F.col("z").cast("double").alias("z"))
        rgb = pixels.select("job_id", "i", "j", "r", "g", "b")
        cells = at.join(z, ["job_id", "i", "j"], "left").join(rgb, ["job_id", "i", "j"], "left").join(sized(grid.select("job_id", "dx", "dy")), "job_id")
        cells = cells.withColumns({c: F.coalesce(c, F.lit(0)) for c in "rgb"})
        clip = shapes.touched(cells, edge).select("job_id", "i", "j", F.lit(255).alias("alpha"))
        cells = stored(cells.join(clip, ["job_id", "i", "j"], "left").withColumn("a", F.coalesce("alpha", F.lit(0))).drop("alpha"), "cells")
        soft = cells
        if o.smooth_m is None or o.smooth_m > 0:
            sigma = grid.select("job_id", F.greatest(F.lit(0.75), smooth / F.greatest(F.lit(1e-9), F.col("dx"), F.col("dy"))).alias("sigma"))
            blurred = shapes.soft_alpha(cells.select("job_id", "i", "j", F.col("a").alias("alpha")), sigma)
            soft = stored(cells.drop("a").join(blurred.withColumnRenamed("alpha", "a"), ["job_id", "i", "j"]), "soft-cells")
        heights = raster.prepare_z(cells, o.exaggeration, o.offset)
        lifted = cells.drop("z").join(heights.withColumn("z", F.col("z").cast("double")), ["job_id", "i", "j"])
        v, f = shapes.clipped_mesh(lifted.select("job_id", "i", "j", "x", "y", "z"), edge)
        v = stored(v, "surface-vertices")
        solid_v, solid_f, print_v, facts = mesh.print_solid(v, f, o.print_mm, o.split_x, o.split_y, o.center, o.voxel_mm, fuse=True)
        if o.repair:
            solid_v, solid_f = winding.repaired(solid_v, solid_f)
        wet = ponds.detect(soft.select("job_id", "i", "j", "r", "g", "b", "a", "z"), o.sensitivity)
        proposed = stored(shapes.outlines(wet), "pond-shapes")
        stats = raster.elevation_stats(cells)
        span = mesh.bounds(v).select("job_id", (F.col("max_z") - F.col("min_z")).alias("mesh_vertex_z_span_m"))
        n_ponds = proposed.groupBy("job_id").agg(F.count("*").alias("n_pond_shapes"))
        meta = grid.join(stats, "job_id", "left").join(span, "job_id", "left").join(facts.drop("epsg"), "job_id", "left").join(n_ponds, "job_id", "left")
        return Site(grid, soft, (v, f), (solid_v, stored(solid_f, "solid-faces")), print_v, proposed, stored(meta, "meta"))

    def build_ams(self, site: Site, drawn: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(palette, labelled cells, labelled faces) of jobs whose pond shapes (job_id, ord, id,
        source, ring) were reviewed. Faces are those of the solid, made coarser to the quality."""
        o = (options or Options()).checked()
        sizes = site.cells.groupBy("job_id").agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"))
        foot = site.cells.where(palette.inside(site.cells))
        wet = stored(shapes.polygon_mask(drawn, sizes, foot), "ponds")
        colors = stored(palette.recommend(site.cells, o.n_colors, True, wet, True), "colors")
        flagged = site.cells.join(wet.withColumn("wet", F.lit(True)), ["job_id", "i", "j"], "left").withColumn("wet", F.coalesce("wet", F.lit(False)))
        pond = colors.where("role = 'pond'").select("job_id", F.col("index").alias("__pond"))
        labelled = palette.quantize(flagged, colors.select("job_id", "index", "r", "g", "b"), 0)
        forced = F.col("wet") & F.col("__pond").isNotNull() & palette.inside(site.cells)
        labelled = labelled.join(sized(pond), "job_id", "left").withColumn("label", F.when(forced, F.col("__pond")).otherwise(F.col("label"))).drop("__pond", "wet")
        labelled = stored(labelled, "labels")
        v, f = collapse.decimate(*site.solid, mesh.FACE_TARGETS[o.quality])
        v, f = stored(v, "print-vertices"), stored(f, "print-faces")
        top = (site.print_surface, site.surface[1])
        uv = proximity.closest(v.select("job_id", F.col("vid").alias("pid"), "x", "y", "z"), *top, ["u", "v"])
        textured = v.drop("u", "v").join(uv.select("job_id", F.col("pid").alias("vid"), "u", "v"), ["job_id", "vid"])
        faces = mesh.label_faces(proximity.top_faces(f, v, top, o.voxel_mm), textured, labelled, 0).drop("is_top")
        counts = faces.groupBy("job_id", F.col("label").alias("index")).agg(F.count("*").alias("triangle_count"))
        colors = colors.join(counts, ["job_id", "index"], "left").withColumn("triangle_count", F.coalesce("triangle_count", F.lit(0).cast("long")))
        return stored(colors, "palette"), labelled, stored(faces, "labelled-faces")

    def export(self, site: Site, flags: dict[str, bool] | None = None, options: Options | None = None, prefix: str = "terrain") -> DataFrame:
        """(job_id, file, size) of the files asked for by export flags (names.EXPORT_FLAGS)."""
        on = {**names.EXPORT_FLAGS, **(flags or {})}
        o = (options or Options()).checked()
        surface = mesh.numbered(*site.surface)
        solid = mesh.numbered(*site.solid)
        wanted: list[DataFrame] = []
        if on["preview_glb"]:
            wanted += [meshes.glb(*surface, "preview.glb", textured=True, center=True), files.image_pieces(site.cells, "texture.png")]
        if on["preview_obj"]:
            wanted.append(meshes.obj_textured(*surface, site.cells))
        if on["print_stl"]:
            wanted.append(meshes.stl(*solid))
        if on["print_3mf"]:
            wanted.append(meshes.threemf(*solid))
        if on["print_textured_glb"]:
            wanted += [meshes.glb(*solid, "print_textured.glb", textured=True), files.image_pieces(site.cells, "texture.png")]
        if on["print_pieces"]:
            wanted.append(meshes.stl_pieces(*self.pieces(site, o), prefix))
        if on["quad_mask"]:
            wanted.append(self.quad_mask_pieces(site))
        out = wanted[0] if wanted else self.spark.createDataFrame([], files.PIECE)
        for more in wanted[1:]:
            out = out.unionByName(more)
        return stored(files.save(out.dropDuplicates(["job_id", "file", "entry", "section", "n"]), self.folder), "saved")

    def pieces(self, site: Site, o: Options) -> tuple[DataFrame, DataFrame]:
        """(vertices, faces) of the solid's tiles: cut at straight lines, each closed by caps."""
        v, f = (stored(df, "solid") for df in site.solid)
        return mesh.numbered(*cutting.tiles(v, f, o.split_x, o.split_y), ["job_id", "tile", "ix", "iy"])

    def quad_mask_pieces(self, site: Site) -> DataFrame:
        """One byte a quad in reading order, 1 if the surface has it."""
        kept = mesh.corner_flags(site.cells, F.col("a") >= palette.OPAQUE)
        rows = kept.groupBy("job_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", F.when(F.col("kept"), "01").otherwise("00").alias("p")))).alias("l"))
        return rows.select("job_id", F.lit("quad_mask.bin").alias("file"), F.lit(None).cast("string").alias("entry"), F.lit(1).alias("section"), F.col("i").cast("long").alias("n"), F.unhex(F.concat_ws("", F.transform("l", lambda x: x["p"]))).alias("payload"))

    def export_ams(self, site: Site, colors: DataFrame, labelled: DataFrame, faces: DataFrame, vertices: DataFrame, flags: dict[str, bool] | None = None) -> DataFrame:
        """(job_id, file, size) of a colour package: with `print_ams` an OBJ archive and a coloured 3MF, with
        `print_ams_glb` a coloured GLB, and the preview with either; all of them without flags."""
        on = {"print_ams": True, "print_ams_glb": True} if flags is None else flags
        v, f = mesh.numbered(vertices, faces)
        wanted: list[DataFrame] = []
        if on.get("print_ams"):
            wanted += [meshes.obj_colored(v, f, colors), meshes.threemf_colored(v, f, colors)]
        if on.get("print_ams_glb"):
            wanted.append(meshes.glb(v, f, "print_ams.glb", mesh.vertex_colors(f, colors)))
        if not wanted:
            return self.spark.createDataFrame([], "job_id string, file string, size long")
        wanted.append(files.image_pieces(palette.preview(labelled, colors), "ams_preview.png"))
        return stored(files.save(reduce(DataFrame.unionByName, wanted), self.folder), "saved")

    def save_json(self, rows: DataFrame, file: str) -> DataFrame:
        """(job_id, file, size): each job's row as a JSON file of its folder; a file is replaced as a whole."""
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
        pieces = rows.select("job_id", F.lit(file).alias("file"), F.lit(None).cast("string").alias("entry"), F.lit(1).alias("section"), F.lit(0).cast("long").alias("n"), text.cast("binary").alias("payload"))
        return stored(files.save(pieces, self.folder), "saved")

    def save_meta(self, site: Site, options: Options | None = None) -> DataFrame:
        """meta.json of each job: its grid, settings and facts, as artifacts.read_meta reads them."""
        o = (options or Options()).checked()
        corner = lambda x, y: geo.lonlat(F.col(x), F.col(y), F.col("epsg"))
        low, high = corner("west", "south"), corner("east", "north")
        smooth = shapes.smooth_radius(*[F.col(c) for c in ("west", "south", "east", "north", "width", "height")]) if o.smooth_m is None else F.lit(float(o.smooth_m))
        known = {
            "bounds_utm": F.array("west", "south", "east", "north"), "bbox4326": F.array(low["x"], low["y"], high["x"], high["y"]), "grid_width": F.col("width"), "grid_height": F.col("height"),
            "buffer_m": F.lit(o.buffer_m), "boundary_smooth_m": smooth, "vertical_exaggeration": F.lit(o.exaggeration), "pond_sensitivity": F.lit(o.sensitivity), "ams_n_colors": F.lit(o.n_colors),
            "ams_quality": F.lit(o.quality), "transform": F.array(F.col("dx"), F.lit(0.0), F.col("west"), F.lit(0.0), -F.col("dy"), F.col("north")),
        }
        return self.save_json(site.meta.withColumns(known), "meta.json")

    def report(self, snapshots: DataFrame) -> DataFrame:
        """progress.json of each job from snapshots (job_id, event_id, status, percent, updated_at, ...): the last one."""
        return self.save_json(jobs.latest(snapshots), "progress.json")

    def save_print(self, site: Site, path: str) -> None:
        """Keep the prints of all jobs as tables, for load_print."""
        for name, df in zip(("vertices", "faces", "surface"), (*site.solid, site.print_surface), strict=True):
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    def load_print(self, path: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(vertices, faces, surface vertices) of kept prints, of the job_ids of `wanted` alone if given."""
        out = [self.spark.read.parquet(f"{path}/{name}") for name in ("vertices", "faces", "surface")]
        return tuple(df if wanted is None else df.join(sized(wanted.select("job_id").distinct()), "job_id", "left_semi") for df in out)

    def remove(self, job_ids: DataFrame) -> DataFrame:
        """(job_id): remove the folders of these jobs, by tasks; those that had one are listed."""
        folder = self.folder

        def run(frames):
            for f in frames:
                gone = [j for j in f["job_id"] if j and "/" not in j and j not in (".", "..") and os.path.isdir(f"{folder}/{j}")]
                for j in gone:
                    shutil.rmtree(f"{folder}/{j}")
                yield pd.DataFrame({"job_id": gone}, dtype=str)

        return stored(job_ids.select("job_id").distinct().mapInPandas(run, "job_id string"), "removed")

    def sweep(self, snapshots: DataFrame, now: Column, settings: jobs.Lifecycle | None = None, active: DataFrame | None = None) -> DataFrame:
        """Remove the folders of expired jobs; snapshots as for report."""
        last = jobs.latest(snapshots).withColumn("seen", F.col("updated_at"))
        return self.remove(jobs.expired(last, now, settings or jobs.Lifecycle.of(self.spark), active))

    def stored_elevation(self, path: str, grid: DataFrame, source: str = "dem") -> DataFrame:
        """Elevation from a store of rasters in degrees (rasters.read_rasters) on the grids' cells: only
        the blocks around each grid are read, at the level that its size needs."""
        low, high = geo.lonlat(F.col("west"), F.col("south"), F.col("epsg")), geo.lonlat(F.col("east"), F.col("north"), F.col("epsg"))
        left, right = geo.lonlat(F.col("west"), F.col("north"), F.col("epsg")), geo.lonlat(F.col("east"), F.col("south"), F.col("epsg"))
        corners = {"west": F.least(low["x"], left["x"]), "south": F.least(low["y"], right["y"]), "east": F.greatest(high["x"], right["x"]), "north": F.greatest(high["y"], left["y"])}
        boxes = grid.select("job_id", F.lit(source).alias("source"), *[c.alias(n) for n, c in corners.items()])
        most = grid.agg(F.max(F.greatest("width", "height"))).first()[0]
        cells, where = rasters.read_rasters(self.spark, path, boxes, most)
        return self.elevation_on_grid(cells, where.drop("level"), grid)

    def stored_imagery(self, root: str | list[str], grid: DataFrame, most: int = 400) -> DataFrame:
        """Imagery from a store of web tiles on the grids' cells: cover, read, mosaic and warp. Only the tiles that
        cover a grid are opened. Of several stores the first is taken that shows a job anything but black."""
        low, high = geo.lonlat(F.col("west"), F.col("south"), F.col("epsg")), geo.lonlat(F.col("east"), F.col("north"), F.col("epsg"))
        boxes = grid.select("job_id", low["x"].alias("west"), low["y"].alias("south"), high["x"].alias("east"), high["y"].alias("north"))
        tiles = imagery.cover(boxes, most)
        found = stored(imagery.first_shown(tiles, [root] if isinstance(root, str) else root), "tiles")
        size = F.lit(2 * geo.MERCATOR_EDGE / imagery.SIDE) / F.pow(F.lit(2.0), F.col("z"))
        step = found.groupBy("job_id").agg(F.first("z").alias("z")).select("job_id", size.alias("dx"), size.alias("dy"))
        where = imagery.mercator_bounds(found.withColumns({"x": F.col("x"), "y": F.col("y")})).join(step, "job_id").select("job_id", "west", "north", "dx", "dy")
        return self.imagery_on_grid(imagery.mosaic(found).drop("z"), where, grid)

    def elevation_on_grid(self, source: DataFrame, where: DataFrame, grid: DataFrame) -> DataFrame:
        """Elevation over degrees (where: job_id, west, north, dx, dy) on the grids' cells."""
        return imagery.warp(source, where, self.cells_of(grid), ["z"], geo.lonlat, float("nan"))

    def imagery_on_grid(self, source: DataFrame, where: DataFrame, grid: DataFrame) -> DataFrame:
        """Pixels over Mercator metres (where as above) on the grids' cells, as the nearest whole numbers."""
        def place(x, y, epsg):
            return geo.let(geo.lonlat(x, y, epsg), lambda at: imagery.mercator(at["x"], at["y"]))

        warped = imagery.warp(source, where, self.cells_of(grid), ["r", "g", "b"], place)
        return warped.select("job_id", "i", "j", *[F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int").alias(c) for c in "rgb"])

    @staticmethod
    def cells_of(grid: DataFrame) -> DataFrame:
        return boundaries.grid_cells(grid).join(sized(grid.select("job_id", "epsg")), "job_id")
