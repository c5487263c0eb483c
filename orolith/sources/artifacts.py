"""Files of a job: settings in JSON, arrays, and meshes in 3MF."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "job_id string, kml_filename string, export_basename string, epsg int, bounds_utm array<double>, bbox4326 array<double>, grid_width int, grid_height int, buffer_m double, boundary_smooth_m double, vertical_exaggeration double, pond_sensitivity string, ams_n_colors int, ams_quality string, imagery string, transform array<double>, elevation_min_m double, elevation_max_m double, exports struct<requested: map<string, boolean>, built: map<string, boolean>>"


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Job settings, a row a file; fields that a file lacks are null."""
    return spark.read.schema(META).option("multiLine", "true").json(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, z) of two-dimensional .npy files; a file is a raster and is read by one task."""

    def run(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                z = np.load(io.BytesIO(content))
                for top in range(0, len(z), 256):
                    part = z[top : top + 256]
                    i, j = np.indices(part.shape)
                    yield pd.DataFrame({"file": name, "i": (i.ravel() + top).astype("int32"), "j": j.ravel().astype("int32"), "z": part.ravel().astype("float64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, i int, j int, z double")


def read_3mf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of 3MF files: (file, vid, x, y, z) and (file, fid, v0, v1, v2, textured),
    the parts of a file numbered on from one another."""

    def models(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in sorted(n for n in z.namelist() if n.endswith(".model")):
                        yield pd.DataFrame({"file": [name], "entry": [entry], "xml": [z.read(entry).decode()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(models, "file string, entry string, xml string")
    meshes = files.select("file", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<mesh>.*?</mesh>"), F.lit(0))).alias("part", "mesh"))
    number = lambda tag, a: F.regexp_extract(tag, rf'\b{a}="([^"]*)"', 1)
    v = meshes.select("file", "part", F.posexplode(F.regexp_extract_all("mesh", F.lit(r"<vertex\b[^>]*>"), F.lit(0))).alias("k", "tag"))
    sizes = meshes.select("file", "part", F.size(F.regexp_extract_all("mesh", F.lit(r"<vertex\b"), F.lit(0))).alias("n"))
    before = sizes.alias("s").join(sizes.alias("t"), (F.col("s.file") == F.col("t.file")) & (F.col("t.part") < F.col("s.part")), "left").groupBy("s.file", "s.part").agg(F.coalesce(F.sum("t.n"), F.lit(0)).alias("base"))
    vertices = v.join(before, ["file", "part"]).select("file", (F.col("base") + F.col("k")).alias("vid"), *[number("tag", c).cast("double").alias(c) for c in "xyz"])
    t = meshes.select("file", "part", F.posexplode(F.regexp_extract_all("mesh", F.lit(r"<triangle\b[^>]*>"), F.lit(0))).alias("k", "tag"))
    fid = (F.col("part").cast("long") * (1 << 32) + F.col("k")).alias("fid")
    faces = t.join(before, ["file", "part"]).select("file", fid, *[(number("tag", f"v{k + 1}").cast("long") + F.col("base")).alias(f"v{k}") for k in range(3)], F.col("tag").rlike(r'\bp1="').alias("textured"))
    return vertices, faces
