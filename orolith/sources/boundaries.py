"""Boundary files (KML) as tables of rings, and rings as grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orolith.functions import geo
from orolith.operators import arrangement
from orolith.operators.raster import JOB
from orolith.storage import stored

POLYGON = r"(?s)<(?:\w+:)?Polygon\b.*?</(?:\w+:)?Polygon\s*>"
OUTER = r"(?s)<(?:\w+:)?outerBoundaryIs\b.*?<(?:\w+:)?coordinates[^>]*>(.*?)</(?:\w+:)?coordinates\s*>"


def ring_of(text: Column) -> Column:
    """An array of (x, y) from "lon,lat[,alt]" tokens: altitudes and short tokens are left out, and
    so is a repeated last corner."""
    tokens = F.transform(F.filter(F.split(text, r"\s+"), lambda t: F.size(F.split(t, ",")) >= 2), lambda t: F.split(t, ","))
    points = F.transform(tokens, lambda p: F.struct(p[0].try_cast("double").alias("x"), p[1].try_cast("double").alias("y")))
    points = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    closed = lambda p: (F.size(p) > 1) & (F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1))
    return geo.let(points, lambda p: F.when(closed(p), F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def rings(files: DataFrame, text: str = "text") -> DataFrame:
    """files with a row for each polygon in them: part (from 0) and its outer ring, of three corners
    at least. Holes are left out; the placemark's name is not needed to find polygons."""
    # rings come out of the explode itself: a ring that filters and areas name is parsed anew at every mention
    parsed = F.transform(F.regexp_extract_all(F.col(text), F.lit(POLYGON), F.lit(0)), lambda xml: ring_of(F.regexp_extract(xml, OUTER, 1)))
    kept = [F.col(f"`{c}`") for c in files.columns if c != text]
    return files.select(*kept, F.posexplode(parsed).alias("part", "ring")).where(F.size("ring") >= 3)


def boundaries(files: DataFrame, by: list[str] = JOB, text: str = "text") -> DataFrame:
    """(job_id, ring, area): of each file the largest part of the union of its rings, of equal ones the first. Rings that
    touch or overlap become one and rings that cross themselves are repaired; corners stand where they stood, and a file of one good ring keeps it as it is."""
    found = stored(rings(files.select(*by, text), text).where(F.abs(geo.ring_area(F.col("ring"))) > 0), "file-rings")
    whole = stored(arrangement.united(found, by), "united")
    best = arrangement.largest(whole, by).select(*by, F.col("ring").alias("__ring"), F.col("area").alias("__area"))
    own = found.groupBy(by).agg(F.count("*").alias("n"), F.first("ring").alias("ring")).join(whole.groupBy(by).agg(F.count("*").alias("parts")), by)
    area = F.abs(geo.ring_area(F.col("ring")))
    good = (F.col("n") == 1) & (F.col("parts") == 1) & (F.abs(area - F.col("__area")) <= F.lit(1e-7) * area)
    return own.join(best, by).select(*by, F.when(good, F.col("ring")).otherwise(F.col("__ring")).alias("ring"), F.when(good, area).otherwise(F.col("__area")).alias("area"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, file, ring, area) of the KML files at a path; the job is named by the file's stem."""
    from orolith.functions.names import export_basename

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))
    return boundaries(files.withColumn("job_id", export_basename(F.col("file"))), ["job_id", "file"])


def projected(rings_of: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, epsg, ring) with rings in metres, in the UTM zone of their centroid."""
    mid = geo.ring_centroid(F.col("ring"))
    out = rings_of.withColumn("epsg", geo.utm_epsg(mid["x"], mid["y"]))
    return out.withColumn("ring", F.transform("ring", lambda p: geo.utm(p["x"], p["y"], F.col("epsg")))).select(*by, "epsg", "ring")


def grids(rings_in_metres: DataFrame, buffer_m: float = 50.0, most: int = 512, by: list[str] = JOB) -> DataFrame:
    """(job_id, epsg, west, south, east, north, width, height, dx, dy): the raster around a ring."""
    side = lambda axis, f: f(F.transform("ring", lambda p: p[axis]))
    box = {"west": side("x", F.array_min) - buffer_m, "south": side("y", F.array_min) - buffer_m, "east": side("x", F.array_max) + buffer_m, "north": side("y", F.array_max) + buffer_m}
    out = rings_in_metres.select(*by, "epsg", *[c.alias(n) for n, c in box.items()])
    size = geo.grid_size(*[F.col(c) for c in box], F.lit(most))
    out = out.withColumn("__s", size).select(*by, "epsg", *box, "__s.width", "__s.height")
    return out.withColumns({"dx": (F.col("east") - F.col("west")) / F.col("width"), "dy": (F.col("north") - F.col("south")) / F.col("height")})


def grid_cells(grid: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, x, y): the centres of a grid's cells."""
    rows = grid.select(*by, "west", "north", "dx", "dy", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("i"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("j"))
    centre = geo.cell_centre(F.col("i"), F.col("j"), F.col("west"), F.col("north"), F.col("dx"), F.col("dy"))
    return cells.select(*by, "i", "j", centre.alias("c")).select(*by, "i", "j", "c.x", "c.y")


def geojson(ring: Column) -> Column:
    """The ring as a GeoJSON polygon, closed."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(points, F.slice(points, 1, 1))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")))
