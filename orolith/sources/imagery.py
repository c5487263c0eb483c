"""Elevation and imagery: web tiles as a Spark data source, mosaics, warps and catalogue entries.

Tiles and rasters come from files in a store that all executors read, in the layout of web tiles
(zoom/x/y); a fetcher that fills such a store from a network service lies outside this package.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orolith.functions import geo
from orolith.operators import raster
from orolith.operators.raster import JOB
from orolith.storage import sized, stored

#: A tile's side in pixels, and the address patterns by provider.
SIDE = 256
TEMPLATES = {"esri": "{z}/{y}/{x}", "osm": "{z}/{x}/{y}.png", "oam": "{z}/{x}/{y}.png"}
#: Fixed value: the resolution of a catalogue entry that names none.
NO_GSD = 999.0
ITEM = "uuid string, gsd string, geojson string, properties struct<tms: string, resolution_in_meters: string, resolution: array<string>>"


def cover(boxes: DataFrame, most: int = 400, by: list[str] = JOB) -> DataFrame:
    """(job_id, z, x, y): the web tiles over each box (west, south, east, north in degrees), at the
    largest zoom that needs no more than `most` of them."""
    box = [F.col(c) for c in ("west", "south", "east", "north")]
    out = boxes.withColumn("z", geo.pick_zoom(*box, most))
    xs = F.sequence(geo.tile_x(F.col("west"), F.col("z")), geo.tile_x(F.col("east"), F.col("z")))
    ys = F.sequence(geo.tile_y(F.col("north"), F.col("z")), geo.tile_y(F.col("south"), F.col("z")))
    return out.select(*by, "z", F.explode(xs).alias("x"), ys.alias("ys")).select(*by, "z", "x", F.explode("ys").alias("y"))


def addresses(tiles: DataFrame, provider: str = "esri", root: str = "") -> DataFrame:
    """tiles with the address of each; the provider `oam` counts rows from the south."""
    y = geo.tms_row(F.col("z"), F.col("y")) if provider == "oam" else F.col("y")
    return tiles.withColumn("url", geo.tile_url(root + TEMPLATES[provider], F.col("z"), F.col("x"), y))


#: A PNG's first bytes, and channels by its colour type (grey, RGB, palette, grey and alpha, RGBA).
PNG, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """The bytes of a PNG's scan lines (each led by its filter's number), pixels being `step` bytes."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1 + step), np.uint8)  # with a line and a pixel of zeros before
    for y, line in enumerate(lines, 1):
        kind, raw, up, now = int(line[0]), line[1:], out[y - 1], out[y]
        if kind in (0, 2):
            now[step:] = raw if kind == 0 else raw + up[step:]
        elif kind == 1:
            now[step:] = np.cumsum(raw.reshape(-1, step), 0, dtype=np.uint8).ravel()
        else:
            left, above = [0] * step, up.astype(int).tolist()
            for x, v in enumerate(raw.tolist()):
                a, b, c = left[x], above[x + step], above[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                left.append((v + guess) & 255)
            now[:] = left
    return out[1:, step:]


def png_pixels(data: bytes) -> np.ndarray | None:
    """(height, width, 3) of a PNG of eight bits a channel without interlacing; None of anything else."""
    if data[:8] != PNG or len(data) < 33:
        return None
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or interlaced or kind not in CHANNELS:
        return None
    at, packed, swatches = 8, [], None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body, at = data[at + 8 : at + 8 + size], at + 12 + size
        if name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            swatches = np.frombuffer(body, np.uint8).reshape(-1, 3)
    n = CHANNELS[kind]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    except (zlib.error, ValueError):
        return None
    px = unfiltered(lines, n).reshape(height, width, n)
    if kind == 3:
        return None if swatches is None else swatches[np.minimum(px[:, :, 0], len(swatches) - 1)]
    return px[:, :, :3] if n > 2 else np.repeat(px[:, :, :1], 3, axis=2)


def tile_pixels(content: bytes) -> bytes | None:
    """The 256 x 256 pixels of a tile file, three bytes each; None of a file of another size or kind."""
    if len(content) == SIDE * SIDE * 3:
        return content
    found = png_pixels(content)
    return found.tobytes() if found is not None and found.shape[:2] == (SIDE, SIDE) else None


def read_tiles(spark: SparkSession, root: str) -> DataFrame:
    """(z, x, y, rgb) of all tile files root/z/x/y.rgb (256 x 256 pixels of three bytes) and root/z/x/y.png.
    A file of another size or that can't be read is left out. JPEG files need to be turned into one of these."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{rgb,png}").load(root)
    part = lambda k: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.(?:rgb|png)$", k).try_cast("long")
    named = files.select(part(1).cast("int").alias("z"), part(2).alias("x"), part(3).alias("y"), "content")

    def pixels(frames):
        for f in frames:
            yield f[["z", "x", "y"]].assign(rgb=[tile_pixels(c) for c in f["content"]])

    return named.mapInPandas(pixels, "z int, x long, y long, rgb binary").where("rgb IS NOT NULL")


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there: a plain path, or an address with a scheme."""
    if "://" not in root:
        return fs.LocalFileSystem(), root.removeprefix("file:").rstrip("/")
    store, path = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
    return store, path.rstrip("/")


#: Tiles that a task holds at a time.
HELD = 32


def wanted_tiles(wanted: DataFrame, root: str) -> DataFrame:
    """(z, x, y, rgb) of those of the wanted tiles (z, x, y) that the store has; no other file is opened
    or listed. Tasks open root/z/x/y.rgb, and root/z/x/y.png where there is none or it can't be used; a
    tile wanted by several jobs is read once, one with a null number never. An error of the store other than
    a file that isn't there fails the task."""
    keys = wanted.select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    keys = keys.where("z IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").distinct()

    def read(frames):
        store, base = file_system(root)

        def pixels(z, x, y):
            for kind in ("rgb", "png"):
                try:
                    with store.open_input_stream(f"{base}/{z}/{x}/{y}.{kind}") as file:
                        found = tile_pixels(file.read())
                except FileNotFoundError:
                    continue
                if found is not None:
                    return found
            return None

        for f in frames:
            for at in range(0, len(f), HELD):
                some = f.iloc[at : at + HELD]
                out = some.assign(rgb=[pixels(*t) for t in some.itertuples(index=False)])
                yield out[out["rgb"].notna()]

    return keys.mapInPandas(read, "z int, x long, y long, rgb binary")


def first_shown(wanted: DataFrame, roots: list[str]) -> DataFrame:
    """(job_id, z, x, y, rgb, source): each job's tiles from the first of the stores in which any of its
    pixels isn't black; source is the store's place in the list. A store is asked only for jobs that
    none before it could show; jobs that none can show have no row."""
    left, out = stored(wanted.select("job_id", "z", "x", "y").distinct(), "wanted-tiles"), None
    lit = F.length(F.ltrim(F.hex("rgb"), F.lit("0"))) > 0
    for n, root in enumerate(roots):
        got = wanted_tiles(left, root).withColumn("lit", lit)
        got = stored(left.join(got, ["z", "x", "y"]).withColumn("source", F.lit(n)), "store-tiles")
        shown = got.where("lit").select("job_id").distinct()
        kept = got.join(sized(shown), "job_id", "left_semi").select("job_id", "z", "x", "y", "rgb", "source")
        out = kept if out is None else out.unionByName(kept)
        left = stored(left.join(sized(shown), "job_id", "left_anti"), "wanted-tiles")
        if n + 1 < len(roots) and left.isEmpty():
            break
    return out


def pixels_of(frames):
    k = np.arange(SIDE * SIDE)
    for f in frames:
        for t in f.itertuples(index=False):
            px = np.frombuffer(t.rgb, np.uint8).reshape(-1, 3)
            yield pd.DataFrame({"job_id": t.job_id, "z": t.z, "i": t.top + k // SIDE, "j": t.left + k % SIDE, "r": px[:, 0].astype("int32"), "g": px[:, 1].astype("int32"), "b": px[:, 2].astype("int32")})


def mosaic(tiles: DataFrame) -> DataFrame:
    """(job_id, z, i, j, r, g, b): the pixels of each job's tiles (job_id, z, x, y, rgb) on one
    canvas whose first pixel is that of its most north-western tile."""
    first = tiles.groupBy("job_id", "z").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    placed = tiles.join(sized(first), ["job_id", "z"])
    at = placed.select("job_id", F.col("z").cast("int").alias("z"), ((F.col("y") - F.col("y0")) * SIDE).cast("int").alias("top"), ((F.col("x") - F.col("x0")) * SIDE).cast("int").alias("left"), "rgb")
    return at.mapInPandas(pixels_of, "job_id string, z int, i int, j int, r int, g int, b int")


def mercator_bounds(tiles: DataFrame) -> DataFrame:
    """(job_id, west, south, east, north) of a mosaic, in Mercator metres."""
    size = F.lit(2 * geo.MERCATOR_EDGE) / F.pow(F.lit(2.0), F.col("z"))
    edge = {"west": F.min(F.col("x") * size), "east": F.max((F.col("x") + 1) * size), "south": F.max((F.col("y") + 1) * size), "north": F.min(F.col("y") * size)}
    out = tiles.groupBy("job_id").agg(*[c.alias(n) for n, c in edge.items()])
    half = F.lit(geo.MERCATOR_EDGE)
    return out.select("job_id", (F.col("west") - half).alias("west"), (half - F.col("south")).alias("south"), (F.col("east") - half).alias("east"), (half - F.col("north")).alias("north"))


def mercator(lon: Column, lat: Column) -> Column:
    """Struct (x, y) in Mercator metres."""
    s = F.sin(F.radians(lat))
    edge = F.lit(geo.MERCATOR_EDGE)
    return F.struct((lon / F.lit(180.0) * edge).alias("x"), (edge / F.lit(3.141592653589793) * F.lit(0.5) * F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s))).alias("y"))


def warp(source: DataFrame, where: DataFrame, grid: DataFrame, bands: list[str], place, nodata: float = 0.0, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, *bands): a source raster (job_id, i, j, bands) on the cells of another grid.

    where has a row a job: west, north, dx, dy of the source. place turns a target cell's x, y and
    epsg into the source's coordinates. Values are bilinear; a band's missing neighbours don't count.
    """
    spot = place(F.col("x"), F.col("y"), F.col("epsg"))
    at = grid.join(sized(where), by).withColumn("__p", spot)
    targets = at.select(*by, "i", "j", ((F.col("north") - F.col("__p.y")) / F.col("dy") - 0.5).alias("si"), ((F.col("__p.x") - F.col("west")) / F.col("dx") - 0.5).alias("sj"))
    top, left = F.floor("si").cast("int"), F.floor("sj").cast("int")
    corner = lambda a, b: F.struct((top + a).alias("ci"), (left + b).alias("cj"), ((F.col("si") - top if a else 1 - (F.col("si") - top)) * (F.col("sj") - left if b else 1 - (F.col("sj") - left))).alias("w"))
    four = targets.select(*by, "i", "j", F.inline(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])))
    near = source.select(*by, F.col("i").alias("ci"), F.col("j").alias("cj"), *[raster.finite(F.col(b).cast("double")).alias(b) for b in bands])
    met = four.join(near, [*by, "ci", "cj"], "left")

    def value(b):
        weight = F.sum(F.when(F.col(b).isNotNull(), F.col("w")))
        return F.when(weight > 1e-12, F.sum(F.col(b) * F.col("w")) / weight).otherwise(F.lit(nodata)).alias(b)

    return met.groupBy(*by, "i", "j").agg(*[value(b) for b in bands])


def to_bytes(cells: DataFrame, bands: list[str], by: list[str] = JOB) -> DataFrame:
    """Bands of any range as 0..255: values up to 1.5 count as shares, larger ones than 255.5 are
    scaled by the largest of the job; missing ones are 0."""
    clear = [F.coalesce(raster.finite(F.col(b).cast("double")), F.lit(0.0)).alias(b) for b in bands]
    other = [c for c in cells.columns if c not in bands]
    out = cells.select(*other, *clear)
    top = out.groupBy(by).agg(*[F.max(b).alias(f"__{b}") for b in bands])
    scaled = lambda b: F.when(F.col(f"__{b}") <= 1.5, F.col(b) * 255).when(F.col(f"__{b}") <= 255.5, F.col(b)).otherwise(F.col(b) * 255 / F.col(f"__{b}"))
    return out.join(sized(top), by).select(*other, *[F.floor(F.least(F.greatest(scaled(b), F.lit(0.0)), F.lit(255.0))).cast("int").alias(b) for b in bands])


def three_bands(cells: DataFrame, bands: list[str]) -> DataFrame:
    """cells with r, g and b from the first three bands; the last one stands in for missing ones."""
    return cells.withColumns({c: F.col(bands[min(k, len(bands) - 1)]) for k, c in enumerate("rgb")})


def catalogue(items: DataFrame, text: str = "item") -> DataFrame:
    """(job_id, ord, gsd, tif, tms, west, south, east, north) of catalogue entries in JSON.

    The resolution is the first one that is given, NO_GSD if that is no number. A box comes from the
    corners of the entry's geometry and is null without one.
    """
    it = F.from_json(text, ITEM)
    res = F.get("it.properties.resolution", 0)
    named = F.coalesce("it.gsd", "it.properties.resolution_in_meters", res)
    numbers = F.transform(F.regexp_extract_all("it.geojson", F.lit(r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)"), F.lit(0)), lambda p: F.split(F.regexp_replace(p, r"[\[\s]", ""), ","))
    xs, ys = F.transform(numbers, lambda p: F.get(p, 0).try_cast("double")), F.transform(numbers, lambda p: F.get(p, 1).try_cast("double"))
    tif = F.when(F.col("it.uuid").startswith("http") & F.lower("it.uuid").contains(".tif"), F.col("it.uuid"))
    tms = F.col("it.properties.tms")
    tms = F.when(tms.contains("{z}") & tms.contains("{x}") & tms.contains("{y}"), tms)
    kept = [c for c in items.columns if c != text]
    return items.withColumn("it", it).select(
        *kept, F.coalesce(named.try_cast("double"), F.lit(NO_GSD)).alias("gsd"), tif.alias("tif"), tms.alias("tms"),
        F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
    )


def pick_sources(entries: DataFrame, boxes: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, tif, tms): the finest entry over a job's box that has a file, and the finest with a
    tile service; of equal resolutions the first listed. If none is over the box all count, as listed."""
    over = (F.col("e.west") <= F.col("b.east")) & (F.col("e.east") >= F.col("b.west")) & (F.col("e.south") <= F.col("b.north")) & (F.col("e.north") >= F.col("b.south"))
    met = entries.alias("e").join(sized(boxes).alias("b"), by).select(*by, "ord", "gsd", "tif", "tms", F.coalesce(over, F.lit(False)).alias("over"))
    near, listed = F.struct("gsd", "ord"), F.col("ord")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col("over") & F.col(c).isNotNull(), near)), F.when(~F.bool_or("over"), F.min_by(c, F.when(F.col(c).isNotNull(), listed)))).alias(c)
    return met.groupBy(by).agg(first("tif"), first("tms"))
