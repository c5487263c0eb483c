"""Water bodies in imagery with elevation: seeds, blobs, tests on blobs, and a cap on coverage.

Cells are (job_id, i, j, r, g, b[, a][, z]) and fill their job's rectangle. Everything is keyed by
job; blobs are connected components, found with joins, and are tested as rows of a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.functions import color
from orolith.operators import graph, raster
from orolith.operators.palette import inside
from orolith.operators.raster import JOB
from orolith.storage import sized, stored


@dataclass(frozen=True)
class Preset:
    elev_percentile: float
    elev_margin: float
    most_coverage: float
    ring_drop: float
    ring_for_assisted: bool


#: How eagerly ponds are found, by name.
PRESETS = {
    "conservative": Preset(20, 0.5, 0.15, 0.5, True),
    "balanced": Preset(25, 0.75, 0.20, 0.35, True),
    "aggressive": Preset(35, 1.0, 0.28, 0.25, False),
}
#: Cells of the smallest blob, and of the largest (at least, or as a share of the
#: footprint); what share of its box a blob fills, from LARGE cells on; the longest aspect.
LEAST_BLOB, MOST_BLOB, MOST_BLOB_SHARE, FILL, LARGE, LARGE_FILL, ASPECT = 12, 600, 0.42, 0.18, 2000, 0.08, 10.0
#: Fixed values of muddy water: local deviation, saturation, and the range of brightness.
MUDDY_STD, MUDDY_SATURATION, MUDDY_BRIGHT = 10.0, 0.36, (40, 215)


def preset(name: str | None) -> Preset:
    return PRESETS.get((name or "").strip().lower(), PRESETS["conservative"])


def bright_of() -> Column:
    return color.brightness(F.col("r"), F.col("g"), F.col("b")).cast("double")


def local_std(cells: DataFrame, radius: int = 4, by: list[str] = JOB) -> DataFrame:
    """Deviation of the brightness around each cell; outside the footprint it counts as 0."""
    return raster.focal_std(cells, F.when(inside(cells), bright_of()).otherwise(F.lit(0.0)), radius, by)


def muddy(std: Column, r: Column, g: Column, b: Column) -> Column:
    bright = color.brightness(r, g, b)
    return (std <= MUDDY_STD) & (color.saturation(r, g, b) <= MUDDY_SATURATION) & bright.between(*MUDDY_BRIGHT)


def seeds(cells: DataFrame, sensitivity: str | None = "conservative", by: list[str] = JOB) -> DataFrame:
    """cells with bright, inside, sure (dark or open water), seed, and the job's foot_px and low_cut.

    low_cut is null where no elevation is given; then only sure cells are seeds.
    """
    p, has_z = preset(sensitivity), "z" in cells.columns
    z = raster.finite(F.col("z").cast("double")) if has_z else F.lit(None).cast("double")
    base = cells.select(*by, "i", "j", "r", "g", "b", F.col("z").cast("double").alias("z") if has_z else F.lit(None).cast("double").alias("z"), z.alias("ze"), inside(cells).alias("inside"), bright_of().alias("bright"))
    of = lambda c: F.when(F.col("inside"), F.col(c))
    cut = lambda q: F.percentile(of("ze"), F.lit(q / 100.0))
    stats = base.groupBy(by).agg(F.percentile(of("bright"), F.lit(0.05)).alias("p5"), F.count_if("inside").alias("foot_px"), cut(p.elev_percentile).alias("low_cut"), cut(min(95.0, p.elev_percentile + 10)).alias("seed_cut"), F.median(of("ze")).alias("mid"))
    out = base.join(sized(stats), by)
    r, g, b, bright = (F.col(c) for c in ("r", "g", "b", "bright"))
    sure = F.col("inside") & ((bright <= F.least(F.col("p5") + 3, F.lit(45.0))) | ((b > r + 3) & (g > r + 2) & bright.between(20, 100)))
    seed = sure
    if has_z:
        std = local_std(cells, by=by).withColumnRenamed("std", "std9")
        filled = out.select(*by, "i", "j", F.coalesce("ze", "mid", F.lit(0.0)).alias("z"))
        deep = raster.depressions(filled, by).select(*by, "i", "j", F.col("seed").alias("deep"))
        out = out.join(std, [*by, "i", "j"]).join(deep, [*by, "i", "j"])
        low = F.col("ze").isNotNull() & (F.col("ze") <= F.col("seed_cut"))
        wet = F.col("inside") & muddy(F.col("std9"), r, g, b) & ((F.col("deep") & F.col("ze").isNotNull()) | F.coalesce(low, F.lit(False)))
        seed = seed | wet
    kept = [*by, "i", "j", "r", "g", "b", "z", "bright", "inside", "foot_px", "low_cut"]
    return out.select(*kept, F.coalesce(sure, F.lit(False)).alias("sure"), F.coalesce(seed, F.lit(False)).alias("seed"))


def blobs(cells: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, blob_i, blob_j): the 4-connected component of each cell, named by its first
    cell in reading order.

    Runs of cells along a row are joined up first, by a window, so the graph has a node a run.
    """
    w = Window.partitionBy(*by, "i").orderBy("j")
    run = F.min("j").over(Window.partitionBy(*by, "i", "__gap"))
    rows = cells.select(*by, "i", "j").distinct().withColumn("__gap", F.col("j") - F.row_number().over(w))
    rows = stored(rows.withColumn("__run", run).drop("__gap"), "runs")
    # a run's number: its row, then its first column (of either sign)
    number = F.shiftleft(F.col("i").cast("long"), 32) + F.col("__run")
    rows = rows.withColumn("__node", number)
    below = rows.select(*by, (F.col("i") + 1).alias("i"), "j", F.col("__node").alias("__up"))
    edges = rows.join(below, [*by, "i", "j"]).select(*by, F.col("__up").alias("a"), F.col("__node").alias("b")).distinct()
    roots = graph.banded(edges, by, BAND_ROWS << 32).withColumnsRenamed({"node": "__node", "root": "__root"})
    out = rows.join(roots, [*by, "__node"], "left").withColumn("__root", F.coalesce("__root", "__node"))
    first = F.shiftright(F.col("__root") + F.lit(1 << 31), 32).cast("int")
    return out.select(*by, "i", "j", first.alias("blob_i"), (F.col("__root") - F.shiftleft(first.cast("long"), 32)).cast("int").alias("blob_j"))


#: Rows whose runs are joined up by one task.
BAND_ROWS = 64
BLOB = ["blob_i", "blob_j"]


def blob_stats(members: DataFrame, by: list[str] = JOB) -> DataFrame:
    """A row a blob of members (job_id, i, j, blob_i, blob_j, r, g, b, bright, z, sure)."""
    z = F.col("z")
    ill = F.bool_or(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")))
    return members.groupBy(*by, *BLOB).agg(
        F.count("*").alias("size"), (F.max("i") - F.min("i") + 1).alias("height"), (F.max("j") - F.min("j") + 1).alias("width"),
        *[F.median(c).alias(f"med_{c}") for c in ("r", "g", "b", "bright")],
        F.when(~ill, F.median("z")).alias("med_z"), F.median(raster.finite(z)).alias("med_finite"), F.bool_or("sure").alias("sure"),
    )


def well_shaped(size: Column, height: Column, width: Column, foot_px: Column) -> Column:
    """Whether a blob's size, its share of its box and its aspect are those of a water body."""
    most = F.greatest(F.lit(MOST_BLOB), F.floor(foot_px * F.lit(MOST_BLOB_SHARE)))
    fill = F.when(size >= LARGE, F.lit(LARGE_FILL)).otherwise(F.lit(FILL))
    aspect = F.greatest(height, width) / F.least(height, width)
    return size.between(F.lit(LEAST_BLOB), most) & (size / (height * width) >= fill) & (aspect <= ASPECT)


def rings(members: DataFrame, cells: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, blob_i, blob_j, ring_z): the median elevation of the cells within two steps of a
    blob, inside the footprint and not of the blob itself; null if there are none."""
    key = [*by, *BLOB]
    around = raster.dilate(members.select(*key, "i", "j"), 2, key).join(members.select(*key, "i", "j"), [*key, "i", "j"], "left_anti")
    ground = cells.where("inside").select(*by, "i", "j", raster.finite(F.col("z")).alias("z"))
    # merged: a packed raster may look small enough to be broadcast
    return around.join(ground.hint("merge"), [*by, "i", "j"]).groupBy(key).agg(F.median("z").alias("ring_z"))


def judged(stats: DataFrame, p: Preset) -> DataFrame:
    """Blobs (blob_stats with foot_px, low_cut and ring_z) with `accepted` and `score`."""
    z, cut, size = F.col("med_z"), F.col("low_cut"), F.col("size")
    known = z.isNotNull() & cut.isNotNull()
    low = known & (z <= cut)
    assisted, large = ~F.col("sure"), size >= LARGE
    pale = (size > F.col("foot_px") * F.lit(0.08)) & (F.col("med_bright") > 118) & ~low
    margin = F.when(assisted, F.lit(p.elev_margin * 0.35)).otherwise(F.lit(p.elev_margin))
    high = known & (z > cut + margin)
    drop = F.when(assisted | F.lit(p.ring_for_assisted), F.lit(p.ring_drop)).otherwise(F.lit(0.0))
    drop = F.when(low & large, F.least(drop, F.lit(0.2))).when(low, F.least(drop, F.lit(0.3))).otherwise(drop)
    ring = F.coalesce((drop <= 0) | (F.col("ring_z") - F.col("med_finite") >= drop), F.lit(True))
    flat = assisted & F.lit(p.ring_for_assisted) & ~ring & ~low
    median = [F.col(f"med_{c}").cast("int") for c in ("r", "g", "b")]
    water = color.looks_like_water(*median, F.col("med_bright"), assisted & ~low) | (assisted & low & color.looks_bright_uniform(*median, F.col("med_bright")))
    depth = F.when(known, F.greatest(F.lit(0.0), (cut + F.lit(p.elev_margin) - z) / F.lit(max(p.elev_margin, 0.1)))).otherwise(F.lit(0.0))
    one = lambda c, points: F.when(c, F.lit(points)).otherwise(F.lit(0.0))
    score = F.lit(1.0) + one(F.col("sure"), 3.0) + one(low, 2.0) + one(large, 1.5) + depth + one(ring, 0.75)
    fits = well_shaped(size, F.col("height"), F.col("width"), F.col("foot_px"))
    accepted = fits & ~pale & ~high & ~flat & water
    return stats.withColumns({"accepted": F.coalesce(accepted, F.lit(False)), "ring_ok": ring, "score": score})


def capped(found: DataFrame, most: Column, by: list[str] = JOB) -> DataFrame:
    """The blobs (size, score) that a job's budget of `most` cells takes: best score first, of equal
    ones the first in reading order; a blob that doesn't fit is passed over and the next is tried.

    Blobs are sorted in ranges and their sizes added up: all before the first that doesn't fit are taken. Of
    the others only those within what is left can be, and of one size s only the first left / s; these few
    are tried one by one.
    """
    order = [F.col("less"), F.col("blob_i"), F.col("blob_j")]
    items = found.select(*by, (-F.col("score")).alias("less"), *BLOB, F.col("size").cast("long").alias("size"), most.cast("long").alias("most"))
    items = stored(items.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()), "ranked-blobs")

    def before(value: str, keys: list[str]) -> Column:
        """The sum of value over a key's earlier ranges."""
        return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    start = items.groupBy(*by, "range").agg(F.sum("size").alias("sum")).select(*by, "range", before("sum", by).alias("start"))
    inner = F.sum("size").over(Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = stored(items.join(sized(start), [*by, "range"]).withColumn("used", F.col("start") + inner), "summed-blobs")
    taken = summed.where("used <= most").select(*by, *BLOB)
    left = summed.groupBy(by).agg((F.max("most") - F.coalesce(F.max(F.when(F.col("used") <= F.col("most"), F.col("used"))), F.lit(0))).alias("left"))
    rest = stored(summed.where("used > most").join(sized(left), by).where("size <= left").select(*by, *BLOB, "less", "size", "left", "range"), "other-blobs")
    if rest.isEmpty():
        return taken
    like = [*by, "size"]
    first = rest.groupBy(*like, "range").agg(F.count("*").alias("n")).select(*like, "range", before("n", like).alias("first"))
    place = F.col("first") + F.row_number().over(Window.partitionBy(*like, "range").orderBy(*order))
    few = rest.join(first, [*like, "range"]).withColumn("place", place).where("place * size <= left")
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}

    def tried(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["less", *BLOB])
        free, keep = int(rows["left"].iloc[0]), []
        for size in rows["size"].tolist():
            keep.append(size <= free)
            free -= size if keep[-1] else 0
        return rows.loc[keep, [*by, *BLOB]]

    more = few.groupBy(by).applyInPandas(tried, ", ".join(f"{c} {kinds[c]}" for c in [*by, *BLOB]))
    return taken.unionByName(stored(more, "fitting-blobs"))


def candidate_blobs(cells: DataFrame, sensitivity: str | None = "conservative", by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """(members, blobs): the cells of each blob, and the blobs with their tests and scores."""
    told = stored(seeds(cells, sensitivity, by), "seeds")
    lit = told.where("seed")
    members = stored(lit.join(blobs(lit, by), [*by, "i", "j"]), "blob-cells")
    job = told.groupBy(by).agg(F.max("foot_px").alias("foot_px"), F.max("low_cut").alias("low_cut"))
    stats = stored(blob_stats(members, by).join(sized(job), by), "blobs")
    worth = stats.where(well_shaped(F.col("size"), F.col("height"), F.col("width"), F.col("foot_px"))).select(*by, *BLOB)
    ring = rings(members.join(worth, [*by, *BLOB], "left_semi"), told, by)
    return members, judged(stats.join(ring, [*by, *BLOB], "left"), preset(sensitivity))


def detect(cells: DataFrame, sensitivity: str | None = "conservative", by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, blob_i, blob_j, score): the pond cells of each job."""
    members, found = candidate_blobs(cells, sensitivity, by)
    found = stored(found.where("accepted"), "accepted")
    most = F.greatest(F.lit(1), F.rint(F.col("foot_px") * F.lit(preset(sensitivity).most_coverage)))
    kept = capped(found, most, by).join(found.select(*by, *BLOB, "score"), [*by, *BLOB])
    return members.where("inside").join(sized(kept), [*by, *BLOB]).select(*by, "i", "j", *BLOB, "score")
