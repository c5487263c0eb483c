"""Operators on rasters: tables of cells (job_id, i, j, value). All work is keyed by job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.storage import sized, stored

JOB = ["job_id"]


def finite(z: Column) -> Column:
    """z where it is a finite number, else null."""
    return F.when(~F.isnan(z) & (F.abs(z) != float("inf")), z)


def prepare_z(cells: DataFrame, exaggeration: float = 1.0, offset: str = "min", by: list[str] = JOB) -> DataFrame:
    """z for display: missing cells take the job's lowest value, then the lowest or the mean value
    is taken off, and the rest is stretched and narrowed to single precision."""
    z = finite(F.col("z").cast("double"))
    low = F.min(z)
    mean = (F.sum(z) + low * F.count_if(z.isNull())) / F.count("*")
    stats = cells.groupBy(by).agg(low.alias("__low"), (mean if offset == "mean" else low).alias("__base"))
    filled = F.coalesce(z, F.col("__low"), F.lit(0.0))
    shown = (filled - F.coalesce("__base", F.lit(0.0))) * F.lit(exaggeration)
    return cells.join(stats, by).select(*by, "i", "j", shown.cast("float").alias("z"))


def full_grid(cells: DataFrame, by: list[str] = JOB) -> DataFrame:
    """Every (i, j) of each job's bounding rectangle, with z null where the cell is missing."""
    size = cells.groupBy(by).agg(F.max("i").alias("h"), F.max("j").alias("w"))
    rows = size.select(*by, F.explode(F.sequence(F.lit(0), "h")).alias("i"), "w")
    rows = rows.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "i")  # else one task makes all cells of a job
    frame = rows.select(*by, "i", F.explode(F.sequence(F.lit(0), "w")).alias("j"))
    return frame.join(cells, [*by, "i", "j"], "left")


def elevation_stats(cells: DataFrame, by: list[str] = JOB) -> DataFrame:
    z = finite(F.col("z"))
    return cells.groupBy(by).agg(F.count(z).alias("n_finite"), F.min(z).alias("elevation_min_m"), F.max(z).alias("elevation_max_m"), (F.max(z) - F.min(z)).alias("relief_m"), F.avg(z).alias("mean_m"))


def low_cells(cells: DataFrame, percent: float, inside: Column | None = None, by: list[str] = JOB) -> DataFrame:
    """cells with low_cut, the exact percentile of z inside, and is_low: z at or below it."""
    inside = F.lit(True) if inside is None else inside
    z = finite(F.col("z"))
    cut = cells.where(inside).groupBy(by).agg(F.percentile(z, F.lit(percent / 100.0)).alias("low_cut"))
    return cells.join(cut, by, "left").withColumn("is_low", F.coalesce(inside & (z <= F.col("low_cut")), F.lit(False)))


def mirrored(cells: DataFrame, radius: int, by: list[str] = JOB) -> DataFrame:
    """cells with the rows and columns at the edges repeated outwards, `radius` deep: mirrored at the edge,
    and again at the far one, as often as a small raster needs."""
    size = cells.groupBy(by).agg((F.max("i") + 1).alias("__h"), (F.max("j") + 1).alias("__w"))
    out = cells.join(sized(size), by)  # a raster's cells are not gathered by their job
    for axis, n in (("i", "__h"), ("j", "__w")):
        a, turn = F.col(axis), 2 * F.col(n)
        low, high = F.lit(-radius), F.col(n) - 1 + radius

        def images(at, turn=turn, low=low, high=high):
            first, last = F.ceil((low - at) / turn).cast("int"), F.floor((high - at) / turn).cast("int")
            return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: (at + k * turn).cast("int"))).otherwise(F.array().cast("array<int>"))

        out = out.withColumn("__image", F.explode(F.concat(images(a), images(-1 - a)))).withColumn(axis, F.col("__image")).drop("__image")
    return out


def focal(cells: DataFrame, radius: int, by: list[str] = JOB, reflect: bool = True, **aggregates: Column) -> DataFrame:
    """Cells with a value for each aggregate over the square of this radius around them.

    Two passes of windows, along rows and then along columns, so a square of side n costs 2 n and
    not n^2. Aggregates are named sum_/min_/max_ columns of expressions on the cell.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    out = mirrored(cells, radius, by) if reflect else cells
    out = out.select(*by, "i", "j", *[c.alias(n) for n, c in aggregates.items()], F.lit(1).alias("__one"))
    for line, along in (("i", "j"), ("j", "i")):
        w = Window.partitionBy(*by, line).orderBy(along).rangeBetween(-radius, radius)
        out = out.select(*by, "i", "j", *[kinds[n.split("_")[0]](n).over(w).alias(n) for n in aggregates], F.sum("__one").over(w).alias("__one"))
    out = out.withColumnRenamed("__one", "n_cells")
    return out.join(cells.select(*by, "i", "j"), [*by, "i", "j"], "left_semi") if reflect else out


def focal_std(cells: DataFrame, value: Column, radius: int, by: list[str] = JOB, name: str = "std") -> DataFrame:
    """Standard deviation over a square, from the sums of values and squares, edges mirrored."""
    v = value.cast("double")
    sums = focal(cells, radius, by, sum_v=v, sum_q=v * v)
    mean = F.col("sum_v") / F.col("n_cells")
    spread = F.col("sum_q") / F.col("n_cells") - mean * mean
    return sums.select(*by, "i", "j", F.sqrt(F.greatest(spread, F.lit(0.0))).alias(name))


def depressions(cells: DataFrame, by: list[str] = JOB, deep: float = 0.75, even: float = 0.45) -> DataFrame:
    """Cells near the lowest of their 21 x 21 surroundings (within `deep`) and flat over 15 x 15
    (standard deviation up to `even`)."""
    low = focal(cells, 10, by, reflect=False, min_z=F.col("z"))
    flat = focal_std(cells, F.col("z"), 7, by)
    both = cells.join(low.select(*by, "i", "j", "min_z"), [*by, "i", "j"]).join(flat, [*by, "i", "j"])
    seed = (F.col("z") - F.col("min_z") <= deep) & (F.col("std") <= even)
    return both.select(*by, "i", "j", "z", "min_z", "std", seed.alias("seed"))


def diamond(steps: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1) if abs(a) + abs(b) <= steps]


def dilate(cells: DataFrame, steps: int = 2, by: list[str] = JOB) -> DataFrame:
    """The cells within `steps` moves along rows and columns of any given cell."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in diamond(steps)]))
    return cells.select(*by, "i", "j", moves.alias("m")).select(*by, (F.col("i") + F.col("m.a")).alias("i"), (F.col("j") + F.col("m.b")).alias("j")).distinct()


#: Side of the blocks in which a raster is blurred, at least.
BLUR_BLOCK = 128


def blurred_block(by: list[str], radius: int, side: int, name: str):
    """Blurred cells (by, i, j, name) of one block from its own cells and those up to `radius` around it (i, j, v, own, sigma)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top, left = key[-2] * side, key[-1] * side
        i, j = rows["i"].to_numpy() - top + radius, rows["j"].to_numpy() - left + radius
        given, v = rows["v"].notna().to_numpy() | rows["nan"].to_numpy(), rows["v"].to_numpy(float)
        sums, met = (np.zeros((side + 2 * radius, side + 2 * radius)) for _ in range(2))
        np.add.at(sums, (i[given], j[given]), v[given])
        np.add.at(met, (i[given], j[given]), 1.0)
        sigma = rows["sigma"].iloc[0]
        reach = int(4.0 * sigma + 0.5)
        raw = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2) if reach else np.ones(1)
        for _ in range(2):  # along rows, then columns
            parts = [(w, slice(radius + k, radius + k + side)) for k, w in zip(range(-reach, reach + 1), raw / raw.sum(), strict=True)]
            sums, met = sum(w * sums[:, at] for w, at in parts).T, sum(met[:, at] for _, at in parts).T
        at = np.unique(np.column_stack([i, j])[rows["own"].to_numpy()] - radius, axis=0)
        out = pd.DataFrame({"i": at[:, 0] + top, "j": at[:, 1] + left, name: sums[at[:, 0], at[:, 1]]})
        out[name] = out[name].astype(object).where(met[at[:, 0], at[:, 1]] > 0, None)
        for k, c in enumerate(by):
            out.insert(k, c, key[k])
        return out

    return run


def gaussian(cells: DataFrame, value: Column, sigma: float | DataFrame, by: list[str] = JOB, name: str = "blurred") -> DataFrame:
    """Gaussian blur, four sigmas wide, edges mirrored: a task has one block of a raster and what lies around it, and
    sums along rows, then columns. sigma is a number, or a table (job_id, sigma) with each job's own."""
    own = sigma.select(*by, F.col("sigma").cast("double").alias("sigma")) if isinstance(sigma, DataFrame) else None
    radius = int(4.0 * (float(sigma) if own is None else own.agg(F.max("sigma")).first()[0] or 0.0) + 0.5)
    side = max(BLUR_BLOCK, 2 * radius)
    cells = cells.select(*by, "i", "j", value.cast("double").alias("v"))
    cells = stored(cells.withColumn("sigma", F.lit(float(sigma))) if own is None else cells.join(sized(own), by), "unblurred")
    spread = mirrored(cells.withColumns({"__i": F.col("i"), "__j": F.col("j")}), radius, by)
    for axis in "ij":
        reached = F.sequence(F.floor((F.col(axis) - radius) / side), F.floor((F.col(axis) + radius) / side))
        spread = spread.withColumn(f"__{axis}block", F.explode(reached))
    home = [F.col(axis) == F.col(f"__{axis}") for axis in "ij"] + [F.floor(F.col(axis) / side) == F.col(f"__{axis}block") for axis in "ij"]
    spread = spread.select(*by, "__iblock", "__jblock", "i", "j", "v", F.coalesce(F.isnan("v"), F.lit(False)).alias("nan"), (home[0] & home[1] & home[2] & home[3]).alias("own"), "sigma")
    # blocks that no cell calls its own are padding
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*by, "i", "j")), f"`{name}` double"])
    return spread.groupBy(*by, "__iblock", "__jblock").applyInPandas(blurred_block(by, radius, side, name), schema)


def bilinear(cells: DataFrame, targets: DataFrame, nodata: float = float("nan"), by: list[str] = JOB) -> DataFrame:
    """targets (job_id, i, j, si, sj) with z interpolated at source row si and column sj; corners
    outside the source or missing don't count, and a target without any is nodata."""
    top, left = F.floor("si").cast("int"), F.floor("sj").cast("int")
    corner = lambda a, b: F.struct((top + a).alias("ci"), (left + b).alias("cj"), ((F.col("si") - top if a else 1 - (F.col("si") - top)) * (F.col("sj") - left if b else 1 - (F.col("sj") - left))).alias("w"))
    four = targets.select(*by, "i", "j", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c"))
    source = cells.select(*by, F.col("i").alias("ci"), F.col("j").alias("cj"), finite(F.col("z")).alias("z"))
    met = four.select(*by, "i", "j", "c.*").join(source, [*by, "ci", "cj"], "left")
    weight = F.sum(F.when(F.col("z").isNotNull(), F.col("w")))
    return met.groupBy(*by, "i", "j").agg(F.when(weight > 1e-12, F.sum(F.col("z") * F.col("w")) / weight).otherwise(F.lit(nodata)).alias("z"))
