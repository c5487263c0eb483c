"""Palettes of at most eight colours: tables (job_id, index, r, g, b, ...) and the pixels they label.

A job's palette travels as one short array, so a pixel finds its colour in a projection: no pixel is
ever paired with palette rows. Distances are squared CIE Lab; of equal ones the lower index wins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.functions import color
from orolith.operators.raster import JOB
from orolith.storage import sized, stored

#: Colours at most, squared distances for accents and for merging, pixels that an
#: accent pool and a pond need, the pond's filament, and the alpha that counts as inside.
MOST_COLORS, ACCENT_APART, MERGE_WITHIN = 8, 64.0, 100.0
ACCENT_PIXELS, POND_PIXELS, POND_FILAMENT, OPAQUE = 32, 12, (45, 100, 135), 128
#: Accents are clustered over bins of this many levels a channel: at most 32^3 rows a job.
LEVELS = 8


def literal_palette(spark, colors: list[tuple[int, int, int]], job: str) -> DataFrame:
    """The colours as a palette of one job, made by expressions so that it is planned as constants."""
    swatch = [F.struct(F.lit(job).alias("job_id"), F.lit(i).alias("index"), *[F.lit(c).alias(n) for c, n in zip(rgb, "rgb", strict=True)]) for i, rgb in enumerate(colors)]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*swatch)))


def inside(cells: DataFrame) -> Column:
    """Whether a cell is inside the footprint: alpha of 128 or more, or no alpha at all."""
    return F.coalesce(F.col("a") >= OPAQUE, F.lit(True)) if "a" in cells.columns else F.lit(True)


def histogram(pixels: DataFrame, by: list[str] = JOB) -> DataFrame:
    """The colours of each job with `n`, how many pixels have it. There are 2^24 at most however many
    pixels there are, so colour arithmetic belongs behind this grouping, which is done map-side first."""
    return pixels.groupBy(*by, "r", "g", "b").agg(F.count("*").alias("n"))


def with_swatches(pixels: DataFrame, palette: DataFrame, by: list[str] = JOB) -> DataFrame:
    """pixels with `__lab`, their colour, and `swatches`, their job's palette as an array of (index,
    lab), lowest index first. The colour is a column so that it is worked out once a pixel."""
    swatch = F.struct(F.col("index"), color.lab(F.col("r"), F.col("g"), F.col("b")).alias("lab"))
    arrays = palette.groupBy(by).agg(F.array_sort(F.collect_list(swatch)).alias("swatches"))
    return color.with_lab(pixels.join(sized(arrays), by))


def nearest(lab: Column, swatches: Column) -> Column:
    """The index of the swatch nearest to a Lab colour."""
    return F.array_min(F.transform(swatches, lambda s: F.struct(color.squared(lab, s["lab"]).alias("d"), s["index"].alias("index"))))["index"]


def quantize(pixels: DataFrame, palette: DataFrame, merge: int | None = None, within: float = MERGE_WITHIN, forced: tuple[int, Column] | None = None, by: list[str] = JOB) -> DataFrame:
    """pixels with `label`, the index of the nearest colour.

    With `merge`, swatches within that squared distance of the merge colour take its index. `forced`
    is an index and a condition that has it come what may. Cells outside the footprint are 0.
    """
    out = with_swatches(pixels, palette, by)
    label = nearest(F.col("__lab"), F.col("swatches"))
    if merge is not None:
        base = F.filter("swatches", lambda s: s["index"] == merge)[0]["lab"]
        close = F.transform(F.filter("swatches", lambda s: color.squared(s["lab"], base) <= within), lambda s: s["index"])
        label = F.when(F.array_contains(close, label), F.lit(merge)).otherwise(label)
    if forced is not None:
        label = F.when(forced[1], F.lit(forced[0])).otherwise(label)
    return out.withColumn("label", F.when(inside(pixels), label).otherwise(F.lit(0))).drop("swatches", "__lab")


def coverage(labelled: DataFrame, palette: DataFrame, by: list[str] = JOB) -> DataFrame:
    """palette with n_pixels and coverage_pct, the share of a job's labelled pixels in percent.
    labelled are pixels, or colours with `n`, the number of their pixels."""
    counted = F.sum("n") if "n" in labelled.columns else F.count("*")
    counts = labelled.groupBy(*by, F.col("label").alias("index")).agg(counted.alias("n_pixels"))
    out = palette.join(counts, [*by, "index"], "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0).cast("long")))
    total = F.sum("n_pixels").over(Window.partitionBy(by))
    return out.withColumn("coverage_pct", F.when(total > 0, F.round(F.lit(100.0) * F.col("n_pixels") / total, 2)).otherwise(F.lit(0.0)))


def ranked(entries: DataFrame, by: list[str] = JOB) -> DataFrame:
    """Entries (index, role, name, coverage_pct, ...) numbered anew: base, then pond, then by
    coverage; part_name and material_name are the rank and the slug of the name."""
    role = F.when(F.col("role") == "base", 0).when(F.col("role") == "pond", 1).otherwise(2)
    has_base = F.bool_or(F.col("role") == "base").over(Window.partitionBy(by))
    order = Window.partitionBy(by).orderBy(F.when(has_base, role).otherwise(0), F.when(has_base & (role < 2), F.lit(0.0)).otherwise(-F.col("coverage_pct")), "index")
    rank = F.row_number().over(order)
    slug = F.when(F.col("role").isin("base", "pond"), F.col("role")).otherwise(color.slug(F.col("name")))
    part = F.format_string("%02d_%s", F.col("__rank"), slug)
    out = entries.withColumn("__rank", rank)
    return out.withColumns({"part_name": part, "material_name": part, "index": F.col("__rank") - 1}).drop("__rank")


def mean_of(colors: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, g, b): the mean in Lab of colours with `__lab` and `n`, as a colour."""
    mean = colors.groupBy(by).agg(*[(F.sum(F.col(f"__lab.{c}") * F.col("n")) / F.sum("n")).alias(c) for c in ("L", "a", "b")])
    return mean.select(*by, color.from_lab(F.col("L"), F.col("a"), F.col("b")).alias("__rgb")).select(*by, "__rgb.r", "__rgb.g", "__rgb.b")


def mean_color(pixels: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, r, g, b): the mean in Lab as a colour."""
    return mean_of(color.with_lab(histogram(pixels, by)), by)


def refine(pixels: DataFrame, palette: DataFrame, by: list[str] = JOB) -> DataFrame:
    """One step of Lloyd's algorithm: each colour becomes the Lab mean of the pixels nearest to it;
    a colour without pixels stays."""
    labelled = with_swatches(histogram(pixels, by), palette, by).withColumn("index", nearest(F.col("__lab"), F.col("swatches")))
    means = mean_of(labelled, [*by, "index"]).withColumnsRenamed({c: f"__{c}" for c in "rgb"})
    return palette.join(means, [*by, "index"], "left").select(*by, "index", *[F.coalesce(f"__{c}", c).cast("int").alias(c) for c in "rgb"])


def median_cut(pixels: DataFrame, n: int, by: list[str] = JOB) -> DataFrame:
    """(job_id, index, r, g, b): n colours by median cut over the colour histogram, then refined.

    The box with most pixels that still has two colours is cut at the weighted median of its widest
    channel (of equal ones the first), so each round doubles nothing and costs two groupings of the
    histogram. Where a job has fewer colours than n, the last one is repeated.
    """
    hist = stored(histogram(pixels, by), "histogram")
    boxes = hist.withColumn("box", F.lit(0))
    for made in range(1, max(1, n)):
        spans = boxes.groupBy(*by, "box").agg(F.sum("n").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "rgb"])
        widest = F.greatest("r", "g", "b")
        w = Window.partitionBy(by).orderBy(F.desc("n"), "box")
        pick = spans.where(widest > 0).withColumn("k", F.row_number().over(w)).where("k = 1")
        axis = F.when(F.col("r") == widest, 0).when(F.col("g") == widest, 1).otherwise(2)
        boxes = boxes.join(sized(pick.select(*by, F.col("box").alias("__cut"), axis.alias("__axis"))), by, "left")
        value = F.element_at(F.array("r", "g", "b"), F.col("__axis") + 1)
        inner = boxes.where(F.col("box") == F.col("__cut")).withColumn("v", value)
        middle = inner.groupBy(by).agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("m"), F.max("v").alias("top"))
        # a cut at the largest value would leave nothing above it
        middle = middle.select(*by, F.when(F.col("m") >= F.col("top"), F.col("top") - 1).otherwise(F.col("m")).alias("__m"))
        above = (F.col("box") == F.col("__cut")) & (value > F.col("__m"))
        boxes = boxes.join(sized(middle), by, "left").withColumn("box", F.when(above, F.lit(made)).otherwise(F.col("box"))).drop("__cut", "__axis", "__m")
        boxes = stored(boxes, "boxes")
    mean = boxes.groupBy(*by, "box").agg(*[F.rint(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c) for c in "rgb"])
    have = mean.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("box", "r", "g", "b"))).alias("have"))
    index = F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))).alias("index")
    at = F.element_at("have", F.least(F.col("index") + 1, F.size("have")))
    seeds = have.select(*by, "have", index).select(*by, "index", *[at[c].alias(c) for c in "rgb"])
    return refine(pixels, seeds, by)


def accent_clusters(n: int, rounds: int):
    """Per-job k-means over at most 32^3 weighted bins: first seed the bin farthest from the base,
    each next the one farthest from all seeds so far, then Lloyd rounds until nothing moves."""

    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["qr", "qg", "qb"], ignore_index=True)
        x = bins[["L", "A", "B"]].to_numpy() / bins[["n"]].to_numpy()
        weight = bins["n"].to_numpy()[:, None]
        base = bins[["base_L", "base_A", "base_B"]].to_numpy()[0]
        far = ((x - base) ** 2).sum(1)
        seeds = []
        for _ in range(n):
            seeds.append(int(far.argmax()))
            d = ((x - x[seeds[-1]]) ** 2).sum(1)
            far = d if len(seeds) == 1 else np.minimum(far, d)
        centers, before = x[seeds], None
        for _ in range(rounds):
            label = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
            if before is not None and (label == before).all():
                break
            before = label
            for k in range(n):
                if (own := label == k).any():
                    centers[k] = (x[own] * weight[own]).sum(0) / weight[own].sum()
        out = pd.DataFrame(centers, columns=["L", "A", "B"])
        out.insert(0, "index", np.arange(n, dtype=np.int32))
        out.insert(0, "job_id", bins["job_id"].iloc[0])
        return out

    return run


def accents(pixels: DataFrame, base: DataFrame, n: int, apart: float = ACCENT_APART, rounds: int = 20) -> DataFrame:
    """(job_id, index, r, g, b): n accent colours of a job's pixels that are apart from its base.

    Pixels closer to the base than `apart` are left out, unless too few remain. Sums over bins of
    LEVELS levels a channel are exact, so the centres are means of pixels; only which centre a bin's
    pixels go to is decided bin by bin.
    """
    ground = base.select("job_id", color.lab(F.col("r"), F.col("g"), F.col("b")).alias("__base"))
    px = color.with_lab(histogram(pixels).join(sized(ground), "job_id"))
    px = px.withColumn("__far", color.squared(F.col("__lab"), F.col("__base")) >= apart)
    bin_of = [F.floor(F.col(c) / F.lit(LEVELS)).cast("int").alias(f"q{c}") for c in "rgb"]
    sums = [F.sum(F.col(f"__lab.{c}") * F.col("n")).alias(name) for c, name in (("L", "L"), ("a", "A"), ("b", "B"))]
    bins = px.groupBy("job_id", *bin_of, "__far").agg(*sums, F.first("__base").alias("base"), F.sum("n").alias("n"))
    enough = F.sum(F.when(F.col("__far"), F.col("n")).otherwise(0)).over(Window.partitionBy("job_id")) >= max(ACCENT_PIXELS, 8 * n)
    bins = bins.withColumn("__enough", enough).where(F.col("__far") | ~F.col("__enough"))
    bins = bins.select("job_id", "qr", "qg", "qb", "n", "L", "A", "B", F.col("base.L").alias("base_L"), F.col("base.a").alias("base_A"), F.col("base.b").alias("base_B"))
    centers = bins.groupBy("job_id").applyInPandas(accent_clusters(n, rounds), "job_id string, index int, L double, A double, B double")
    return centers.select("job_id", "index", color.from_lab(F.col("L"), F.col("A"), F.col("B")).alias("c")).select("job_id", "index", "c.r", "c.g", "c.b")


def entries(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """palette (job_id, index, r, g, b, role) with hex, name, coverage and ranked indices."""
    labelled = with_swatches(histogram(pixels), palette).withColumn("label", nearest(F.col("__lab"), F.col("swatches")))
    c = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    named = F.when(F.col("role") == "base", "Base").when(F.col("role") == "pond", "Pond").otherwise(color.filament_name(c["h"], c["s"], c["v"]))
    out = coverage(labelled.select("job_id", "label", "n"), palette).withColumns({"hex": color.hex_rgb(F.col("r"), F.col("g"), F.col("b")), "name": named})
    return ranked(out)


def recommend(cells: DataFrame, n: int = 4, reserve_base: bool = True, ponds: DataFrame | None = None, override: bool = False) -> DataFrame:
    """The palette recommended for each job's cells (job_id, i, j, r, g, b[, a]).

    The base is the Lab mean of the footprint. Jobs with at least POND_PIXELS pond cells (table
    `ponds`: job_id, i, j) and room for it get a pond colour, the median of those cells; the other
    colours are accents of the land. With `override`, ponds were drawn by hand and the pond shows its
    filament's colour. Without reserve_base all colours but the pond's come from a median cut.
    A job with an empty footprint takes all its cells.
    """
    n = max(2, min(MOST_COLORS, n))
    px = cells.withColumn("__in", inside(cells))
    empty = px.groupBy("job_id").agg(F.bool_or("__in").alias("__any"))
    px = px.join(sized(empty), "job_id").where(F.col("__in") | ~F.col("__any")).drop("__any")
    if ponds is None:
        px = px.withColumn("__pond", F.lit(False))
    else:
        px = px.join(ponds.select("job_id", "i", "j", F.lit(True).alias("__pond")).distinct(), ["job_id", "i", "j"], "left")
        px = px.withColumn("__pond", F.coalesce("__pond", F.lit(False)) & F.col("__in"))
    px = stored(px.select("job_id", *[F.col(c).cast("int").alias(c) for c in "rgb"], "__in", "__pond"), "footprint")
    wet = px.where("__pond").groupBy("job_id").agg(F.count("*").alias("pond_pixel_count"), *[F.rint(F.median(c)).cast("int").alias(c) for c in "rgb"])
    foot = px.groupBy("job_id").agg(F.count_if("__in").alias("__foot"))
    wet = stored(wet.join(foot, "job_id").where(F.col("pond_pixel_count") >= POND_PIXELS), "ponds")
    tops = n - 1 if reserve_base else n
    room = tops >= 2 and not wet.isEmpty()
    dry_px = px.join(sized(wet.select("job_id")), "job_id", "left_anti") if room else px
    first = 1 if reserve_base else 0
    parts: list[DataFrame] = []
    base = None
    if reserve_base:
        base = stored(mean_color(px), "base")
        parts.append(base.select("job_id", F.lit(0).alias("index"), "r", "g", "b", F.lit("base").alias("role")))

    def land(of: DataFrame, k: int) -> DataFrame:
        found = accents(of, base, k) if reserve_base else median_cut(of, k)
        return found.select("job_id", (F.col("index") + first).cast("int").alias("index"), "r", "g", "b", F.lit("land").alias("role"))

    parts.append(land(dry_px, tops))
    if room:
        shore = px.groupBy("job_id").agg(F.bool_and("__pond").alias("__all")).join(wet.select("job_id"), "job_id")
        parts.append(land(px.join(sized(shore), "job_id").where(~F.col("__pond") | F.col("__all")).drop("__all"), tops - 1))
        parts.append(wet.select("job_id", F.lit(n - 1).alias("index"), "r", "g", "b", F.lit("pond").alias("role")))
    out = entries(px, stored(reduce(DataFrame.unionByName, parts), "palette"))
    facts = wet.select("job_id", "pond_pixel_count", "__foot", F.array("r", "g", "b").alias("imagery_rgb"), F.lit("pond").alias("role"))
    out = out.join(sized(facts), ["job_id", "role"], "left")
    pond = F.col("role") == "pond"
    filament = F.array(*[F.lit(c) for c in POND_FILAMENT])
    rgb = F.array("r", "g", "b")
    out = out.withColumns({"filament_rgb": F.when(pond, filament), "rgb": F.when(pond & F.lit(override), filament).otherwise(rgb)})
    if reserve_base:
        share = F.round(F.lit(100.0) * F.col("pond_pixel_count") / F.col("__foot"), 2)
        out = out.withColumn("coverage_pct", F.when(pond & (F.col("__foot") > 0), share).otherwise(F.col("coverage_pct")))
    if override:
        out = out.withColumn("hex", color.hex_rgb(*[F.element_at("rgb", k) for k in (1, 2, 3)]))
    shown = [F.element_at("rgb", k).alias(c) for k, c in enumerate("rgb", 1)]
    return out.select("job_id", "index", *shown, "rgb", "hex", "name", "role", "part_name", "material_name", "n_pixels", "coverage_pct", "pond_pixel_count", "imagery_rgb", "filament_rgb")


def preview(labelled: DataFrame, palette: DataFrame) -> DataFrame:
    """labelled cells as RGBA: the colour of the label (at most the last one), opaque inside."""
    colors = palette.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("index", "r", "g", "b"))).alias("__colors"))
    at = F.element_at("__colors", F.least(F.col("label") + 1, F.size("__colors")))
    rgba = [at[c].alias(c) for c in "rgb"] + [F.when(inside(labelled), 255).otherwise(0).alias("a")]
    return labelled.join(sized(colors), "job_id").select("job_id", "i", "j", *rgba)
