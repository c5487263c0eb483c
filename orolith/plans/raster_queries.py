"""Registered raster queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orolith.functions import geo
from orolith.operators import raster
from orolith.sources import views
from orolith.sources.views import sql

def short_z(digits: int = 5):
    return F.round(F.col("z").cast("double"), digits).alias("z")


def prepare_z_min(spark, sf_dir):
    return raster.prepare_z(views.emb_grid(spark, sf_dir), 3.0).select("i", "j", short_z())


def prepare_z_mean(spark, sf_dir):
    return raster.prepare_z(views.emb_grid(spark, sf_dir), 1.5, "mean").select("i", "j", short_z())


def prepare_z_fill(spark, sf_dir):
    holes = raster.full_grid(views.ev_grid(spark, sf_dir)).withColumn("z", F.coalesce("z", F.lit(float("nan"))))
    return raster.prepare_z(holes).select("i", "j", short_z(2))


def elevation_stats(spark, sf_dir):
    return raster.elevation_stats(views.emb_grid(spark, sf_dir)).select("n_finite", *[F.round(c, 6).alias(c) for c in ("elevation_min_m", "elevation_max_m", "relief_m", "mean_m")])


def low_elevation_mask(spark, sf_dir):
    low = raster.low_cells(views.emb_grid(spark, sf_dir), 20)
    return low.where("is_low").select("i", "j", F.round("low_cut", 6).alias("low_cut"))


def focal_min21(spark, sf_dir):
    return raster.focal(views.emb_grid(spark, sf_dir), 10, reflect=False, min_z=F.col("z")).select("i", "j", F.round("min_z", 6).alias("z_min"))


def focal_std15(spark, sf_dir):
    return raster.focal_std(views.emb_grid(spark, sf_dir), F.col("z"), 7).select("i", "j", F.round("std", 6).alias("std"))


def local_std9(spark, sf_dir):
    cells = raster.full_grid(views.px_grid(spark, sf_dir))
    bright = F.coalesce(F.greatest("r", "g", "b"), F.lit(0))
    return raster.focal_std(cells, bright, 4).select("i", "j", F.round("std", 5).alias("std"))


def depression_seed(spark, sf_dir):
    return raster.depressions(views.emb_grid(spark, sf_dir), deep=0.15, even=0.13).where("seed").select("i", "j")


def footprint(spark, sf_dir):
    """px_grid's rectangle with whether each cell's centre is inside the boundary."""
    cells = raster.full_grid(views.px_grid(spark, sf_dir))
    return cells.withColumn("inside", geo.inside(F.col("j") + 0.5, F.col("i") + 0.5, views.BOUNDARY))


def gaussian_alpha(spark, sf_dir):
    mask = footprint(spark, sf_dir).select("job_id", "i", "j", F.when(F.col("inside"), 255).otherwise(0).alias("alpha"))
    soft = raster.gaussian(mask, F.col("alpha"), 1.25)
    return soft.select("i", "j", F.floor(F.col("blurred") + 1e-6).cast("int").alias("alpha"))


def dilate2(spark, sf_dir):
    return raster.dilate(views.px_grid(spark, sf_dir).where("r > 180")).select("i", "j")


def bilinear_resample(spark, sf_dir):
    cells = views.emb_grid(spark, sf_dir)
    targets = cells.select("job_id", "i", "j", (F.col("i") * 1.75 + F.col("j") * 0.125 - 0.5).alias("si"), (F.col("j") * 0.9375 + 0.25).alias("sj"))
    return raster.bilinear(cells, targets).select("i", "j", F.round("z", 6).alias("z"))


QUERIES = {f.__name__: f for f in (prepare_z_min, prepare_z_mean, prepare_z_fill, elevation_stats, low_elevation_mask, focal_min21, focal_std15, local_std9, depression_seed, gaussian_alpha, dilate2, bilinear_resample)}

INSIDE = " <> ".join(
    f"CASE WHEN ({ay} > y) <> ({by} > y) THEN x < {ax} + (y - {ay}) * {(bx - ax) / (by - ay)!r} ELSE false END"
    for (ax, ay), (bx, by) in zip(views.BOUNDARY, [*views.BOUNDARY[1:], views.BOUNDARY[0]], strict=True)
)


def odd(terms: str) -> str:
    """XOR of the terms of INSIDE, from left to right."""
    first, *rest = terms.split(" <> CASE")
    out = f"({first})"
    for t in rest:
        out = f"({out} <> (CASE{t}))"
    return out


#: Row or column k mirrored into 0..n-1.
def mirror(k: str, n: str) -> str:
    return f"(CASE WHEN {k} < 0 THEN -1 - ({k}) WHEN {k} >= {n} THEN 2 * {n} - 1 - ({k}) ELSE {k} END)"


def square(radius: int, value: str, source: str) -> str:
    """Sums over a square around each cell, by joining each with its mirrored neighbours."""
    return f"""size AS (SELECT max(i) + 1 AS h, max(j) + 1 AS w FROM {source}),
    d AS (SELECT unnest(range(-{radius}, {radius + 1})) AS d),
    near AS (SELECT c.i, c.j, {mirror('c.i + a.d', 'h')} AS ni, {mirror('c.j + b.d', 'w')} AS nj FROM {source} c, size, d a, d b),
    sums AS (SELECT n.i, n.j, avg({value}) AS m, avg(({value}) * ({value})) AS q FROM near n JOIN {source} s ON s.i = ni AND s.j = nj GROUP BY 1, 2)"""


PX_FULL = """full_px AS (SELECT f.i, f.j, r, g, b, z FROM (SELECT CAST(a.i AS INT) AS i, CAST(c.j AS INT) AS j FROM
    (SELECT unnest(range((SELECT max(i) + 1 FROM px))) AS i) a, (SELECT unnest(range((SELECT max(j) + 1 FROM px))) AS j) c) f LEFT JOIN px USING (i, j))"""
FOOTPRINT = f"fp AS (SELECT *, {odd(INSIDE)} AS inside FROM (SELECT *, j + 0.5 AS x, i + 0.5 AS y FROM full_px))"

SQL = {
    "prepare_z_min": sql("emb", "SELECT i, j, round(CAST(CAST((z - (SELECT min(z) FROM emb)) * 3.0 AS FLOAT) AS DOUBLE), 5) AS z FROM emb"),
    "prepare_z_mean": sql("emb", "SELECT i, j, round(CAST(CAST((z - (SELECT avg(z) FROM emb)) * 1.5 AS FLOAT) AS DOUBLE), 5) AS z FROM emb"),
    "prepare_z_fill": sql("ev", """SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j,
        round(CAST(CAST(coalesce(z, lo) - lo AS FLOAT) AS DOUBLE), 2) AS z
        FROM (SELECT unnest(range((SELECT max(i) + 1 FROM ev))) AS i) a, (SELECT unnest(range((SELECT max(j) + 1 FROM ev))) AS j) b,
        (SELECT min(z) AS lo FROM ev) LEFT JOIN ev ON ev.i = a.i AND ev.j = b.j"""),
    "elevation_stats": sql("emb", "SELECT count(*) AS n_finite, round(min(z), 6) AS elevation_min_m, round(max(z), 6) AS elevation_max_m, round(max(z) - min(z), 6) AS relief_m, round(avg(z), 6) AS mean_m FROM emb"),
    "low_elevation_mask": sql("emb", "SELECT i, j, round(cut, 6) AS low_cut FROM emb, (SELECT quantile_cont(z, 0.2) AS cut FROM emb) WHERE z <= cut"),
    "focal_min21": sql("emb", """, d AS (SELECT unnest(range(-10, 11)) AS d), rows AS (SELECT c.i, c.j, min(s.z) AS z FROM emb c, d JOIN emb s ON s.i = c.i AND s.j = c.j + d.d GROUP BY 1, 2)
        SELECT c.i, c.j, round(min(s.z), 6) AS z_min FROM rows c, d JOIN rows s ON s.j = c.j AND s.i = c.i + d.d GROUP BY 1, 2"""),
    "focal_std15": sql("emb", f", {square(7, 's.z', 'emb')} SELECT i, j, round(sqrt(greatest(q - m * m, 0)), 6) AS std FROM sums"),
    "local_std9": sql("px", f", {PX_FULL}, lum AS (SELECT i, j, coalesce(greatest(r, g, b), 0) AS v FROM full_px), {square(4, 's.v', 'lum')} SELECT i, j, round(sqrt(greatest(q - m * m, 0)), 5) AS std FROM sums"),
    "depression_seed": sql("emb", f""", {square(7, 's.z', 'emb')}, d10 AS (SELECT unnest(range(-10, 11)) AS d),
        low1 AS (SELECT c.i, c.j, min(s.z) AS z FROM emb c, d10 JOIN emb s ON s.i = c.i AND s.j = c.j + d10.d GROUP BY 1, 2),
        low AS (SELECT c.i, c.j, min(s.z) AS lo FROM low1 c, d10 JOIN low1 s ON s.j = c.j AND s.i = c.i + d10.d GROUP BY 1, 2)
        SELECT i, j FROM emb JOIN low USING (i, j) JOIN sums USING (i, j) WHERE z - lo <= 0.15 AND sqrt(greatest(q - m * m, 0)) <= 0.13"""),
    "gaussian_alpha": sql("px", f""", {PX_FULL}, {FOOTPRINT}, size AS (SELECT max(i) + 1 AS h, max(j) + 1 AS w FROM fp),
        k AS (SELECT d, exp(-0.5 * (d / 1.25) * (d / 1.25)) AS e FROM (SELECT unnest(range(-5, 6)) AS d)),
        kn AS (SELECT d, e / (SELECT sum(e) FROM k) AS w1 FROM k),
        rows AS (SELECT c.i, c.j, sum(w1 * CASE WHEN s.inside THEN 255 ELSE 0 END) AS v FROM fp c, size, kn JOIN fp s ON s.i = c.i AND s.j = {mirror('c.j + kn.d', 'w')} GROUP BY 1, 2)
        SELECT c.i, c.j, CAST(floor(sum(w1 * s.v) + 1e-6) AS INT) AS alpha FROM rows c, size, kn JOIN rows s ON s.j = c.j AND s.i = {mirror('c.i + kn.d', 'h')} GROUP BY 1, 2"""),
    "dilate2": sql("px", """, d AS (SELECT unnest(range(-2, 3)) AS d) SELECT DISTINCT CAST(i + a.d AS INT) AS i, CAST(j + b.d AS INT) AS j FROM px, d a, d b WHERE r > 180 AND abs(a.d) + abs(b.d) <= 2"""),
    "bilinear_resample": sql("emb", """, t AS (SELECT i, j, i * 1.75 + j * 0.125 - 0.5 AS si, j * 0.9375 + 0.25 AS sj FROM emb),
        f AS (SELECT i, j, floor(si) + a AS ci, floor(sj) + b AS cj, (CASE a WHEN 1 THEN si - floor(si) ELSE 1 - (si - floor(si)) END) * (CASE b WHEN 1 THEN sj - floor(sj) ELSE 1 - (sj - floor(sj)) END) AS w
        FROM t, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
        SELECT f.i, f.j, round(CASE WHEN sum(w) FILTER (WHERE z IS NOT NULL) > 1e-12 THEN sum(z * w) / sum(w) FILTER (WHERE z IS NOT NULL) ELSE 'NaN'::DOUBLE END, 6) AS z
        FROM f LEFT JOIN emb s ON s.i = ci AND s.j = cj GROUP BY 1, 2"""),
}
