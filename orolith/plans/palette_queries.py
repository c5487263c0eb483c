"""Registered colour, palette and pond queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orolith.functions import color
from orolith.operators import palette, ponds, raster, shapes
from orolith.plans.raster_queries import PX_FULL, square
from orolith.sources import views
from orolith.sources.views import sql
from orolith.storage import stored

#: A fixed palette for the queries: base first.
COLORS = [(128, 128, 128), (40, 95, 143), (200, 60, 60), (60, 200, 120)]
RGB = ["r", "g", "b"]


def swatches(spark):
    return palette.literal_palette(spark, COLORS, "px")


def px(spark, sf_dir):
    return views.li_px(spark, sf_dir)


def distinct_px(spark, sf_dir):
    return px(spark, sf_dir).select(*RGB).distinct()


def rgb_to_hsv(spark, sf_dir):
    c = color.hsv(*map(F.col, RGB))
    return distinct_px(spark, sf_dir).select(*RGB, *[F.round(c[k], 9).alias(k) for k in "hsv"])


def filament_name(spark, sf_dir):
    c = color.hsv(*map(F.col, RGB))
    return distinct_px(spark, sf_dir).select(*RGB, color.filament_name(c["h"], c["s"], c["v"]).alias("name"))


def hex_rgb(spark, sf_dir):
    return distinct_px(spark, sf_dir).select(*RGB, color.hex_rgb(*map(F.col, RGB)).alias("hex"), color.hex_rgb(*map(F.col, RGB), "FF").alias("hex_rgba"))


def slugify(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", color.slug(F.concat(F.lit("  "), "p_name", F.lit("--"), "p_brand")).alias("slug"))


def rgb_to_lab(spark, sf_dir):
    c = color.lab(*map(F.col, RGB))
    return distinct_px(spark, sf_dir).select(*RGB, *[F.round(c[k], 5).alias(f"lab_{k.lower()}") for k in ("L", "a", "b")])


def lab_mean_base(spark, sf_dir):
    return palette.mean_color(px(spark, sf_dir)).select(*RGB)


def nearest_palette(spark, sf_dir):
    return palette.quantize(px(spark, sf_dir).distinct(), swatches(spark)).select(*RGB, "label")


def palette_coverage(spark, sf_dir):
    return palette.coverage(palette.quantize(palette.histogram(px(spark, sf_dir)), swatches(spark)), swatches(spark)).select("index", *RGB, "n_pixels", "coverage_pct")


def merge_base(spark, sf_dir):
    """As nearest_palette, with colours within 55 of the base's taking its index."""
    return palette.quantize(px(spark, sf_dir).distinct(), swatches(spark), merge=0, within=3025.0).select(*RGB, "label")


def force_mask(spark, sf_dir):
    forced = (3, F.col("g") > 200)
    return palette.quantize(px(spark, sf_dir).distinct(), swatches(spark), forced=forced).select(*RGB, "label")


def palette_rank(spark, sf_dir):
    found = palette.coverage(palette.quantize(palette.histogram(px(spark, sf_dir)), swatches(spark)), swatches(spark))
    c = color.hsv(*map(F.col, RGB))
    role = F.when(F.col("index") == 0, "base").when(F.col("index") == 1, "pond").otherwise("land")
    named = found.withColumns({"role": role, "name": F.when(role == "land", color.filament_name(c["h"], c["s"], c["v"])).otherwise(F.initcap(role))})
    return palette.ranked(named).select("index", "role", "name", "part_name", "coverage_pct")


def refine_palette(spark, sf_dir):
    return palette.refine(px(spark, sf_dir), swatches(spark)).select("index", *RGB)


def palette_entries(spark, sf_dir):
    role = F.when(F.col("index") == 0, "base").otherwise("land")
    return palette.entries(px(spark, sf_dir), swatches(spark).withColumn("role", role)).select("index", "hex", "name", "role", "part_name", "coverage_pct")


def median_cut(spark, sf_dir):
    return palette.median_cut(px(spark, sf_dir), 4).select("index", *RGB)


def kmeans_accents(spark, sf_dir):
    pixels = px(spark, sf_dir)
    return palette.accents(pixels, palette.mean_color(pixels), 3).select("index", *RGB)


def recommend_palette(spark, sf_dir):
    cells = raster.full_grid(views.px_grid(spark, sf_dir)).withColumns({c: F.coalesce(c, F.lit(0)) for c in RGB})
    wet = cells.where("i BETWEEN 10 AND 14 AND j BETWEEN 3 AND 8").select("job_id", "i", "j")
    return palette.recommend(cells, 4, True, wet, True).drop("job_id")


def preview_quantized(spark, sf_dir):
    cells = views.px_grid(spark, sf_dir)
    return palette.preview(palette.quantize(cells, swatches(spark)), swatches(spark)).drop("job_id")


def water_predicate(spark, sf_dir):
    args = [F.col(c) for c in RGB]
    bright = color.brightness(*args)
    cells = views.px_grid(spark, sf_dir)
    return cells.select("i", "j", color.looks_like_water(*args, bright, F.lit(False)).alias("water"), color.looks_like_water(*args, bright, F.lit(True)).alias("strict"), color.looks_bright_uniform(*args, bright).alias("pale"))


def dark_open_seed(spark, sf_dir):
    cells = views.px_grid(spark, sf_dir).drop("z")
    return ponds.seeds(cells).where("sure").select("i", "j")


def muddy_seed(spark, sf_dir):
    cells = raster.full_grid(views.px_grid(spark, sf_dir)).withColumns({c: F.coalesce(c, F.lit(0)) for c in RGB})
    std = raster.focal_std(cells, color.brightness(*map(F.col, RGB)), 4)
    # the views' noise is stronger than that of water, so the deviation has a wider bound here
    return cells.join(std, ["job_id", "i", "j"]).where(ponds.muddy(F.col("std") / 4, *map(F.col, RGB))).select("i", "j")


def red_cells(spark, sf_dir):
    return views.px_grid(spark, sf_dir).where("r > 150")


def components4(spark, sf_dir):
    return ponds.blobs(red_cells(spark, sf_dir)).select("i", "j", "blob_i", "blob_j")


def red_members(spark, sf_dir):
    lit = stored(red_cells(spark, sf_dir), "red-cells")
    cells = lit.join(ponds.blobs(lit), ["job_id", "i", "j"])
    return cells.withColumns({"bright": color.brightness(*map(F.col, RGB)).cast("double"), "sure": F.col("b") > 200})


def blob_stats(spark, sf_dir):
    return ponds.blob_stats(red_members(spark, sf_dir)).drop("job_id", "med_finite")


def blob_filters(spark, sf_dir):
    stats = ponds.blob_stats(red_members(spark, sf_dir))
    return stats.where((F.col("size") >= 3) & (F.col("size") / (F.col("height") * F.col("width")) >= 0.4)).select("blob_i", "blob_j", "size")


def ring_depression(spark, sf_dir):
    cells = views.px_grid(spark, sf_dir).withColumn("inside", F.col("g") > 60)
    return ponds.rings(red_members(spark, sf_dir), cells).drop("job_id")


def coverage_cap(spark, sf_dir):
    """Blobs by size, at most a tenth of the red cells in all."""
    stats = stored(ponds.blob_stats(red_members(spark, sf_dir)).withColumn("score", F.col("med_g")), "red-blobs")
    total = stats.agg(F.sum("size").alias("total"))
    found = stats.crossJoin(F.broadcast(total))  # one row
    return ponds.capped(found, F.rint(F.col("total") * F.lit(0.1))).drop("job_id")


def detect_ponds(spark, sf_dir):
    """The whole search over px_grid, its colours drawn together so that it has even regions."""
    cells = stored(raster.full_grid(stored(views.px_grid(spark, sf_dir), "image")), "whole-image").withColumns({c: F.coalesce(c, F.lit(0)) for c in RGB})
    low = (F.pow(F.col("i") - 30, F.lit(2)) + F.pow(F.col("j") % 100 - 5, F.lit(2))) < 40
    shown = cells.select("job_id", "i", "j", *[F.when(low, F.lit(v)).otherwise(F.lit(w) + F.col(c) % 5).cast("int").alias(c) for c, v, w in (("r", 12, 92), ("g", 22, 118), ("b", 38, 58))], F.when(low, F.lit(10.0)).otherwise(F.lit(20.0) + F.coalesce("z", F.lit(0.0)) / 10).alias("z"))
    return ponds.detect(shown).select("i", "j", "blob_i", "blob_j", F.round("score", 4).alias("score"))


def pond_outlines(spark, sf_dir):
    found = stored(detect_ponds(spark, sf_dir).withColumn("job_id", F.lit("px")), "ponds")
    shape = shapes.outlines(found)
    return shape.select("ord", "source", F.size("ring").alias("n_corners"), F.to_json("ring").alias("ring"))


QUERIES = {
    f.__name__: f
    for f in (
        rgb_to_hsv, filament_name, hex_rgb, slugify, rgb_to_lab, lab_mean_base, nearest_palette, palette_coverage, merge_base, force_mask, palette_rank, refine_palette,
        palette_entries, median_cut, kmeans_accents, recommend_palette, preview_quantized, water_predicate, dark_open_seed, muddy_seed, components4, blob_stats, blob_filters,
        ring_depression, coverage_cap, detect_ponds, pond_outlines,
    )
}


def hsv_sql(source: str) -> str:
    """source (with r, g, b) and h, s, v."""
    return f"""(SELECT * EXCLUDE (nr, ng, nb, hi, lo, t), CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN t < 0 THEN fmod(fmod(t, 1) + 1, 1) ELSE fmod(t, 1) END AS h,
        CASE WHEN hi = 0 THEN 0.0::DOUBLE ELSE (hi - lo) / hi END AS s, hi AS v, greatest(r, g, b) AS mx
        FROM (SELECT *, CASE WHEN nr = hi THEN (ng - nb) / (hi - lo) WHEN ng = hi THEN 2 + (nb - nr) / (hi - lo) ELSE 4 + (nr - ng) / (hi - lo) END / 6 AS t
        FROM (SELECT *, greatest(nr, ng, nb) AS hi, least(nr, ng, nb) AS lo FROM (SELECT *, r / 255::DOUBLE AS nr, g / 255::DOUBLE AS ng, b / 255::DOUBLE AS nb FROM {source}))))"""


NAME = """CASE WHEN s < 0.12 THEN CASE WHEN v > 0.62 THEN 'Light Gray' ELSE 'Gray' END
    WHEN h BETWEEN 0.50 AND 0.72 THEN CASE WHEN v < 0.55 THEN 'Water Blue' ELSE 'Blue' END
    WHEN h >= 0.20 AND h < 0.50 THEN CASE WHEN v < 0.42 THEN 'Forest Green' ELSE 'Green' END
    WHEN h >= 0.05 AND h < 0.20 THEN CASE WHEN v < 0.45 THEN 'Brown' ELSE 'Tan' END
    WHEN h < 0.05 OR h > 0.92 THEN CASE WHEN v < 0.5 THEN 'Rust' ELSE 'Red' END ELSE 'Green' END"""


def lab_sql(source: str) -> str:
    """source (with r, g, b) and la, aa, ba."""
    lin = lambda c: f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"
    xyz = ", ".join(f"(lr * {m[0]} + lg * {m[1]} + lb * {m[2]}) / {w} AS t{n}" for n, m, w in zip("xyz", color.TO_XYZ, color.WHITE, strict=True))
    f = ", ".join(f"CASE WHEN t{n} > 0.008856 THEN cbrt(t{n}) ELSE 7.787 * t{n} + 16.0 / 116.0 END AS f{n}" for n in "xyz")
    return f"""(SELECT * EXCLUDE (lr, lg, lb, tx, ty, tz, fx, fy, fz), 116 * fy - 16 AS la, 500 * (fx - fy) AS aa, 200 * (fy - fz) AS ba
        FROM (SELECT *, {f} FROM (SELECT *, {xyz} FROM (SELECT *, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb FROM {source}))))"""


def rgb_sql(source: str) -> str:
    """r, g, b of la, aa, ba in source."""
    inv = lambda t: f"CASE WHEN {t} > 0.2068966 THEN pow({t}, 3) ELSE ({t} - 16.0 / 116.0) / 7.787 END"
    lin = ", ".join(f"x * {m[0]} + y * {m[1]} + z * {m[2]} AS l{n}" for n, m in zip("rgb", color.FROM_XYZ, strict=True))
    out = ", ".join(f"CAST(round_even(greatest(0, least(1, CASE WHEN l{n} > 0.0031308 THEN 1.055 * pow(l{n}, 1 / 2.4) - 0.055 ELSE l{n} * 12.92 END)) * 255, 0) AS INT) AS {n}" for n in "rgb")
    return f"""(SELECT * EXCLUDE (lr, lg, lb, x, y, z, ty), {out} FROM (SELECT *, {lin} FROM (SELECT *,
        {inv('(ty + aa / 500)')} * {color.WHITE[0]} AS x, {inv('ty')} * {color.WHITE[1]} AS y, {inv('greatest(ty - ba / 200, 0)')} * {color.WHITE[2]} AS z
        FROM (SELECT *, (la + 16) / 116 AS ty FROM {source}))))"""


PALETTE = "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(COLORS)) + ") AS p(index, r, g, b)"
#: Distinct colours with the index of the nearest swatch and its Lab values.
NEAR = f"""pal AS (SELECT * FROM {lab_sql(f'(SELECT * FROM {PALETTE})')}),
    dist AS (SELECT c.r, c.g, c.b, p.index, p.la, p.aa, p.ba, row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY (c.la - p.la) ** 2 + (c.aa - p.aa) ** 2 + (c.ba - p.ba) ** 2, p.index) AS k
        FROM {lab_sql('(SELECT DISTINCT r, g, b FROM li)')} c, pal p),
    near AS (SELECT r, g, b, index AS label, la, aa, ba FROM dist WHERE k = 1)"""
COVER = """cover AS (SELECT p.index, p.r, p.g, p.b, CAST(count(n.label) AS BIGINT) AS n_pixels, round(100.0 * count(n.label) / (SELECT count(*) FROM li), 2) AS coverage_pct
    FROM pal p LEFT JOIN (SELECT label FROM li JOIN near USING (r, g, b)) n ON n.label = p.index GROUP BY ALL)"""
SLUG = "coalesce(nullif(trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'color')"
WATER = """((h BETWEEN 0.38 AND 0.75 AND s >= 0.05 AND v >= 0.08) OR mx < 36 OR (v < 0.30 AND b >= r - 6 AND g + b > r + 6)
    OR (s < 0.36 AND v BETWEEN 0.22 AND 0.85 AND ({0})))"""
#: Red cells of px with the root of their component, i * 100000 + j.
COMP = """red AS (SELECT *, i * 100000 + j AS id FROM px WHERE r > 150),
    walk(id, root) AS (SELECT id, id FROM red UNION SELECT n.id, w.root FROM walk w JOIN red c ON c.id = w.id JOIN red n ON abs(n.i - c.i) + abs(n.j - c.j) = 1),
    comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
    member AS (SELECT red.*, root // 100000 AS blob_i, root % 100000 AS blob_j, greatest(r, g, b) AS bright FROM red JOIN comp USING (id))"""
BLOBS = """blob AS (SELECT CAST(blob_i AS INT) AS blob_i, CAST(blob_j AS INT) AS blob_j, count(*) AS size, max(i) - min(i) + 1 AS height, max(j) - min(j) + 1 AS width,
    median(r) AS med_r, median(g) AS med_g, median(b) AS med_b, median(bright) AS med_bright, median(z) AS med_z, bool_or(b > 200) AS sure FROM member GROUP BY 1, 2)"""


def recursive(names: str, rest: str) -> str:
    return sql(names, rest).replace("WITH ", "WITH RECURSIVE ", 1)


SQL = {
    "rgb_to_hsv": sql("li", f"SELECT r, g, b, round(h, 9) AS h, round(s, 9) AS s, round(v, 9) AS v FROM {hsv_sql('(SELECT DISTINCT r, g, b FROM li)')}"),
    "filament_name": sql("li", f"SELECT r, g, b, {NAME} AS name FROM {hsv_sql('(SELECT DISTINCT r, g, b FROM li)')}"),
    "hex_rgb": sql("li", "SELECT DISTINCT r, g, b, printf('#%02X%02X%02X', r, g, b) AS hex, printf('#%02X%02X%02XFF', r, g, b) AS hex_rgba FROM li"),
    "slugify": "SELECT p_partkey, " + SLUG.format("'  ' || p_name || '--' || p_brand") + " AS slug FROM part",
    "rgb_to_lab": sql("li", f"SELECT r, g, b, round(la, 5) AS lab_l, round(aa, 5) AS lab_a, round(ba, 5) AS lab_b FROM {lab_sql('(SELECT DISTINCT r, g, b FROM li)')}"),
    "lab_mean_base": sql("li", f"SELECT r, g, b FROM {rgb_sql('(SELECT avg(la) AS la, avg(aa) AS aa, avg(ba) AS ba FROM ' + lab_sql('li') + ')')}"),
    "nearest_palette": sql("li", f", {NEAR} SELECT r, g, b, label FROM near"),
    "palette_coverage": sql("li", f", {NEAR}, {COVER} SELECT index, r, g, b, n_pixels, coverage_pct FROM cover"),
    "merge_base": sql("li", f", {NEAR} SELECT n.r, n.g, n.b, CASE WHEN (n.la - p.la) ** 2 + (n.aa - p.aa) ** 2 + (n.ba - p.ba) ** 2 <= 3025 THEN 0 ELSE label END AS label FROM near n, pal p WHERE p.index = 0"),
    "force_mask": sql("li", f", {NEAR} SELECT r, g, b, CASE WHEN g > 200 THEN 3 ELSE label END AS label FROM near"),
    "palette_rank": sql("li", f""", {NEAR}, {COVER}, e AS (SELECT *, CASE index WHEN 0 THEN 'base' WHEN 1 THEN 'pond' ELSE 'land' END AS role, CASE index WHEN 0 THEN 'Base' WHEN 1 THEN 'Pond' ELSE {NAME} END AS name FROM {hsv_sql('cover')}),
        k AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE role WHEN 'base' THEN 0 WHEN 'pond' THEN 1 ELSE 2 END, -coverage_pct, index) AS INT) AS rank FROM e)
        SELECT rank - 1 AS index, role, name, printf('%02d_', rank) || CASE WHEN role = 'land' THEN {SLUG.format('name')} ELSE role END AS part_name, coverage_pct FROM k"""),
    "refine_palette": sql("li", f""", {NEAR}, m AS (SELECT n.label AS index, avg(x.la) AS la, avg(x.aa) AS aa, avg(x.ba) AS ba FROM {lab_sql('li')} x JOIN near n USING (r, g, b) GROUP BY 1),
        q AS (SELECT index, r, g, b FROM {rgb_sql('m')}) SELECT p.index, coalesce(q.r, p.r) AS r, coalesce(q.g, p.g) AS g, coalesce(q.b, p.b) AS b FROM pal p LEFT JOIN q USING (index)"""),
    "palette_entries": sql("li", f""", {NEAR}, {COVER}, e AS (SELECT *, CASE index WHEN 0 THEN 'base' ELSE 'land' END AS role, CASE index WHEN 0 THEN 'Base' ELSE {NAME} END AS name FROM {hsv_sql('cover')}),
        k AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE role WHEN 'base' THEN 0 ELSE 2 END, -coverage_pct, index) AS INT) AS rank FROM e)
        SELECT rank - 1 AS index, printf('#%02X%02X%02X', r, g, b) AS hex, name, role, printf('%02d_', rank) || CASE WHEN role = 'land' THEN {SLUG.format('name')} ELSE role END AS part_name, coverage_pct FROM k"""),
    "preview_quantized": sql("li px", f", {NEAR.replace('FROM li)', 'FROM px)')} SELECT i, j, p.r, p.g, p.b, 255 AS a FROM px c JOIN near n USING (r, g, b) JOIN pal p ON p.index = n.label"),
    "water_predicate": sql("px", f"""SELECT i, j, {WATER.format('true')} AS water, {WATER.format('b >= r - 4 AND g + b > r + 8')} AS strict,
        mx >= 118 AND v >= 0.52 AND s < 0.36 AND NOT (r > g + 28 AND r > b + 18) AND NOT g > r + 35 AND abs(r - g) <= 32 AND abs(g - b) <= 32 AS pale FROM {hsv_sql('px')}"""),
    "muddy_seed": sql("px", f""", {PX_FULL}, lum AS (SELECT i, j, coalesce(greatest(r, g, b), 0) AS v FROM full_px), {square(4, 's.v', 'lum')}
        SELECT i, j FROM sums JOIN (SELECT i, j, coalesce(greatest(r, g, b), 0) AS hi, coalesce(least(r, g, b), 0) AS lo FROM full_px) USING (i, j)
        WHERE sqrt(greatest(q - m * m, 0)) / 4 <= 10 AND (hi - lo) / greatest(hi, 1) <= 0.36 AND hi BETWEEN 40 AND 215"""),
    "dark_open_seed": sql("px", """, l AS (SELECT *, greatest(r, g, b) AS bright FROM px), c AS (SELECT least(quantile_cont(bright, 0.05) + 3, 45) AS cut FROM l)
        SELECT i, j FROM l, c WHERE bright <= cut OR (b > r + 3 AND g > r + 2 AND bright BETWEEN 20 AND 100)"""),
    "components4": recursive("px", f", {COMP} SELECT i, j, CAST(blob_i AS INT) AS blob_i, CAST(blob_j AS INT) AS blob_j FROM member"),
    "blob_stats": recursive("px", f", {COMP}, {BLOBS} SELECT * FROM blob"),
    "blob_filters": recursive("px", f", {COMP}, {BLOBS} SELECT blob_i, blob_j, size FROM blob WHERE size >= 3 AND size / (height * width) >= 0.4"),
    "ring_depression": recursive("px", f""", {COMP}, d AS (SELECT unnest(range(-2, 3)) AS d),
        near AS (SELECT DISTINCT blob_i, blob_j, i + a.d AS i, j + b.d AS j FROM member, d a, d b WHERE abs(a.d) + abs(b.d) <= 2),
        ring AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.i = n.i AND m.j = n.j AND m.blob_i = n.blob_i AND m.blob_j = n.blob_j))
        SELECT CAST(blob_i AS INT) AS blob_i, CAST(blob_j AS INT) AS blob_j, median(z) AS ring_z FROM ring JOIN px USING (i, j) WHERE g > 60 GROUP BY 1, 2"""),
    "coverage_cap": recursive("px", f""", {COMP}, {BLOBS}, o AS (SELECT *, row_number() OVER (ORDER BY -med_g, blob_i, blob_j) AS k FROM blob), t AS (SELECT round_even(sum(size) * 0.1, 0) AS most FROM blob),
        fold AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, false AS kept UNION ALL SELECT o.k, CASE WHEN used + size <= most THEN used + size ELSE used END, used + size <= most FROM fold, t, o WHERE o.k = fold.k + 1)
        SELECT blob_i, blob_j FROM fold JOIN o USING (k) WHERE kept"""),
}
