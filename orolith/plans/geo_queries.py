"""Registered queries on projections, tiles, catalogues, names, boundaries and jobs, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orolith.functions import geo, names
from orolith.operators import jobs
from orolith.sources import boundaries, imagery, views
from orolith.sources.views import sql, table
from orolith.storage import shared_dir
from orolith.streaming import progress

#: A time after all events for expiry, and how long things last there.
NOW_AFTER, TERMS = 43_200.0, jobs.Lifecycle(max_runtime=30_000.0, ttl=70_000.0, stale=50_000.0)


def places(spark, sf_dir):
    """(c_custkey, lon, lat) spread over the globe by customer."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((key * 37) % 36000 / 100.0 - 180.0).alias("lon"), ((key * 53) % 16000 / 100.0 - 80.0).alias("lat"))


PLACES = "places AS (SELECT c_custkey, (c_custkey * 37) % 36000 / 100.0 - 180.0 AS lon, (c_custkey * 53) % 16000 / 100.0 - 80.0 AS lat FROM customer)"


def utm_zone(spark, sf_dir):
    return places(spark, sf_dir).select("c_custkey", geo.utm_epsg(F.col("lon"), F.col("lat")).cast("int").alias("epsg"))


def utm_project(spark, sf_dir):
    p = geo.utm(F.col("lon"), F.col("lat"), geo.utm_epsg(F.col("lon"), F.col("lat")))
    return places(spark, sf_dir).select("c_custkey", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"))


def utm_round_trip(spark, sf_dir):
    epsg = geo.utm_epsg(F.col("lon"), F.col("lat"))
    there = places(spark, sf_dir).select("c_custkey", epsg.alias("epsg"), geo.utm(F.col("lon"), F.col("lat"), epsg).alias("p"))
    back = there.select("c_custkey", geo.lonlat(F.col("p.x"), F.col("p.y"), F.col("epsg")).alias("q"))
    return back.select("c_custkey", F.round("q.x", 7).alias("lon"), F.round("q.y", 7).alias("lat"))


def grid_dims(spark, sf_dir):
    key = F.col("s_suppkey")
    size = geo.grid_size(F.lit(0.0), F.lit(0.0), (key * 17 % 911 + 1).cast("double"), (key * 29 % 997 + 1).cast("double"), (key * 41 % 2500).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", size.alias("s")).select("s_suppkey", "s.width", "s.height")


def boxes(spark, sf_dir):
    key = F.col("s_suppkey")
    west, south = key % 300 - 150.0, key % 120 - 60.0
    wide = F.lit(0.002) * (key % 23 + 1)
    return table(spark, sf_dir, "supplier").select(key.cast("string").alias("job_id"), "s_suppkey", west.alias("west"), south.alias("south"), (west + wide).alias("east"), (south + wide * 0.75).alias("north"))


BOXES = "boxes AS (SELECT s_suppkey, s_suppkey % 300 - 150.0::DOUBLE AS west, s_suppkey % 120 - 60.0::DOUBLE AS south, s_suppkey % 300 - 150.0::DOUBLE + 0.002::DOUBLE * (s_suppkey % 23 + 1) AS east, s_suppkey % 120 - 60.0::DOUBLE + 0.002::DOUBLE * (s_suppkey % 23 + 1) * 0.75::DOUBLE AS north FROM supplier)"


def pick_zoom(spark, sf_dir):
    return boxes(spark, sf_dir).select("s_suppkey", geo.pick_zoom(F.col("west"), F.col("south"), F.col("east"), F.col("north"), 100).cast("int").alias("zoom"))


def tile_cover(spark, sf_dir):
    return imagery.cover(boxes(spark, sf_dir), 100, ["s_suppkey"]).select("s_suppkey", F.col("z").cast("int").alias("z"), "x", "y")


def tms_flip(spark, sf_dir):
    tiles = imagery.cover(boxes(spark, sf_dir), 25, ["s_suppkey"])
    return imagery.addresses(tiles, "oam", "tiles/").select("s_suppkey", "x", geo.tms_row(F.col("z"), F.col("y")).alias("tms_y"), "url")


def oam_items(spark, sf_dir):
    """Catalogue entries made of events, a few of them for each box."""
    n = F.col("event_id")
    uuid_ = F.when(n % 3 == 0, F.concat(F.lit("https://host/"), n.cast("string"), F.lit(".TIF"))).when(n % 3 == 1, F.concat(F.lit("s3://host/"), n.cast("string"), F.lit(".tif")))
    tms = F.when(n % 5 == 0, F.concat(F.lit("https://t/"), n.cast("string"), F.lit("/{z}/{x}/{y}.png"))).when(n % 5 == 1, F.lit("https://t/{z}/{x}"))
    west, south = n % 300 - 150, n % 120 - 60
    ring = lambda dx, dy: F.array((west + dx).cast("double"), (south + dy).cast("double"))
    shape = F.when(n % 7 != 0, F.struct(F.lit("Polygon").alias("type"), F.array(F.array(ring(0, 0), ring(0, 1), ring(1, 1), ring(0, 0))).alias("coordinates")))
    gsd = F.when(n % 4 == 0, F.round(F.col("value") / 10, 3).cast("string")).when(n % 4 == 1, F.lit("n/a"))
    item = F.to_json(F.struct(uuid_.alias("uuid"), gsd.alias("gsd"), shape.alias("geojson"), F.struct(tms.alias("tms"), F.when(n % 4 == 2, (n % 50).cast("string")).alias("resolution_in_meters")).alias("properties")))
    return table(spark, sf_dir, "events").select((n % 40 + 1).cast("string").alias("job_id"), n.alias("ord"), item.alias("item"))


def oam_rank(spark, sf_dir):
    entries = imagery.catalogue(oam_items(spark, sf_dir))
    at = boxes(spark, sf_dir).drop("s_suppkey")
    return imagery.pick_sources(entries, at)


def basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.export_basename(F.col("url")).alias("basename"), names.download_name(names.export_basename(F.col("url")), "_print.3mf").alias("download"))


def parse_flags(spark, sf_dir):
    words = [F.lit(w) for w in ("1", " Yes", "off", "", "FALSE", "maybe", "on", "no")]
    key = F.col("p_partkey")
    pick = lambda k: F.element_at(F.array(*words), ((key * k) % 8 + 1).cast("int"))
    form = F.map_from_arrays(F.array(F.lit("export_preview_glb"), F.lit("export_print_stl"), F.lit("export_print_ams")), F.array(pick(3), pick(5), pick(7)))
    out = names.export_options(form)
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("o")).select("p_partkey", "o.*")


def settings(spark, sf_dir):
    """Free text as settings: sensitivity, quality and palette size."""
    p = table(spark, sf_dir, "part")
    word = F.element_at(F.split("p_type", " "), 1)
    return p.select("p_partkey", names.pond_sensitivity(F.when(F.col("p_size") % 3 == 0, F.lit(" Aggressive ")).otherwise(word)).alias("sensitivity"), names.ams_quality(F.when(F.col("p_size") % 2 == 0, F.lit("HIGH")).otherwise(word)).alias("quality"), names.palette_size(F.when(F.col("p_size") % 5 == 0, word).otherwise((F.col("p_size") - 5).cast("string"))).alias("n_colors"))


def latest_progress(spark, sf_dir):
    return jobs.latest(views.job_progress(spark, sf_dir)).select("job_id", "status", "percent", F.round("started_at", 3).alias("started_at"), F.round("updated_at", 3).alias("updated_at"))


def expired_jobs(spark, sf_dir):
    last = jobs.latest(views.job_progress(spark, sf_dir))
    end = last.agg((F.max("updated_at") + F.lit(NOW_AFTER)).alias("now"))
    active = last.where("job_id LIKE '%7'").select("job_id")
    return jobs.expired(last.crossJoin(F.broadcast(end)).withColumn("seen", F.col("updated_at")), F.col("now"), TERMS, active)  # end has one row


def progress_history(spark, sf_dir):
    return jobs.written(views.job_progress(spark, sf_dir)).select("event_id", "job_id", "percent", F.round("started_at", 3).alias("started_at"))


def kml_texts(spark, sf_dir):
    """Boundary files made of customers: two polygons each, one of them with a hole."""
    key = F.col("c_custkey")
    lon, lat = key % 340 - 170, key % 140 - 70
    def ring(size):
        corners = [(0, 0), (size, 0), (size, size), (0, size), (0, 0)]
        return F.concat_ws(" ", *[F.concat_ws(",", (lon + F.lit(dx / 100)).cast("string"), (lat + F.lit(dy / 100)).cast("string"), F.lit("0")) for dx, dy in corners])

    part = lambda size, hole: F.concat(F.lit("<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>\n"), ring(size), F.lit("\n</coordinates></LinearRing></outerBoundaryIs>" + ("<innerBoundaryIs><LinearRing><coordinates>0,0 1,1 2,0</coordinates></LinearRing></innerBoundaryIs>" if hole else "") + "</Polygon></Placemark>"))
    text = F.concat(F.lit('<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), part(2, False), part(5, True), F.lit("</Document></kml>"))
    return table(spark, sf_dir, "customer").select(key.cast("string").alias("job_id"), text.alias("text"))


def kml_parse(spark, sf_dir):
    best = boundaries.boundaries(kml_texts(spark, sf_dir))
    first = F.get("ring", 0)
    return best.select("job_id", F.size("ring").alias("n_corners"), F.round("area", 8).alias("area"), F.round(first["x"], 6).alias("x"), F.round(first["y"], 6).alias("y"))


def boundary_grid(spark, sf_dir):
    best = boundaries.boundaries(kml_texts(spark, sf_dir))
    return boundaries.grids(boundaries.projected(best)).select("job_id", "epsg", "width", "height", *[F.round(c, 3).alias(c) for c in ("west", "south", "east", "north")])


def geojson_export(spark, sf_dir):
    return boundaries.boundaries(kml_texts(spark, sf_dir)).select("job_id", boundaries.geojson(F.col("ring")).alias("geojson"))


def progress_stream(spark, sf_dir):
    """Progress events written as files, read as a stream, and the rows that tracking gives."""
    source = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    views.job_progress(spark, sf_dir).write.json(source)
    name = f"progress_{uuid.uuid4().hex}"
    target = f"{shared_dir(spark)}/{name}"
    query = progress.track(progress.events(spark, source)).writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{target}/batch={k}")).outputMode("update").option("checkpointLocation", f"{target}-state").trigger(once=True).start()
    query.awaitTermination()
    rows = spark.read.schema("job_id string, status string, percent int, started_at double, updated_at double, batch int").parquet(target)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "percent", "started_at", "updated_at"), "batch").alias("s")).select("job_id", "s.*")


QUERIES = {
    f.__name__: f
    for f in (
        utm_zone, utm_project, utm_round_trip, grid_dims, pick_zoom, tile_cover, tms_flip, oam_rank, basename, parse_flags, settings, latest_progress, expired_jobs,
        progress_history, kml_parse, boundary_grid, geojson_export, progress_stream,
    )
}

X = "(({lon} + 180) / 360 * 2 ** {z})"
Y = "((0.5 - ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / 12.566370614359172) * 2 ** {z})"
EPSG = "CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, CAST(floor((lon + 180) / 6) AS INT) + 1))"


def tiles_sql(z: str) -> str:
    x = lambda c: f"CAST(floor({X.format(lon=c, z=z)}) AS BIGINT)"
    y = lambda c: f"CAST(floor({Y.format(lat=c, z=z)}) AS BIGINT)"
    return f"{x('west')} AS x0, {x('east')} AS x1, {y('north')} AS y0, {y('south')} AS y1"


def zoom_sql(most: int) -> str:
    return f"""{BOXES}, level AS (SELECT s_suppkey, z, {tiles_sql('z')} FROM boxes, (SELECT unnest(range(9, 19)) AS z)),
    zoom AS (SELECT s_suppkey, coalesce(max(z) FILTER (WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= {most} AND z >= 10), 9) AS z FROM level GROUP BY 1),
    tiles AS (SELECT l.s_suppkey, CAST(l.z AS INT) AS z, tx AS x, ty AS y FROM level l JOIN zoom USING (s_suppkey, z), unnest(range(x0, x1 + 1)) a(tx), unnest(range(y0, y1 + 1)) b(ty))"""


def utm_sql() -> str:
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    radius = geo.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * geo.SCALE
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = 2 * n**0.5 / (1 + n)
    xs = " + ".join(f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(alpha, 1))
    ys = " + ".join(f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(alpha, 1))
    return f"""WITH {PLACES}, z AS (SELECT *, {EPSG} AS epsg FROM places), a AS (SELECT *, radians(lat) AS phi, radians(lon - ((epsg % 100) * 6 - 183)) AS lam FROM z),
    b AS (SELECT *, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) AS t FROM a),
    c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b)
    SELECT c_custkey, round(500000 + {radius!r} * (eta + {xs}), 3) AS x, round(CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END + {radius!r} * (xi + {ys}), 3) AS y FROM c"""


FLAG = "CASE WHEN {v} IS NULL THEN {d} WHEN lower(trim({v})) IN ('', '0', 'false', 'off', 'no') THEN false WHEN lower(trim({v})) IN ('1', 'true', 'on', 'yes') THEN true ELSE {d} END"
WORDS = "['1', ' Yes', 'off', '', 'FALSE', 'maybe', 'on', 'no']"
LAST = """last AS (SELECT job_id, arg_max(status, (updated_at, event_id)) AS status, CAST(greatest(0, least(100, arg_max(percent, (updated_at, event_id)))) AS INT) AS percent, min(updated_at) AS started_at, max(updated_at) AS updated_at FROM jobs GROUP BY 1)"""
KML = "k AS (SELECT c_custkey, c_custkey % 340 - 170 AS lon, c_custkey % 140 - 70 AS lat FROM customer)"
STEM = "regexp_extract(url, '([^/\\\\]*)$', 1)"
BASE = f"""b AS (SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(CASE WHEN regexp_matches({STEM}, '^.+\\.[^.]*$') THEN regexp_extract({STEM}, '^(.+)\\.[^.]*$', 1) ELSE {STEM} END, '[^A-Za-z0-9_.-]+', '_', 'g'), '._-'), 1, 120), ''), 'terrain') AS basename FROM pages)"""

SQL = {
    "utm_zone": f"WITH {PLACES} SELECT c_custkey, CAST({EPSG} AS INT) AS epsg FROM places",
    "utm_project": utm_sql(),
    "utm_round_trip": f"WITH {PLACES} SELECT c_custkey, round(CAST(lon AS DOUBLE), 7) AS lon, round(CAST(lat AS DOUBLE), 7) AS lat FROM places",
    "grid_dims": """WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 17 % 911 + 1 AS DOUBLE) AS w, CAST(s_suppkey * 29 % 997 + 1 AS DOUBLE) AS h, CAST(greatest(64, least(2048, s_suppkey * 41 % 2500)) AS INT) AS cap FROM supplier)
        SELECT s_suppkey, CASE WHEN w >= h THEN cap ELSE greatest(64, CAST(round_even(cap * (w / h), 0) AS INT)) END AS width, CASE WHEN w >= h THEN greatest(64, CAST(round_even(cap * (h / w), 0) AS INT)) ELSE cap END AS height FROM s""",
    "pick_zoom": f"WITH {zoom_sql(100)} SELECT s_suppkey, CAST(z AS INT) AS zoom FROM zoom",
    "tile_cover": f"WITH {zoom_sql(100)} SELECT s_suppkey, z, x, y FROM tiles",
    "tms_flip": f"WITH {zoom_sql(25)} SELECT s_suppkey, x, (1::BIGINT << z) - 1 - y AS tms_y, 'tiles/' || z || '/' || x || '/' || ((1::BIGINT << z) - 1 - y) || '.png' AS url FROM tiles",
    "oam_rank": f"""WITH {BOXES}, n AS (SELECT event_id AS n, value FROM events), e AS (SELECT CAST(n % 40 + 1 AS VARCHAR) AS job_id, n AS ord,
        CASE WHEN n % 4 = 0 THEN round(value / 10, 3) WHEN n % 4 = 2 THEN n % 50 ELSE 999.0 END AS gsd,
        CASE WHEN n % 3 = 0 THEN 'https://host/' || n || '.TIF' END AS tif, CASE WHEN n % 5 = 0 THEN 'https://t/' || n || '/{{z}}/{{x}}/{{y}}.png' END AS tms,
        CASE WHEN n % 7 <> 0 THEN n % 300 - 150 END AS ew, CASE WHEN n % 7 <> 0 THEN n % 120 - 60 END AS es FROM n),
        m AS (SELECT e.*, coalesce(ew <= east AND ew + 1 >= west AND es <= north AND es + 1 >= south, false) AS over FROM e JOIN boxes ON CAST(s_suppkey AS VARCHAR) = e.job_id),
        f AS (SELECT *, bool_or(over) OVER (PARTITION BY job_id) AS any_over FROM m), k AS (SELECT *, CASE WHEN any_over THEN gsd ELSE 0 END AS g FROM f WHERE over OR NOT any_over)
        SELECT job_id, arg_min(tif, (g, ord)) FILTER (WHERE tif IS NOT NULL) AS tif, arg_min(tms, (g, ord)) FILTER (WHERE tms IS NOT NULL) AS tms FROM k GROUP BY 1""".replace("{{", "{").replace("}}", "}"),
    "basename": f"WITH {BASE} SELECT page_id, basename, basename || '_print.3mf' AS download FROM b",
    "parse_flags": f"""WITH w AS (SELECT p_partkey, {WORDS}[(p_partkey * 3) % 8 + 1] AS a, {WORDS}[(p_partkey * 5) % 8 + 1] AS b, {WORDS}[(p_partkey * 7) % 8 + 1] AS c FROM part),
        f AS (SELECT p_partkey, {FLAG.format(v='a', d='false')} AS preview_glb, false AS preview_obj, {FLAG.format(v='b', d='true')} AS print_stl, false AS print_3mf, false AS print_textured_glb, false AS print_pieces, {FLAG.format(v='c', d='true')} AS print_ams, false AS print_ams_glb, false AS quad_mask FROM w)
        SELECT *, print_stl OR print_ams AS needs_print_solid, print_ams AS needs_ams FROM f""",
    "settings": """WITH w AS (SELECT p_partkey, p_size, split_part(p_type, ' ', 1) AS word FROM part),
        t AS (SELECT p_partkey, lower(trim(CASE WHEN p_size % 3 = 0 THEN 'Aggressive' ELSE word END)) AS s, lower(CASE WHEN p_size % 2 = 0 THEN 'HIGH' ELSE word END) AS q, TRY_CAST(CASE WHEN p_size % 5 = 0 THEN word ELSE CAST(p_size - 5 AS VARCHAR) END AS INT) AS n FROM w)
        SELECT p_partkey, CASE WHEN s IN ('conservative', 'balanced', 'aggressive') THEN s ELSE 'conservative' END AS sensitivity, CASE WHEN q IN ('high', 'medium', 'low') THEN q ELSE 'medium' END AS quality, greatest(2, least(8, coalesce(n, 4))) AS n_colors FROM t""",
    "latest_progress": sql("jobs", f", {LAST} SELECT job_id, status, percent, round(started_at, 3) AS started_at, round(updated_at, 3) AS updated_at FROM last"),
    "expired_jobs": sql("jobs", f""", {LAST}, t AS (SELECT max(updated_at) + {NOW_AFTER} AS now FROM last)
        SELECT job_id FROM last, t WHERE job_id NOT LIKE '%7' AND CASE WHEN status IN ('done', 'error') THEN now - updated_at >= {TERMS.ttl} WHEN status = 'running' THEN now - updated_at >= {TERMS.stale} OR now - started_at >= {TERMS.max_runtime} ELSE false END"""),
    "progress_history": sql("jobs", "SELECT event_id, job_id, CAST(greatest(0, least(100, percent)) AS INT) AS percent, round(min(updated_at) OVER (PARTITION BY job_id), 3) AS started_at FROM jobs"),
    "kml_parse": f"WITH {KML} SELECT CAST(c_custkey AS VARCHAR) AS job_id, 4 AS n_corners, round(CAST(0.0025 AS DOUBLE), 8) AS area, round(CAST(lon AS DOUBLE), 6) AS x, round(CAST(lat AS DOUBLE), 6) AS y FROM k",
    "geojson_export": f"""WITH {KML}, p AS (SELECT c_custkey, n, CAST(lon + dx AS VARCHAR) || ',' || CAST(lat + dy AS VARCHAR) AS xy
        FROM k, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.05, 0.0), (2, 0.05, 0.05), (3, 0.0, 0.05), (4, 0.0, 0.0)) AS t(n, dx, dy))
        SELECT CAST(c_custkey AS VARCHAR) AS job_id, '{{"type":"Polygon","coordinates":[[' || string_agg('[' || xy || ']', ',' ORDER BY n) || ']]}}' AS geojson FROM p GROUP BY c_custkey""",
    "progress_stream": sql("jobs", f", {LAST} SELECT job_id, status, percent, started_at, updated_at FROM last"),
}
