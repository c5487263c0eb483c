"""Map projection, grid and web-tile arithmetic, and plane geometry, as Column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid and the UTM scale and false easting and northing.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EASTING, NORTHING = 0.9996, 500_000.0, 10_000_000.0
MERCATOR_EDGE = 20037508.342789244


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((lon + F.lit(180.0)) / F.lit(6.0)) + 1).cast("int")))
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone


def utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """Struct (x, y): transverse Mercator by the Krueger series up to the fourth order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    centre = (epsg % 100) * 6 - 183
    phi, lam = F.radians(lat), F.radians(lon - centre)
    e = 2 * sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for k, a in enumerate(alpha, 1):
        x = x + F.lit(a) * F.cos(F.lit(2.0 * k) * xi) * F.sinh(F.lit(2.0 * k) * eta)
        y = y + F.lit(a) * F.sin(F.lit(2.0 * k) * xi) * F.cosh(F.lit(2.0 * k) * eta)
    south = F.when(epsg >= 32700, F.lit(NORTHING)).otherwise(F.lit(0.0))
    return F.struct((F.lit(EASTING) + F.lit(SCALE * radius) * x).alias("x"), (south + F.lit(SCALE * radius) * y).alias("y"))


def lonlat(x: Column, y: Column, epsg: Column) -> Column:
    """Struct (x, y) of longitude and latitude: the inverse of utm, by the same order of series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    south = F.when(epsg >= 32700, F.lit(NORTHING)).otherwise(F.lit(0.0))
    xi, eta = (y - south) / F.lit(SCALE * radius), (x - F.lit(EASTING)) / F.lit(SCALE * radius)
    a, b = xi, eta
    for k, c in enumerate(beta, 1):
        a = a - F.lit(c) * F.sin(F.lit(2.0 * k) * xi) * F.cosh(F.lit(2.0 * k) * eta)
        b = b - F.lit(c) * F.cos(F.lit(2.0 * k) * xi) * F.sinh(F.lit(2.0 * k) * eta)
    centre = (epsg % 100) * 6 - 183

    def latitude(chi):
        return sum((F.lit(c) * F.sin(F.lit(2.0 * k) * chi) for k, c in enumerate(delta, 1)), chi)

    def place(p):
        lat = let(F.asin(F.sin(p["a"]) / F.cosh(p["b"])), latitude)
        return F.struct((centre + F.degrees(F.atan2(F.sinh(p["b"]), F.cos(p["a"])))).alias("x"), F.degrees(lat).alias("y"))

    return let(F.struct(a.alias("a"), b.alias("b")), place)


def grid_size(west: Column, south: Column, east: Column, north: Column, most: Column) -> Column:
    """Struct (width, height): the longer side gets `most` cells (64..2048), the other its share,
    at least 64, halves rounded to even."""
    cap = F.greatest(F.lit(64), F.least(F.lit(2048), most)).cast("int")
    w, h = F.greatest(east - west, F.lit(1e-9)), F.greatest(north - south, F.lit(1e-9))
    other = lambda ratio: F.greatest(F.lit(64), F.rint(cap * ratio).cast("int"))
    return F.struct(F.when(w >= h, cap).otherwise(other(w / h)).alias("width"), F.when(w >= h, other(h / w)).otherwise(cap).alias("height"))


def cell_centre(i: Column, j: Column, west: Column, north: Column, dx: Column, dy: Column) -> Column:
    """Struct (x, y) of the centre of row i, column j; dy is the positive cell height."""
    return F.struct((west + (j + F.lit(0.5)) * dx).alias("x"), (north - (i + F.lit(0.5)) * dy).alias("y"))


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.floor((F.lit(0.5) - F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s)) / F.lit(12.566370614359172)) * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_count(west: Column, south: Column, east: Column, north: Column, zoom: Column) -> Column:
    return (tile_x(east, zoom) - tile_x(west, zoom) + 1) * (tile_y(south, zoom) - tile_y(north, zoom) + 1)


def pick_zoom(west: Column, south: Column, east: Column, north: Column, most: int = 400) -> Column:
    """The largest zoom of 18..10 whose tiles over the box are at most `most`, else 9."""
    fits = F.filter(F.sequence(F.lit(10), F.lit(18)), lambda z: tile_count(west, south, east, north, z) <= most)
    return F.coalesce(F.array_max(fits), F.lit(9))


def tms_row(zoom: Column, y: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), zoom.cast("int")) - 1 - y


def tile_url(template: str, z: Column, x: Column, y: Column) -> Column:
    url = F.lit(template)
    for key, c in {"{z}": z, "{x}": x, "{y}": y}.items():
        url = F.replace(url, F.lit(key), c.cast("string"))
    return url


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an array of (x, y) structs, closed or not; positive if counter-clockwise."""
    n = F.size(ring)
    pairs = F.sequence(F.lit(0), n - 1)
    cross = lambda k: F.get(ring, k)["x"] * F.get(ring, (k + 1) % n)["y"] - F.get(ring, (k + 1) % n)["x"] * F.get(ring, k)["y"]
    return F.when(n < 3, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, k: s + cross(k)) / 2)


def ring_centroid(ring: Column) -> Column:
    """Struct (x, y) of the area centroid of an array of (x, y) structs."""
    n = F.size(ring)
    at = lambda k: (F.get(ring, k), F.get(ring, (k + 1) % n))

    def moment(axis):
        def step(s, k):
            p, q = at(k)
            return s + (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), step) / (F.lit(6.0) * ring_area(ring))

    return F.struct(moment("x").alias("x"), moment("y").alias("y"))


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test of a point against a fixed ring."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            at = F.lit(ax) + (y - F.lit(ay)) * F.lit((bx - ax) / (by - ay))
            odd = odd != (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at))
    return odd


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against an array of (x, y) structs."""
    n = F.size(ring)

    def step(odd, k):
        p, q = F.get(ring, k), F.get(ring, (k + 1) % n)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])
        return odd != F.when((p["y"] > y) != (q["y"] > y), x < at).otherwise(F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), step)


def barycentric(px: Column, py: Column, a: tuple, b: tuple, c: tuple) -> tuple[Column, Column, Column]:
    """Weights of three corners (pairs of Columns) for a point; null if they lie on a line."""
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    whole = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    whole = F.when(F.abs(whole) > 1e-12, whole)
    u = ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / whole
    v = ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / whole
    return u, v, F.lit(1.0) - u - v
