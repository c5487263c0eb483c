"""Colour arithmetic as Column expressions: HSV, CIE Lab (D65), names and hex codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sRGB to XYZ under D65, its inverse, and the white point.
TO_XYZ = [(0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227)]
FROM_XYZ = [(3.24048134, -1.53715152, -0.49853633), (-0.96925495, 1.87599, 0.04155593), (0.05564664, -0.20404134, 1.05731107)]
WHITE = (0.95047, 1.0, 1.08883)
#: The filament of a colour. Below GRAY_SATURATION it is grey, light above a value; else
#: each row is a range of hues, the value below which the first name holds, and both names.
GRAY_SATURATION, LIGHT_GRAY_VALUE = 0.12, 0.62
BLUE, GREEN, BROWN = (0.50, 0.72, 0.55, "Water Blue", "Blue"), (0.20, 0.50, 0.42, "Forest Green", "Green"), (0.05, 0.20, 0.45, "Brown", "Tan")
RED = (0.92, 0.05, 0.5, "Rust", "Red")  # above the first hue or below the second
#: Water is teal (hues, least saturation and value), darker than DARK, blue (greatest value,
#: how far blue may lie under red, how far green and blue together lie over red) or muddy (greatest
#: saturation, values, and with the strict rule the same two differences).
TEAL, DARK, BLUISH, MUDDY = (0.38, 0.75, 0.05, 0.08), 36, (0.30, 6, 6), (0.36, 0.22, 0.85, 4, 8)
#: A pale, even surface is at least so bright (as a channel and as a value), less saturated than
#: this, not warm (red over green and over blue), not green (over red), and its channels are this close.
PALE_BRIGHT, PALE_VALUE, PALE_SATURATION, WARM, GREENISH, EVEN = 118, 0.52, 0.36, (28, 18), 35, 32


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct (h, s, v), each 0..1, of channels 0..255."""
    r, g, b = (c.cast("double") / F.lit(255.0) for c in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    turn = F.when(r == high, (g - b) / span).when(g == high, F.lit(2.0) + (b - r) / span).otherwise(F.lit(4.0) + (r - g) / span)
    hue = F.when(span == 0, F.lit(0.0)).otherwise(F.pmod(turn / F.lit(6.0), F.lit(1.0)))
    sat = F.when(high == 0, F.lit(0.0)).otherwise(span / high)
    return F.struct(hue.alias("h"), sat.alias("s"), high.alias("v"))


def filament_name(h: Column, s: Column, v: Column) -> Column:
    """The name of the filament nearest in kind; the first rule that holds decides."""
    shade = lambda kind: F.when(v < kind[2], F.lit(kind[3])).otherwise(F.lit(kind[4]))
    return (
        F.when(s < GRAY_SATURATION, F.when(v > LIGHT_GRAY_VALUE, F.lit("Light Gray")).otherwise(F.lit("Gray")))
        .when(h.between(*BLUE[:2]), shade(BLUE))
        .when((h >= GREEN[0]) & (h < GREEN[1]), shade(GREEN))
        .when((h >= BROWN[0]) & (h < BROWN[1]), shade(BROWN))
        .when((h > RED[0]) | (h < RED[1]), shade(RED))
        .otherwise(F.lit("Green"))
    )


def hex_rgb(r: Column, g: Column, b: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)], F.lit(suffix))


def slug(name: Column) -> Column:
    words = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.btrim(words, F.lit("_")), F.lit("")), F.lit("color"))


def linear(c: Column) -> Column:
    x = c.cast("double") / F.lit(255.0)
    return F.when(x > 0.04045, F.pow((x + F.lit(0.055)) / F.lit(1.055), F.lit(2.4))).otherwise(x / F.lit(12.92))


def toned(rgb: list[Column]) -> list[Column]:
    """The parts of a colour on Lab's scale, of linear channels."""
    xyz = [(rgb[0] * F.lit(m[0]) + rgb[1] * F.lit(m[1]) + rgb[2] * F.lit(m[2])) / F.lit(w) for m, w in zip(TO_XYZ, WHITE, strict=True)]
    return [F.when(t > 0.008856, F.cbrt(t)).otherwise(F.lit(7.787) * t + F.lit(16.0 / 116.0)) for t in xyz]


def of_toned(x: Column, y: Column, z: Column) -> Column:
    return F.struct((F.lit(116.0) * y - F.lit(16.0)).alias("L"), (F.lit(500.0) * (x - y)).alias("a"), (F.lit(200.0) * (y - z)).alias("b"))


def lab(r: Column, g: Column, b: Column) -> Column:
    """Struct (L, a, b) of channels 0..255."""
    return of_toned(*toned([linear(c) for c in (r, g, b)]))


def with_lab(pixels: DataFrame, name: str = "__lab") -> DataFrame:
    """pixels (r, g, b) with a column (L, a, b). The same as lab in steps, so that the code made for
    many rows works each part out once."""
    out = pixels.withColumns({f"__linear_{c}": linear(F.col(c)) for c in "rgb"})
    out = out.withColumns({f"__toned_{c}": t for c, t in zip("xyz", toned([F.col(f"__linear_{c}") for c in "rgb"]), strict=True)})
    return out.withColumn(name, of_toned(*[F.col(f"__toned_{c}") for c in "xyz"])).drop(*[f"__linear_{c}" for c in "rgb"], *[f"__toned_{c}" for c in "xyz"])


def from_lab(light: Column, a: Column, b: Column) -> Column:
    """Struct (r, g, b) of integers 0..255, halves to even."""
    y = (light + F.lit(16.0)) / F.lit(116.0)
    xyz = [y + a / F.lit(500.0), y, F.greatest(y - b / F.lit(200.0), F.lit(0.0))]
    xyz = [F.when(t > 0.2068966, t * t * t).otherwise((t - F.lit(16.0 / 116.0)) / F.lit(7.787)) * F.lit(w) for t, w in zip(xyz, WHITE, strict=True)]

    def channel(m):
        x = xyz[0] * F.lit(m[0]) + xyz[1] * F.lit(m[1]) + xyz[2] * F.lit(m[2])
        x = F.when(x > 0.0031308, F.lit(1.055) * F.pow(x, F.lit(1 / 2.4)) - F.lit(0.055)).otherwise(x * F.lit(12.92))
        return F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * F.lit(255.0)).cast("int")

    return F.struct(*[channel(m).alias(name) for m, name in zip(FROM_XYZ, "rgb", strict=True)])


def squared(one: Column, other: Column) -> Column:
    """Squared distance of two (L, a, b) structs."""
    return F.pow(one["L"] - other["L"], F.lit(2.0)) + F.pow(one["a"] - other["a"], F.lit(2.0)) + F.pow(one["b"] - other["b"], F.lit(2.0))


def brightness(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b)


def saturation(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) - F.least(r, g, b)) / F.greatest(r, g, b, F.lit(1))


def looks_like_water(r: Column, g: Column, b: Column, bright: Column, strict: Column) -> Column:
    """Whether median channels and brightness are those of water; `strict` narrows the muddy rule."""
    c = hsv(r, g, b)
    h, s, v = c["h"], c["s"], c["v"]
    teal = h.between(*TEAL[:2]) & (s >= TEAL[2]) & (v >= TEAL[3])
    blue = (v < BLUISH[0]) & (b >= r - BLUISH[1]) & (g + b > r + BLUISH[2])
    muddy = (s < MUDDY[0]) & v.between(*MUDDY[1:3]) & (~strict | ((b >= r - MUDDY[3]) & (g + b > r + MUDDY[4])))
    return teal | (bright < DARK) | blue | muddy


def looks_bright_uniform(r: Column, g: Column, b: Column, bright: Column) -> Column:
    """Whether median channels are those of a pale, even surface such as a silty lake."""
    c = hsv(r, g, b)
    warm, green = (r > g + WARM[0]) & (r > b + WARM[1]), g > r + GREENISH
    return (bright >= PALE_BRIGHT) & (c["v"] >= PALE_VALUE) & (c["s"] < PALE_SATURATION) & ~warm & ~green & (F.abs(r - g) <= EVEN) & (F.abs(g - b) <= EVEN)
