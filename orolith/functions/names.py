"""Names, flags and numbers as text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The export flags and whether each is on by default.
EXPORT_FLAGS = {
    "preview_glb": False, "preview_obj": False, "print_stl": True, "print_3mf": False, "print_textured_glb": False,
    "print_pieces": False, "print_ams": True, "print_ams_glb": False, "quad_mask": False,
}
SOLID_FLAGS = ["print_stl", "print_3mf", "print_textured_glb", "print_pieces", "print_ams", "print_ams_glb"]


def export_basename(filename: Column) -> Column:
    """The file's stem as a safe name of at most 120 characters; `terrain` if nothing is left."""
    leaf = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    stem = F.when(leaf.rlike(r"^.+\.[^.]*$"), F.regexp_extract(leaf, r"^(.+)\.[^.]*$", 1)).otherwise(leaf)
    safe = F.btrim(F.regexp_replace(stem, r"[^A-Za-z0-9_.-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(F.substring(safe, 1, 120), F.lit("")), F.lit("terrain"))


def download_name(basename: Column, suffix: str) -> Column:
    return F.concat(F.coalesce(F.nullif(basename, F.lit("")), F.lit("terrain")), F.lit(suffix))


def form_flag(value: Column, default: bool | Column) -> Column:
    """A form value as a boolean; what is neither yes nor no is the default."""
    word = F.lower(F.trim(value))
    default = F.lit(default) if isinstance(default, bool) else default
    return F.when(value.isNull(), default).when(word.isin("", "0", "false", "off", "no"), F.lit(False)).when(word.isin("1", "true", "on", "yes"), F.lit(True)).otherwise(default)


def export_options(form: Column) -> Column:
    """Struct of the export flags from a map of form values, with what they call for."""
    flags = {name: form_flag(F.try_element_at(form, F.lit(f"export_{name}")), on) for name, on in EXPORT_FLAGS.items()}
    solid = F.lit(False)
    for name in SOLID_FLAGS:
        solid = solid | flags[name]
    needs = {"needs_print_solid": solid, "needs_ams": flags["print_ams"] | flags["print_ams_glb"]}
    return F.struct(*[c.alias(name) for name, c in {**flags, **needs}.items()])


def whitelisted(value: Column, allowed: list[str], default: str) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*allowed), word).otherwise(F.lit(default))


def pond_sensitivity(value: Column) -> Column:
    return whitelisted(value, ["conservative", "balanced", "aggressive"], "conservative")


def ams_quality(value: Column) -> Column:
    return whitelisted(value, ["high", "medium", "low"], "medium")


def palette_size(value: Column) -> Column:
    """2..8; 4 if the value is no integer."""
    return F.greatest(F.lit(2), F.least(F.lit(8), F.coalesce(value.try_cast("int"), F.lit(4))))


def coordinate(x: Column) -> Column:
    """Up to ten significant digits without trailing zeros."""
    text = F.format_string("%.10g", x)
    mantissa, tail = F.regexp_extract(text, r"^([^e]*)(e.*)?$", 1), F.regexp_extract(text, r"^([^e]*)(e.*)?$", 2)
    short = F.when(mantissa.contains("."), F.regexp_replace(F.regexp_replace(mantissa, "0+$", ""), r"\.$", "")).otherwise(mantissa)
    return F.concat(short, tail)


def read_timeout(width: Column, height: Column) -> Column:
    """Seconds to wait for a raster of this size."""
    return F.greatest(F.lit(120), F.least(F.lit(600), F.floor(width * height / F.lit(50_000)).cast("int")))


#: Seconds from which a message tells the time it took; and for notes on relief, in metres and as
#: a share: a footprint is flat, or a mesh does not follow it, if its relief is under the share of one that is larger.
TOLD_FROM, FLAT_SHARE, FULL_RELIEF, MASKED_RELIEF = 8, 0.05, 1.0, 0.5


def timed(message: Column, seconds: Column) -> Column:
    """A progress message with the whole seconds it took, once these are worth telling."""
    whole = F.floor(seconds)
    return F.when(whole >= TOLD_FROM, F.concat(message, F.lit(" ("), whole.cast("string"), F.lit("s)"))).otherwise(message)


def relief_notes(full: Column, clipped: Column, masked: Column, mesh_span: Column) -> Column:
    """Struct of two flags on a job's reliefs (null where one is not known counts as no): whether the
    footprint is much flatter than the raster around it, and whether the mesh does not follow the footprint."""
    flat = (full > FULL_RELIEF) & (clipped < FLAT_SHARE * full)
    off = (masked > MASKED_RELIEF) & (mesh_span < FLAT_SHARE * masked)
    return F.struct(F.coalesce(flat, F.lit(False)).alias("flat_footprint"), F.coalesce(off, F.lit(False)).alias("mesh_mismatch"))


def built(key: str, flags: Column, facts: dict[str, Column]) -> Column:
    """Whether an export was built: by the map of flags if that names it, else by what older facts tell:
    print_ok, textured_glb, ams_glb, pieces_ok (booleans) and pieces (their number)."""
    told = {"print_stl": "print_ok", "print_ams": "print_ok", "print_3mf": "print_ok", "print_textured_glb": "textured_glb", "print_ams_glb": "ams_glb"}
    if key == "print_pieces":
        other = facts["pieces_ok"] & (facts["pieces"] > 0)
    else:
        other = facts[told[key]] if key in told else F.lit(False)
    named = F.coalesce(F.map_contains_key(flags, F.lit(key)), F.lit(False))
    return F.coalesce(F.when(named, F.try_element_at(flags, F.lit(key))).otherwise(other), F.lit(False))
