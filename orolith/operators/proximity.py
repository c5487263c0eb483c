"""The place of a mesh that is closest to a point, with its face and barycentric weights.

A job's faces are dealt to the cells of an octree over their boxes' centres, deep enough for about LEAF
faces a cell. Each cell knows the box around all of its faces and one corner of them. Points go
down the tree two levels at a time: the corners seen so far bound a point's distance from above, and
cells whose box is farther than that are dropped. What is left at the bottom is measured exactly. Upper
levels are small tables; lower ones are joined by cell, so no point meets the faces of cells it can't reach.

Defined results: of squared distances that agree to DIGITS decimals the smaller fid is taken; faces
without area count as the segment or point they are; vertices with a null or non-finite coordinate take
their faces out; a point with such a coordinate, or of a job without faces, gets nulls; repeated points
are answered each; other columns of points stay, except those named like a result, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.operators import mesh
from orolith.operators.raster import JOB
from orolith.storage import sized, stored

#: Faces in a cell at the bottom, levels of the tree at most, and decimals to which squared distances are compared.
LEAF, DEEPEST, DIGITS = 16, 20, 12
#: A cell's place along each axis.
CELL = ["__a", "__b", "__c"]
#: Fixed value: millimetres within which a face may belong to the surface.
TOP_NEAR = 0.75


def finite(*columns: str) -> Column:
    """Whether none of the columns is null, NaN or infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    return ok


def dot(a: dict, b: dict) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def weights(p: dict[str, Column], corners: list[dict[str, Column]]) -> Column:
    """Struct (d2, b0, b1, b2) of the place of a triangle that is closest to p: the best of its three
    sides and, if p stands over it, of its inside."""
    less = lambda a, b: {c: a[c] - b[c] for c in "xyz"}
    zero, one = F.lit(0.0), F.lit(1.0)

    def place(b: list[Column]) -> Column:
        off = {c: p[c] - sum((w * k[c] for w, k in zip(b, corners, strict=True)), zero) for c in "xyz"}
        return F.struct(dot(off, off).alias("d2"), *[w.alias(f"b{n}") for n, w in enumerate(b)])

    found = []
    for n, m in ((0, 1), (1, 2), (0, 2)):
        side = less(corners[m], corners[n])
        long = dot(side, side)
        t = F.when(long > 0, F.greatest(zero, F.least(one, dot(less(p, corners[n]), side) / long))).otherwise(zero)
        b = [zero, zero, zero]
        b[n], b[m] = one - t, t
        found.append(place(b))
    e, f, g = less(corners[1], corners[0]), less(corners[2], corners[0]), less(p, corners[0])
    ee, ef, ff, ge, gf = dot(e, e), dot(e, f), dot(f, f), dot(g, e), dot(g, f)
    area = ee * ff - ef * ef
    s, t = [F.when(area > 0, x / area) for x in (ff * ge - ef * gf, ee * gf - ef * ge)]
    found.append(F.when((s >= 0) & (t >= 0) & (s + t <= 1), place([one - s - t, s, t])))
    return F.array_min(F.array(*found))


def cells(faces: DataFrame, vertices: DataFrame, columns: list[str], by: list[str]) -> tuple[DataFrame, int]:
    """(faces with p0, p1, p2, their box and bottom cell (a, b, c), the tree's depth)."""
    good = vertices.where(finite("x", "y", "z"))
    tri = mesh.corners(faces.select(*by, "fid", "v0", "v1", "v2"), good, ["x", "y", "z", *columns], by)
    box = {f"{name}_{c}": f(*[F.col(f"p{k}")[c].cast("double") for k in range(3)]) for c in "xyz" for name, f in (("lo", F.least), ("hi", F.greatest))}
    tri = stored(tri.drop("v0", "v1", "v2").withColumns(box), "boxed-faces")
    mid = lambda c: F.col(f"lo_{c}") / 2 + F.col(f"hi_{c}") / 2
    frame = tri.groupBy(by).agg(F.count("*").alias("__n"), *[f(mid(c)).alias(f"__{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))])
    frame = stored(frame, "frames")
    wide = F.greatest(*[F.col(f"__max_{c}") - F.col(f"__min_{c}") for c in "xyz"], F.lit(1e-9))
    at = {k: F.least(F.floor((mid(c) - F.col(f"__min_{c}")) / wide * F.lit(float(1 << DEEPEST))), F.lit((1 << DEEPEST) - 1)).cast("int") for k, c in zip(CELL, "xyz", strict=True)}
    dealt = tri.join(sized(frame), by).withColumns(at).select(*tri.columns, *at)
    depth = deep_enough(dealt, by)
    return dealt.withColumns({c: F.shiftright(c, DEEPEST - depth) for c in CELL}), depth


def deep_enough(dealt: DataFrame, by: list[str]) -> int:
    """The least even level at which the cells that hold faces (by, CELL at the level DEEPEST) hold LEAF of them on average,
    in each job: a long and narrow mesh fills few cells of its cube, so its length alone doesn't tell."""
    full = stored(dealt.groupBy(*by, *CELL).agg(F.count("*").alias("__n")), "full-cells")
    for level in range(2, DEEPEST, 2):
        up = full.groupBy(*by, *[F.shiftright(c, DEEPEST - level).alias(c) for c in CELL]).agg(F.sum("__n").alias("__n"))
        if (up.groupBy(by).agg(F.avg("__n").alias("n")).agg(F.max("n")).first()[0] or 0) <= LEAF:
            return level
    return DEEPEST


def node_boxes(below: DataFrame, by: list[str], shift: int, corner: Column) -> DataFrame:
    """Cells `shift` levels up: the box around what they hold, and the least of its corners."""
    up = [F.shiftright(c, shift).alias(c) for c in CELL]
    span = [f(f"{name}_{c}").alias(f"{name}_{c}") for c in "xyz" for name, f in (("lo", F.min), ("hi", F.max))]
    return below.groupBy(*by, *up).agg(*span, F.min(corner).alias("corner"))


def closest(points: DataFrame, vertices: DataFrame, faces: DataFrame, columns: list[str] | None = None, by: list[str] = JOB) -> DataFrame:
    """points (job_id, pid, x, y, z) with fid, d2, b0, b1, b2 of the closest place of their job's mesh,
    and `columns` of the vertices interpolated there."""
    columns = list(columns or [])
    tri, depth = cells(faces, vertices, columns, by)
    tri = stored(tri, "celled-faces")
    levels = {depth: stored(node_boxes(tri, by, 0, F.struct(*[F.col("p0")[c].cast("double").alias(c) for c in "xyz"])), "nodes")}
    for level in range(depth - 2, 0, -2):
        levels[level] = node_boxes(levels[level + 2], by, 2, F.col("corner"))
    key = [*by, "pid", "px", "py", "pz"]
    asks = points.where(finite("x", "y", "z")).select(*by, "pid", *[F.col(c).cast("double").alias(f"p{c}") for c in "xyz"]).distinct()
    square = lambda x: x * x
    near = sum((square(F.greatest(F.col(f"lo_{c}") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"hi_{c}"), F.lit(0.0))) for c in "xyz"), F.lit(0.0))
    far = sum((square(F.col("corner")[c] - F.col(f"p{c}")) for c in "xyz"), F.lit(0.0))
    left = asks
    for level in sorted(levels):
        nodes = levels[level]
        if level > 2:
            nodes = nodes.withColumns({f"{c}up": F.shiftright(c, 2) for c in CELL})
            left = left.select(*key, "reach", *[F.col(c).alias(f"{c}up") for c in CELL])
        met = left.join(sized(nodes), by if level == 2 else [*by, *[f"{c}up" for c in CELL]])
        met = met.withColumns({"near": near, "far": far if level == 2 else F.least("reach", far)})
        met = met.withColumn("reach", F.min("far").over(Window.partitionBy(*key)))
        left = met.where(F.col("near") <= F.col("reach") * (1 + 1e-9) + 1e-9).select(*key, "reach", *CELL)
    measured = left.join(tri, [*by, *CELL])
    measured = measured.withColumn("w", weights({c: F.col(f"p{c}") for c in "xyz"}, [{c: F.col(f"p{k}")[c].cast("double") for c in "xyz"} for k in range(3)]))
    value = [sum((F.col("w")[f"b{k}"] * F.col(f"p{k}")[c] for k in range(3)), F.lit(0.0)).alias(f"__{c}") for c in columns]
    best = measured.groupBy(*key).agg(F.min(F.struct(F.round("w.d2", DIGITS).alias("d"), "fid", "w", *value)).alias("m"))
    out = best.select(*key, "m.fid", "m.w.d2", "m.w.b0", "m.w.b1", "m.w.b2", *[F.col(f"m.__{c}").alias(c) for c in columns])
    told = ["fid", "d2", "b0", "b1", "b2", *columns]
    out = out.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("pid").alias("__pid"), *[F.col(f"p{c}").alias(f"__p{c}") for c in "xyz"], *[F.col(c).alias(f"__out_{c}") for c in told])
    same = F.col("pid") == F.col("__pid")
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    for c in "xyz":
        same = same & (F.col(c).cast("double") == F.col(f"__p{c}"))
    keep = [c for c in points.columns if c not in told]
    return points.select(keep).join(out, same, "left").select(*keep, *[F.col(f"__out_{c}").alias(c) for c in told])


def near_limit(voxel_mm: float | None = None, limit: float | None = None) -> float:
    """The distance within which a face of a print belongs to its surface: `limit`, or TOP_NEAR, or
    one and a half voxels if that is more."""
    return float(limit) if limit is not None else max(TOP_NEAR, 1.5 * (voxel_mm or 0.0))


def top_faces(faces: DataFrame, vertices: DataFrame, surface: tuple[DataFrame, DataFrame], voxel_mm: float | None = None, limit: float | None = None, by: list[str] = JOB) -> DataFrame:
    """faces with is_top, by their normals; in jobs where no normal points up, faces whose centre is
    near the surface (vertices, faces), at a face of it that does point up."""
    flagged = stored(mesh.top_faces(faces, vertices, by), "tops")
    turned = stored(flagged.groupBy(by).agg(F.max("is_top").alias("any")).where("NOT any").select(by), "turned")
    if turned.isEmpty():
        return flagged
    centre = [((F.col("p0")[c] + F.col("p1")[c] + F.col("p2")[c]) / F.lit(3.0)).alias(c) for c in "xyz"]
    centres = mesh.corners(faces.join(sized(turned), by, "left_semi"), vertices, by=by).select(*by, F.col("fid").alias("pid"), *centre)
    up = mesh.top_faces(surface[1], surface[0], by).where("is_top").select(*by, "fid")
    met = closest(centres, surface[0], surface[1], by=by).where(F.col("d2") <= near_limit(voxel_mm, limit) ** 2)
    near = met.join(up, [*by, "fid"], "left_semi").select(*by, F.col("pid").alias("fid"), F.lit(True).alias("__near"))
    return flagged.join(near, [*by, "fid"], "left").withColumn("is_top", F.col("is_top") | F.coalesce("__near", F.lit(False))).select(flagged.columns)
