"""Closed meshes cut by planes across an axis, each piece closed again by caps.

Faces that lie between two planes stay whole; a face that planes cross is clipped to each slab it reaches. A
cut point is named by its edge and its plane and worked out once, from the edge's smaller end, so the pieces
of neighbouring faces meet exactly. The half-edges that lie in a plane and have no twin in their slab bound its
caps: they are walked to loops and triangulated with all their corners, a task having the section of one slab by
one plane. Its size follows the mesh's width, not its area.

Defined results: a face that lies in a plane goes to the slab behind it, as seen from outside, so a wall in the
plane closes its slab by itself; a mesh that was open stays open in the same places, and what of a section
does not close is left open; faces of unknown corners are left out; an empty mesh gives none; null coordinates are
not allowed. A slab without a face has no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orolith.operators import mesh, polygons
from orolith.operators.raster import JOB
from orolith.storage import removed, sized, stored, table_path

#: The axes of a section, in the order in which a triangle that runs counter-clockwise looks along +axis.
SECTION = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
CORNER = "struct<a: bigint, b: bigint, line: int, x: double, y: double, z: double>"
CORNERS = [f"{c}{k}" for k in range(3) for c in ("v", "p")]


def clipped(v: tuple, c: tuple, lines: list[float], slab: int) -> list[tuple]:
    """Corners (a, b, line) of a triangle's part in a slab: a vertex has a alone, a cut point its edge's ends."""
    lo, hi = lines[slab - 1] if slab else -np.inf, lines[slab] if slab < len(lines) else np.inf
    out = []
    for k in range(3):
        p, q, cp, cq = v[k], v[(k + 1) % 3], c[k], c[(k + 1) % 3]
        if lo <= cp <= hi:
            out.append((p, None, None))
        ends = [(lo, slab - 1), (hi, slab)] if cp < cq else [(hi, slab), (lo, slab - 1)]
        out += [(min(p, q), max(p, q), n) for at, n in ends if min(cp, cq) < at < max(cp, cq)]
    return out


def pieces(keys: list[str], axis: str):
    """Triangles of crossed faces (keys, fid, v0..v2, x0..z2, lines, slab). A cut point is worked out from its edge's
    smaller end, so it is the same in each face that has it."""

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                at = {getattr(r, f"v{k}"): {c: getattr(r, f"{c}{k}") for c in "xyz"} for k in range(3)}
                lines, v = list(r.lines), (r.v0, r.v1, r.v2)

                def corner(a, b, line, at=at, lines=lines):
                    if b is None:
                        return {"a": a, "b": None, "line": None, **at[a]}
                    ea, eb, place = at[a], at[b], lines[line]
                    t = (place - ea[axis]) / (eb[axis] - ea[axis])
                    return {"a": a, "b": b, "line": line, **{c: place if c == axis else ea[c] + (eb[c] - ea[c]) * t for c in "xyz"}}

                ring = [corner(*p) for p in clipped(v, tuple(at[k][axis] for k in v), lines, r.slab)]
                for n in range(1, len(ring) - 1):
                    rows.append((*[getattr(r, k) for k in keys], r.slab, r.fid, n, ring[0], ring[n], ring[n + 1]))
            yield pd.DataFrame(rows, columns=[*keys, "slab", "fid", "n", "p0", "p1", "p2"])

    return run


def capped(keys: list[str]):
    """Triangles of one section from its half-edges (a, b, pa, qa, pb, qb), wound against them; s and t are the
    section's coordinates of their corners."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows[["a", "b"]].to_numpy())
        at = np.zeros((len(ids), 2))
        a, b = np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"])
        at[a], at[b] = rows[["pa", "qa"]].to_numpy(), rows[["pb", "qb"]].to_numpy()
        rings = polygons.loops(list(zip(b.tolist(), a.tolist(), strict=True)), dict(enumerate(map(tuple, at))))
        tri = np.array(polygons.triangles(rings, at), int).reshape(-1, 3)
        out = pd.DataFrame({"n": np.arange(len(tri))} | {f"v{k}": ids[tri[:, k]] for k in range(3)} | {f"{c}{k}": at[tri[:, k], m] for k in range(3) for m, c in enumerate("st")})
        for k, (name, value) in enumerate(zip([*keys, "slab", "line"], key, strict=True)):
            out.insert(k, name, value)
        return out

    return run


def split(vertices: DataFrame, faces: DataFrame, lines: DataFrame, axis: str, by: list[str] = JOB, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces with slab, p0, p1 and p2): meshes (job_id, vid, x, y, z, ...) and (by, fid, v0, v1, v2) cut at the
    planes `lines` (by, lines: ascending array) across an axis. Slabs count from 0; vertices are shared by the slabs, new ones
    behind the old ones, all their numbers interpolated. `by` may be finer than the vertices' job_id. Faces may bring
    p0, p1 and p2 along; else these are fetched. They stay with the faces, so a mesh that is cut again, measured or
    written need not be joined with its vertices again. The faces of a mesh are stored once, at `path` if given.
    """
    kinds = {f.name: f.dataType.simpleString() for f in faces.schema.fields}
    named = ", ".join(f"{c} {kinds[c]}" for c in by)
    tri = faces if "p0" in faces.columns else mesh.corners(faces.select(*by, "fid", "v0", "v1", "v2"), vertices, "xyz", JOB)
    tri = tri.join(sized(lines.select(*by, "lines")), by)
    c = [F.col(f"p{k}")[axis] for k in range(3)]
    low, high = F.least(*c), F.greatest(*c)
    first, last = F.size(F.filter("lines", lambda x: x <= low)), F.size(F.filter("lines", lambda x: x < high))
    p, q = SECTION[axis]
    edge = lambda k, s: F.col(f"p{k}")[s] - F.col("p0")[s]
    looks = edge(1, p) * edge(2, q) - edge(1, q) * edge(2, p)
    flat = first > last  # all in one plane: behind it, as seen from outside
    rests = [(c[k] == c[k - 1]) & F.array_contains("lines", c[k]) for k in range(3)]  # a side lies in a plane
    tri = tri.withColumns({"first": F.when(flat & (looks > 0), last).when(flat, first).otherwise(first), "last": F.when(flat & (looks > 0), last).when(flat, first).otherwise(last), "rests": rests[0] | rests[1] | rests[2]})
    tri = stored(tri.select(*by, "fid", *CORNERS, "lines", "first", "last", "rests"), "slabs", path)
    whole = tri.where(F.col("first") == F.col("last")).select(*by, F.col("first").alias("slab"), "fid", *CORNERS, "rests")
    crossed = tri.where(F.col("first") < F.col("last")).withColumn("slab", F.explode(F.sequence("first", "last")))
    places = [F.col(f"p{k}")[s].alias(f"{s}{k}") for k in range(3) for s in "xyz"]
    cut = crossed.select(*by, "fid", "v0", "v1", "v2", *places, "lines", "slab").mapInPandas(pieces(by, axis), f"{named}, slab int, fid long, n int, p0 {CORNER}, p1 {CORNER}, p2 {CORNER}")
    cut = stored(cut, "cut-faces")

    corner = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"p{k}.{x}").alias(x) for x in ("a", "b", "line")], F.struct(*[F.col(f"p{k}.{x}").alias(x) for x in "xyz"]).alias("e")) for k in range(3)]))
    at = cut.select(*by, "slab", "fid", "n", corner).join(sized(lines.select(*by, "lines")), by).withColumn("place", F.get("lines", F.col("line"))).drop("lines")
    points = at.where("b IS NOT NULL").groupBy(*JOB, "a", "b", "place").agg(F.min("e").alias("e"))
    numbers = [f.name for f in vertices.schema.fields if f.name not in (*JOB, "vid")]
    more, value = [s for s in numbers if s not in "xyz"], {s: F.col("e")[s] for s in "xyz"}
    if more:
        for k in "ab":
            points = points.join(vertices.select(*JOB, F.col("vid").alias(k), F.struct(axis, *more).alias(f"e{k}")), [*JOB, k])
        t = (F.col("place") - F.col("ea")[axis]) / (F.col("eb")[axis] - F.col("ea")[axis])
        value |= {s: F.col("ea")[s] + (F.col("eb")[s] - F.col("ea")[s]) * t for s in more}
    rank = F.row_number().over(Window.partitionBy(*JOB).orderBy("a", "b", "place"))  # a job's cut points lie along its planes
    least = vertices.groupBy(*JOB).agg((F.max("vid") + 1).alias("__vid"))
    new = points.join(sized(least), JOB).select(*JOB, "a", "b", "place", (F.col("__vid") + rank - 1).cast("long").alias("vid"), *[value[s].alias(s) for s in numbers])
    new = stored(new, "cut-points")
    vertices = vertices.unionByName(new.select(vertices.columns))

    ids = at.join(new.select(*JOB, "a", "b", "place", F.col("vid").alias("__vid")), [*JOB, "a", "b", "place"], "left").withColumn("vid", F.coalesce("__vid", "a"))
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    parts = ids.groupBy(*by, "slab", "fid", "n").agg(*[of(k, c).alias(f"{n}{k}") for k in range(3) for n, c in (("v", "vid"), ("p", "e"))])
    parts = parts.where("v0 <> v1 AND v1 <> v2 AND v0 <> v2")
    last_fid = faces.groupBy(*by).agg((F.max("fid") + 1).alias("__fid"))
    rank = F.row_number().over(Window.partitionBy(*by, "slab").orderBy("fid", "n"))
    parts = stored(parts.join(sized(last_fid), by).select(*by, "slab", (F.col("__fid") + rank - 1).cast("long").alias("fid"), *CORNERS), "parts")
    body = whole.drop("rests").unionByName(parts)

    near = whole.where("rests").drop("rests").unionByName(parts)
    caps = sections(near, lines, axis, by).groupBy(*by, "slab", "line").applyInPandas(capped(by), f"{named}, slab int, line int, n int, v0 long, v1 long, v2 long, {', '.join(f'{c}{k} double' for k in range(3) for c in 'st')}")
    caps = stored(caps, "caps")
    above = stored(body.groupBy(*by, "slab").agg((F.max("fid") + 1).alias("__fid")), "last-faces")
    rank = F.row_number().over(Window.partitionBy(*by, "slab").orderBy("line", "n"))
    upper = F.col("slab") == F.col("line")
    side = lambda k, one, other: F.when(upper, F.col(f"{one}{k}")).otherwise(F.col(f"{other}{k}"))
    where = lambda k: {axis: F.get("lines", F.col("line")), p: side(k, "s", "t"), q: side(k, "t", "s")}
    caps = caps.join(sized(above), [*by, "slab"]).join(sized(lines.select(*by, "lines")), by)
    caps = caps.select(*by, "slab", (F.col("__fid") + rank - 1).cast("long").alias("fid"), *[x for k in range(3) for x in (F.col(f"v{k}"), F.struct(*[where(k)[s].alias(s) for s in "xyz"]).alias(f"p{k}"))])
    return vertices, body.unionByName(stored(caps, "cap-faces"))


def sections(body: DataFrame, lines: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """(by, slab, line, a, b, pa, qa, pb, qb): half-edges of slabs that lie in a bounding plane and have no twin; p
    and q are the section's coordinates, swapped where the slab lies above the plane, so that its caps run counter-clockwise.
    body has those faces that have sides in planes, with p0, p1 and p2."""
    p, q = SECTION[axis]
    planes = lines.select(*by, F.posexplode("lines").alias("line", axis))
    sides = [F.struct(F.col(f"v{k}").alias("a"), F.col(f"v{m}").alias("b"), F.col(f"p{k}").alias("ea"), F.col(f"p{m}").alias("eb")) for k, m in ((0, 1), (1, 2), (2, 0))]
    half = body.select(*by, "slab", "fid", F.inline(F.array(*sides))).withColumn(axis, F.col("ea")[axis]).where(F.col(axis) == F.col("eb")[axis])
    half = half.join(sized(planes), [*by, axis])
    pair = [F.least("a", "b"), F.greatest("a", "b")]
    lone = F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).over(Window.partitionBy(*by, "slab", *pair))
    order = F.row_number().over(Window.partitionBy(*by, "slab", "a", "b").orderBy("fid"))
    open_ = half.withColumns({"__more": lone, "__nr": order}).where(F.when(F.col("a") < F.col("b"), F.col("__more")).otherwise(-F.col("__more")) >= F.col("__nr"))
    upper = F.col("slab") == F.col("line")  # the slab lies below this plane
    side = lambda e, one, other: F.when(upper, F.col(e)[one]).otherwise(F.col(e)[other])
    wanted = open_.where(upper | (F.col("slab") == F.col("line") + 1))
    return wanted.select(*by, "slab", "line", "a", "b", side("ea", p, q).alias("pa"), side("ea", q, p).alias("qa"), side("eb", p, q).alias("pb"), side("eb", q, p).alias("qb"))


def tile_lines(vertices: DataFrame, axis: str, n: int, pad: float = mesh.TILE_PAD) -> DataFrame:
    """(job_id, lines): the n - 1 planes that cut a job's padded box into n equal slabs."""
    box = mesh.bounds(vertices)
    low, high = F.col(f"min_{axis}") - pad, F.col(f"max_{axis}") + pad
    return box.select(*JOB, F.array(*[low + (high - low) * k / n for k in range(1, n)]).cast("array<double>").alias("lines"))


def tiles(vertices: DataFrame, faces: DataFrame, nx: int, ny: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) keyed by (job_id, tile, ix, iy): solids cut into nx by ny tiles, each closed, edges
    straight; tile = 1 + ix + iy nx. Faces carry p0, p1 and p2. Tiles without a face have no rows. Both tables
    are read several times, so they should be stored ones."""
    spark, path = faces.sparkSession, table_path(faces.sparkSession, "slabs")
    across, along = tile_lines(vertices, "x", nx), tile_lines(vertices, "y", ny)
    v, f = split(vertices, faces, across, "x", path=path)
    key, f = [*JOB, "ix"], f.withColumnRenamed("slab", "ix")
    v, f = split(v, f, f.select(key).distinct().join(along, JOB), "y", key)
    removed(spark, path)  # all that comes of it is stored
    f = f.withColumnRenamed("slab", "iy").withColumn("tile", 1 + F.col("ix") + F.col("iy") * nx)
    key = [*JOB, "tile", "ix", "iy"]
    used = f.select(*key, F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return used.join(v, [*JOB, "vid"]).select(*key, "vid", *[c for c in v.columns if c not in (*JOB, "vid")]), f
