"""Surface meshes as two tables: vertices (job_id, vid, x, y, z, u, v) and faces (job_id, fid, v0, v1, v2).

X is east, Y north, Z up. Edges are a view on faces. All work is keyed by job; what runs in Python
is the lookup of a block's corners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from orolith.functions import geo
from orolith.operators import graph
from orolith.operators.raster import JOB
from orolith.storage import sized, stored

#: Base under the terrain in mm, digits that tell vertices apart, corner tolerance and
#: least area of a cut in metres, the normal from which a face is a top, padding of tiles in mm,
#: faces that colour packages aim at, and bounds of voxel grids.
BASE_MM, KEY_DIGITS, CORNER, SLIVER, TOP_NORMAL, TILE_PAD = 1.0, 3, 1e-4, 1e-12, 0.35, 0.02
FACE_TARGETS = {"high": 400_000, "medium": 200_000, "low": 80_000}
VOXEL_LEAST, VOXEL_CELLS = 0.35, 48_000_000.0


def grid_size(cells: DataFrame, by: list[str] = JOB) -> DataFrame:
    return cells.groupBy(by).agg((F.max("i") + 1).cast("long").alias("h"), (F.max("j") + 1).cast("long").alias("w"))


def grid_vertices(cells: DataFrame, by: list[str] = JOB) -> DataFrame:
    """A vertex for each cell (job_id, i, j, x, y, z) of a full grid, numbered in reading order."""
    u = (F.col("j") + F.lit(0.5)) / F.col("w")
    v = F.lit(1.0) - (F.col("i") + F.lit(0.5)) / F.col("h")
    vid = F.col("i") * F.col("w") + F.col("j")
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    return cells.join(sized(grid_size(cells, by)), by).select(*by, vid.alias("vid"), *xyz, u.alias("u"), v.alias("v"))


def grid_quads(cells: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, h, w): a quad for each 2 x 2 block of cells, named by its top left one."""
    return cells.select(*by, "i", "j").join(sized(grid_size(cells, by)), by).where((F.col("i") < F.col("h") - 1) & (F.col("j") < F.col("w") - 1))


def quad_faces(quads: DataFrame, by: list[str] = JOB) -> DataFrame:
    """Two faces a quad, cut along the diagonal from its lower left to its upper right cell."""
    a = F.col("i") * F.col("w") + F.col("j")
    b, c, d = a + F.col("w"), a + 1, a + F.col("w") + 1
    number = (F.col("i") * (F.col("w") - 1) + F.col("j")) * 2
    face = lambda k, *v: F.struct((number + k).cast("long").alias("fid"), *[x.cast("long").alias(f"v{n}") for n, x in enumerate(v)])
    return quads.select(*by, F.inline(F.array(face(0, a, b, c), face(1, b, d, c))))


def corner_flags(cells: DataFrame, flag: Column, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, h, w, kept): each quad, kept if any of its four cells has the flag."""
    lit = cells.where(flag).select(*by, F.explode(F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j")) for a in (0, 1) for b in (0, 1)])).alias("q"))
    lit = lit.select(*by, "q.i", "q.j").distinct().withColumn("kept", F.lit(True))
    return grid_quads(cells, by).join(lit, [*by, "i", "j"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def referenced(vertices: DataFrame, faces: DataFrame, by: list[str] = JOB) -> DataFrame:
    """The vertices that some face uses."""
    used = faces.select(*by, F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(used, [*by, "vid"], "left_semi").select(vertices.columns)


def directed_edges(faces: DataFrame, by: list[str] = JOB) -> DataFrame:
    sides = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))]
    return faces.select(*by, "fid", F.inline(F.array(*sides)))


def edges(faces: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, a, b, n): each edge, a < b, and how many faces it has."""
    return directed_edges(faces, by).groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def rim(faces: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, a, b): the half-edges of edges that a single face has. Half-edges are added up where they lie, so most
    meet their twin before anything is shuffled."""
    ahead = F.sum(F.when(F.col("a") < F.col("b"), F.lit(1)).otherwise(F.lit(-1)))
    met = directed_edges(faces, by).groupBy(*by, F.least("a", "b").alias("__lo"), F.greatest("a", "b").alias("__hi")).agg(F.count("*").alias("__n"), ahead.alias("__way")).where("__n = 1")
    side = lambda one, other: F.when(F.col("__way") > 0, F.col(one)).otherwise(F.col(other))
    return met.select(*by, side("__lo", "__hi").alias("a"), side("__hi", "__lo").alias("b"))


def edge_counts(faces: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, n_edges, open_edges, non_manifold_edges)."""
    return edges(faces, by).groupBy(by).agg(F.count("*").alias("n_edges"), F.count_if(F.col("n") == 1).alias("open_edges"), F.count_if(F.col("n") > 2).alias("non_manifold_edges"))


def bounds(vertices: DataFrame, by: list[str] = JOB) -> DataFrame:
    return vertices.groupBy(by).agg(*[f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))])


def close_to_floor(vertices: DataFrame, faces: DataFrame, floor: float = 0.0, by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """A closed solid of an open height field: the surface, its mirror image at the floor, and two
    wall faces for each edge of a single face, wound so that each edge is used once in each sense."""
    shift = vertices.groupBy(by).agg((F.max("vid") + 1).alias("__n"))
    more = faces.groupBy(by).agg((F.max("fid") + 1).alias("__f"))
    bottom_v = vertices.join(sized(shift), by).withColumns({"vid": F.col("vid") + F.col("__n"), "z": F.lit(floor)}).select(vertices.columns)
    n = sized(shift.join(more, by))
    plus = [(F.col(c) + F.col("__n")).alias(f"v{k}") for k, c in enumerate(("v2", "v1", "v0"))]
    bottom = faces.join(n, by).select(*by, (F.col("fid") + F.col("__f")).alias("fid"), *plus)
    side = F.row_number().over(Window.partitionBy(by).orderBy("a", "b")).cast("long")  # a job's rim grows with its grid's sides
    sides = rim(faces, by).join(n, by).withColumn("__k", F.col("__f") * 2 + 2 * (side - 1))
    a, b, low_a, low_b = F.col("a"), F.col("b"), F.col("a") + F.col("__n"), F.col("b") + F.col("__n")
    face = lambda k, *v: F.struct((F.col("__k") + k).alias("fid"), *[x.alias(f"v{m}") for m, x in enumerate(v)])
    walls = sides.select(*by, F.inline(F.array(face(0, b, a, low_a), face(1, b, low_a, low_b))))
    return vertices.unionByName(bottom_v), faces.select(*by, "fid", "v0", "v1", "v2").unionByName(bottom).unionByName(walls)


#: Bits of the face numbers of a block, whose corners are fetched together.
BLOCK_BITS = 14


def corners(faces: DataFrame, vertices: DataFrame, columns: str | list[str] = "xyz", by: list[str] = JOB) -> DataFrame:
    """faces with p0, p1 and p2: structs of the columns of their vertices; faces of unknown corners are left out.

    Faces are shuffled once, by blocks of their numbers. Neighbours have near numbers and share corners, so a
    block asks once for most of its vertices. Blocks are whole, each in order of fid. Asked for by a merge join: a stored table's packed size would let
    millions of vertices pass for few, and the driver would broadcast them."""
    columns = list(columns)
    dealt = faces.withColumn("__block", F.shiftright(F.col("fid").cast("long"), BLOCK_BITS))
    asked = dealt.select(*by, "__block", *[F.col(f"v{k}").cast("long").alias(f"v{k}") for k in range(3)])
    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in [*by, "__block"])

    def ask(batches):
        key = [*by, "__block"]
        for b in batches:
            rows = pa.concat_tables([pa.table([*[b.column(c) for c in key], b.column(f"v{k}")], names=[*key, "vid"]) for k in range(3)])
            yield from rows.group_by([*key, "vid"]).aggregate([]).select([*key, "vid"]).to_batches()

    places = asked.mapInArrow(ask, f"{kinds}, vid long").join(vertices.select(*by, F.col("vid").cast("long").alias("vid"), *columns).hint("merge"), [*by, "vid"]).select(*by, "__block", "vid", *columns)
    kind = StructType([StructField(c, places.schema[c].dataType) for c in columns])
    schema = StructType([*faces.schema.fields, *[StructField(f"p{k}", kind) for k in range(3)]])

    def fetch(tri: pa.Table, at: pa.Table) -> pa.Table:
        tri = tri.drop_columns("__block").sort_by("fid")
        for k in range(3):
            tri = tri.filter(tri.column(f"v{k}").is_valid())
        vid = at.column("vid").to_numpy()
        order = np.argsort(vid, kind="stable")
        vid = vid[order]
        found = [np.searchsorted(vid, tri.column(f"v{k}").to_numpy()) for k in range(3)]
        whole = np.full(tri.num_rows, len(vid) > 0)
        for k, n in enumerate(found):
            whole[whole] = vid[np.minimum(n[whole], len(vid) - 1)] == tri.column(f"v{k}").to_numpy()[whole]
        tri = tri.filter(pa.array(whole))
        values = [at.column(c).combine_chunks() for c in columns]
        for k, n in enumerate(found):
            rows = pa.array(order[n[whole]] if len(vid) else np.zeros(0, int))
            tri = tri.append_column(f"p{k}", pa.StructArray.from_arrays([x.take(rows) for x in values], names=columns))
        return tri

    return dealt.groupBy(*by, "__block").cogroup(places.groupBy(*by, "__block")).applyInArrow(fetch, schema)


def cross(p0: Column, p1: Column, p2: Column) -> tuple[Column, Column, Column]:
    """The components of (p1 - p0) x (p2 - p0): along the normal, twice the area long."""
    (ax, ay, az), (bx, by, bz) = ([q[c] - p0[c] for c in "xyz"] for q in (p1, p2))
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def volume(faces: DataFrame, vertices: DataFrame | None = None, by: list[str] = JOB) -> DataFrame:
    """(job_id, volume, area) of a closed mesh; its vertices are not asked for if its faces carry p0, p1 and p2."""
    n = cross(F.col("p0"), F.col("p1"), F.col("p2"))
    solid = sum((F.col("p0")[c] * x for c, x in zip("xyz", n, strict=True)), F.lit(0.0)) / F.lit(6.0)
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    placed = faces if "p0" in faces.columns else corners(faces, vertices, by=by)
    return placed.groupBy(by).agg(F.sum(solid).alias("volume"), (F.sum(length) / 2).alias("area"))


def top_faces(faces: DataFrame, vertices: DataFrame, by: list[str] = JOB) -> DataFrame:
    """faces with is_top: the unit normal's upward part is above TOP_NORMAL."""
    n = cross(F.col("p0"), F.col("p1"), F.col("p2"))
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    up = F.when(length > 0, n[2] / length).otherwise(F.lit(0.0))
    return corners(faces, vertices, by=by).select(*faces.columns, (up > TOP_NORMAL).alias("is_top"))


def print_scale(size_mm: float = 200.0, nx: int = 1, ny: int = 1) -> Column:
    """Millimetres a metre, so that the longer side of a tile of the box is size_mm."""
    longer = F.greatest((F.col("max_x") - F.col("min_x")) / F.lit(float(max(1, nx))), (F.col("max_y") - F.col("min_y")) / F.lit(float(max(1, ny))))
    return F.when(longer < 1e-9, F.lit(1.0)).otherwise(F.lit(size_mm) / longer)


def to_print(vertices: DataFrame, size_mm: float = 200.0, nx: int = 1, ny: int = 1, center: bool = True, by: list[str] = JOB) -> DataFrame:
    """Vertices in millimetres: scaled, lowest point BASE_MM above the plate, centred over it."""
    box = bounds(vertices, by).withColumn("__s", print_scale(size_mm, nx, ny))
    s = F.col("__s")
    mid = lambda c: (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 if center else F.lit(0.0)
    moved = {"x": (F.col("x") - mid("x")) * s, "y": (F.col("y") - mid("y")) * s, "z": (F.col("z") - F.col("min_z")) * s + F.lit(BASE_MM)}
    return vertices.join(sized(box), by).withColumns(moved).select(vertices.columns)


def merge_vertices(vertices: DataFrame, faces: DataFrame, digits: int = 8, by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """Vertices at the same place (to `digits` decimals) become the one of smallest number."""
    key = [F.round(c, digits) + F.lit(0.0) for c in "xyz"]
    first = vertices.groupBy(*by, *[k.alias(f"k{n}") for n, k in enumerate(key)]).agg(F.min("vid").alias("to"), F.collect_set("vid").alias("all"))
    moved = stored(first.where(F.size("all") > 1).select(*by, F.explode("all").alias("vid"), "to").where("vid <> to"), "merged")
    out = faces
    for k in range(3):
        to = moved.select(*by, F.col("vid").alias(f"v{k}"), F.col("to").alias("__to"))
        out = out.join(to, [*by, f"v{k}"], "left").withColumn(f"v{k}", F.coalesce("__to", f"v{k}")).drop("__to")
    return vertices.join(moved, [*by, "vid"], "left_anti").select(vertices.columns), out.select(faces.columns)


def clean(vertices: DataFrame, faces: DataFrame, by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """A mesh without faces of no area, repeated faces (the first stays) and unused vertices, its
    coincident vertices merged."""
    vertices, faces = merge_vertices(vertices, faces, by=by)
    n = cross(F.col("p0"), F.col("p1"), F.col("p2"))
    wide = corners(faces, vertices, by=by).where(n[0] * n[0] + n[1] * n[1] + n[2] * n[2] > 0)
    named = wide.select(*by, "fid", "v0", "v1", "v2", F.least("v0", "v1", "v2").alias("__lo"), F.greatest("v0", "v1", "v2").alias("__hi"))
    same = Window.partitionBy(*by, "__lo", (F.col("v0") + F.col("v1") + F.col("v2") - F.col("__lo") - F.col("__hi")), "__hi").orderBy("fid")
    faces = stored(named.withColumn("__nr", F.row_number().over(same)).where("__nr = 1").select(*by, "fid", "v0", "v1", "v2"), "faces")
    return referenced(vertices, faces, by), faces


#: Vertex numbers whose faces are joined up by one task.
BAND = 1 << 16


def parts(faces: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, vid, part): connected parts of a mesh, named by their smallest vertex number."""
    roots = graph.banded(directed_edges(faces, by).select(*by, "a", "b"), by, BAND)
    return roots.select(*by, F.col("node").alias("vid"), F.col("root").alias("part"))


def close_gaps(vertices: DataFrame, faces: DataFrame, by: list[str] = JOB) -> DataFrame:
    """Vertices with the parts of a job moved down, from the lowest up, so that none hovers above
    the top reached so far. A job's parts are few and are folded as one array."""
    part = stored(vertices.join(parts(faces, by), [*by, "vid"]), "parts")
    spans = part.groupBy(*by, "part").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    items = spans.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("low", "part", "high"))).alias("items"))
    zero = F.struct(F.lit(None).cast("double").alias("top"), F.expr("cast(array() AS array<struct<part: bigint, down: double>>)").alias("moves"))

    def step(s, x):
        down = F.when(s["top"].isNotNull() & (x["low"] > s["top"]), x["low"] - s["top"]).otherwise(F.lit(0.0))
        top = F.greatest(F.coalesce(s["top"], x["high"]), x["high"] - down)
        return F.struct(top.alias("top"), F.concat(s["moves"], F.array(F.struct(x["part"].cast("long").alias("part"), down.alias("down")))).alias("moves"))

    moves = items.select(*by, F.explode(F.aggregate("items", zero, step, lambda s: s["moves"])).alias("m")).select(*by, "m.part", "m.down")
    return part.join(sized(moves), [*by, "part"]).withColumn("z", F.col("z") - F.col("down")).select(vertices.columns)


def fused(vertices: DataFrame, faces: DataFrame, size: DataFrame, by: list[str] = JOB) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, facts) of solids whose jobs of several parts are fused: parts that hover
    are moved down, and the job is built anew from voxels of its size (job_id, voxel_mm), which joins
    parts that touch or overlap; parts a voxel and more apart stay apart. facts: job_id, print_component_count, print_fused_by."""
    count = stored(parts(faces, by).groupBy(by).agg(F.count_distinct("part").alias("n")), "part-counts")
    many = count.where("n > 1").select(by)
    if many.isEmpty():
        return vertices, faces, count.select(*by, F.col("n").alias("print_component_count"), F.lit("none").alias("print_fused_by"))
    mv, mf = vertices.join(sized(many), by, "left_semi"), faces.join(sized(many), by, "left_semi")
    lowered = stored(close_gaps(mv, mf, by), "lowered")
    v, f = span_surface(stored(voxel_spans(lowered, mf, size, by), "spans"), size, by)
    v, f = stored(v.join(sized(size), by).select(*by, "vid", "x", "y", "z"), "fused-vertices"), stored(f, "fused-faces")
    after = parts(f, by).groupBy(by).agg(F.count_distinct("part").alias("print_component_count")).withColumn("print_fused_by", F.lit("voxels"))
    kept = count.where("n = 1").select(*by, F.col("n").alias("print_component_count"), F.lit("none").alias("print_fused_by"))
    rest_v, rest_f = vertices.join(sized(many), by, "left_anti"), faces.join(sized(many), by, "left_anti")
    return rest_v.unionByName(v, allowMissingColumns=True), rest_f.select(*by, "fid", "v0", "v1", "v2").unionByName(f.select(*by, "fid", "v0", "v1", "v2")), kept.unionByName(after)


def print_solid(vertices: DataFrame, faces: DataFrame, size_mm: float = 200.0, nx: int = 1, ny: int = 1, center: bool = True, voxel_mm: float | None = None, by: list[str] = JOB, fuse: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(solid vertices, solid faces, surface vertices in mm, facts): a closed print of a surface.

    facts has a row a job: scale, size, voxel size, parts, and open and non-manifold edges. With `fuse`
    a print of several parts is fused.
    """
    used = stored(referenced(vertices, faces, by), "used")
    surface = stored(to_print(used, size_mm, nx, ny, center, by), "surface")
    v, f = clean(*close_to_floor(surface, faces, 0.0, by), by)
    v = stored(v, "solid")
    scale = bounds(used, by).select(*by, print_scale(size_mm, nx, ny).alias("scale_meters_to_print_mm"))
    span = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")
    wanted = voxel_mm if voxel_mm and voxel_mm > 0 else max(0.25, size_mm / 150)
    if fuse:
        size = bounds(v, by).select(*by, clamp_voxel(F.lit(float(wanted)), [span(c) for c in "xyz"], F.lit(float(size_mm))).alias("voxel_mm"))
        v, f, n_parts = fused(v, f, stored(size, "voxel-sizes"), by)
    else:
        n_parts = parts(f, by).groupBy(by).agg(F.count_distinct("part").alias("print_component_count"), F.lit("none").alias("print_fused_by"))
    box = bounds(v, by)
    puzzle = nx * ny > 1
    facts = box.join(scale, by).join(n_parts, by).join(edge_counts(f, by), by).select(
        *by, F.lit(float(size_mm)).alias("print_max_size_mm"), F.lit(nx).alias("print_split_nx"), F.lit(ny).alias("print_split_nz"), F.lit(puzzle).alias("print_scale_for_puzzle_grid"),
        F.lit(float(size_mm) if puzzle else None).cast("double").alias("print_per_tile_target_horizontal_mm"), F.lit(BASE_MM).alias("base_extrusion_mm"), "scale_meters_to_print_mm",
        F.lit(wanted).alias("print_voxel_size_mm"), span("x").alias("size_x_mm"), span("y").alias("size_y_mm"), "print_fused_by",
        F.greatest(span("x"), span("y")).alias("print_xy_extent_max_mm"), "print_component_count", F.col("non_manifold_edges").alias("print_non_manifold_edge_count"), F.col("open_edges").alias("print_open_edge_count"),
    )
    return v, f, surface, facts


def clamp_voxel(size: Column, extents: list[Column], print_size: Column) -> Column:
    """A voxel size of at least VOXEL_LEAST and an 80th of the print, grown by 1.35 up to twelve
    times while the grid has more than VOXEL_CELLS cells."""
    def cells(s):
        out = F.lit(1.0)
        for e in extents:
            out = out * (F.ceil(e / s) + 1)
        return out

    start = F.greatest(size, F.lit(VOXEL_LEAST), print_size / F.lit(80.0)).cast("double")
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, lambda s, _: F.when(cells(s) > VOXEL_CELLS, s * F.lit(1.35)).otherwise(s))


def with_size(df: DataFrame, size: float | DataFrame, by: list[str]) -> DataFrame:
    """df with the voxel size of its job: a number for all, or from a table (job_id, voxel_mm)."""
    return df.join(sized(size.select(*by, "voxel_mm")), by) if isinstance(size, DataFrame) else df.withColumn("voxel_mm", F.lit(float(size)))


def voxels(vertices: DataFrame, faces: DataFrame, size: float | DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, a, b, c): filled voxels of solids."""
    return voxel_spans(vertices, faces, size, by).select(*by, "a", "b", F.explode(F.sequence("first", "last")).alias("c"))


def voxel_spans(vertices: DataFrame, faces: DataFrame, size: float | DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, a, b, first, last): filled voxels of solids as spans of upright lines, by the winding number along
    each line; spans of a line may touch, but share no voxel. size is that of a voxel, or a table (job_id, voxel_mm).

    A line through the middle of each voxel column meets the faces above it. A face that looks down begins
    a solid and one that looks up ends it; the column is filled where more begin than end (or, wound the
    other way round, end than begin). So parts that overlap, touch or hold one another are filled once.
    """
    tri, size = with_size(corners(faces, vertices, by=by), size, by), F.col("voxel_mm")
    low = {c: F.least(*[F.col(f"p{k}")[c] for k in range(3)]) for c in "xy"}
    high = {c: F.greatest(*[F.col(f"p{k}")[c] for k in range(3)]) for c in "xy"}
    first, last = ({c: f(at[c] / size - 0.5).cast("int") for c in "xy"} for f, at in ((F.ceil, low), (F.floor, high)))
    tri = tri.select("*", *[x[c].alias(f"__{n}{c}") for n, x in (("first", first), ("last", last)) for c in "xy"]).where("__firstx <= __lastx AND __firsty <= __lasty")
    spread = lambda c: F.explode(F.sequence(f"__first{c}", f"__last{c}"))
    lines = tri.select(*by, "voxel_mm", "__firsty", "__lasty", "p0", "p1", "p2", spread("x").alias("a")).select("*", spread("y").alias("b"))
    # a nudge off the grid, so that no line runs through an edge or a vertex of a regular mesh
    px, py = (F.col("a") + 0.5 + 1.7e-7) * size, (F.col("b") + 0.5 + 3.1e-7) * size
    p = [(F.col(f"p{k}")["x"], F.col(f"p{k}")["y"]) for k in range(3)]
    u, v, w = geo.barycentric(px, py, *p)
    z = u * F.col("p0")["z"] + v * F.col("p1")["z"] + w * F.col("p2")["z"]
    turn = (p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[1][1] - p[0][1]) * (p[2][0] - p[0][0])
    hits = lines.select(*by, "voxel_mm", "a", "b", z.alias("z"), u.alias("u"), v.alias("v"), w.alias("w"), F.when(turn < 0, 1).otherwise(-1).alias("sign")).where("u >= 0 AND v >= 0 AND w >= 0")
    order = Window.partitionBy(*by, "a", "b").orderBy("z", F.desc("sign"))
    spans = hits.withColumns({"n": F.sum("sign").over(order.rowsBetween(Window.unboundedPreceding, 0)), "to": F.lead("z").over(order)}).where("n <> 0 AND `to` IS NOT NULL")
    first, last = F.ceil(F.col("z") / size - 0.5).cast("int"), F.floor(F.col("to") / size - 0.5).cast("int")
    spans = spans.select(*by, "a", "b", "z", "sign", first.alias("first"), last.alias("last"))
    # spans of a line rise, so only a voxel at the end of one can be met again: it is cut off the next one, and no voxel is shuffled
    below = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("first", F.greatest("first", below + 1)).where("first <= last").select(*by, "a", "b", "first", "last")


def span_sides(spans: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, a, b, n, first, last): where voxels (spans of lines) meet empty space, as spans of squares. n is 2 x axis,
    and 1 more on the far side. Work follows the number of spans, not that of voxels."""
    order = Window.partitionBy(*by, "a", "b").orderBy("first")
    ends = spans.withColumns({"under": F.lag("last").over(order), "over": F.lead("first").over(order)})
    side = lambda n, c: F.struct(F.lit(n).alias("n"), F.col(c).alias("first"), F.col(c).alias("last"))
    low, high = F.coalesce(F.col("under") + 1 == F.col("first"), F.lit(False)), F.coalesce(F.col("over") - 1 == F.col("last"), F.lit(False))
    caps = ends.select(*by, "a", "b", F.inline(F.array_compact(F.array(F.when(~low, side(4, "first")), F.when(~high, side(5, "last"))))))
    # of each two lines that touch, a walk upwards tells where one is filled and the other is not
    event = lambda axis, back, c, one, other: F.struct(F.lit(axis).alias("axis"), (F.col("a") - (back if axis == 0 else 0)).alias("a"), (F.col("b") - (back if axis == 1 else 0)).alias("b"), c.alias("c"), F.lit(one).alias("one"), F.lit(other).alias("other"))
    begins, ends = F.col("first"), F.col("last") + 1
    events = spans.select(*by, F.inline(F.array(*[event(axis, back, c, way * (1 - back), way * back) for axis in (0, 1) for back in (0, 1) for c, way in ((begins, 1), (ends, -1))])))
    pair = Window.partitionBy(*by, "axis", "a", "b").orderBy("c")
    sofar = pair.rowsBetween(Window.unboundedPreceding, 0)
    walk = events.withColumns({"one": F.sum("one").over(sofar), "other": F.sum("other").over(sofar), "to": F.lead("c").over(pair) - 1}).where("c <= `to` AND (one > 0) <> (other > 0)")
    far = F.when(F.col("one") > 0, F.lit(0)).otherwise(F.lit(1))  # the filled line is the second of the two
    walls = walk.select(*by, (F.col("a") + F.when(F.col("axis") == 0, far).otherwise(F.lit(0))).alias("a"), (F.col("b") + F.when(F.col("axis") == 1, far).otherwise(F.lit(0))).alias("b"), (F.col("axis") * 2 + 1 - far).alias("n"), F.col("c").alias("first"), F.col("to").alias("last"))
    return caps.unionByName(walls)


#: Squares of a shell that a task takes.
TASK_SQUARES = 1 << 20


def span_faces(sides: DataFrame, size: float | DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, fid, v0, v1, v2, p0, p1, p2): two faces for each square of sides. Squares are dealt by blocks of lines, so
    that most meet their neighbours where they are made."""
    squares = []
    for axis in range(3):
        for sign in (-1, 1):
            p, q = [k for k in range(3) if k != axis]
            square = [[0, 0, 0] for _ in range(4)]
            for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)]):
                square[k][axis], square[k][p], square[k][q] = int(sign > 0), x, y
            if (sign < 0) != (axis == 1):
                square.reverse()
            squares.append(square)
    total = sides.agg(F.sum(F.col("last").cast("long") - F.col("first") + 1)).first()[0] or 0
    parts_of = max(int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SQUARES))
    dealt = sides.repartition(parts_of, *by, F.floor(F.col("a") / 32), F.floor(F.col("b") / 32))
    struct = lambda values: F.struct(*[F.lit(v).alias(c) for c, v in zip("abc", values, strict=True)])
    table = F.array(*[F.array(*[struct(k) for k in square]) for square in squares])
    cells = with_size(dealt, size, by).select(*by, "voxel_mm", "a", "b", "n", F.explode(F.sequence("first", "last")).alias("c"), F.get(table, F.col("n")).alias("square"))
    point = lambda k: F.struct(*[(F.col(c) + F.col("square")[k][c]).alias(c) for c in "abc"])
    tri = F.array(*[F.struct(F.lit(n).alias("k"), *[point(k).alias(f"q{m}") for m, k in enumerate(t)]) for n, t in enumerate(((0, 1, 2), (0, 2, 3)))])
    tri = cells.select(*by, "voxel_mm", F.struct("a", "b", "c").alias("cell"), "n", F.inline(tri))
    # 20 bits for a and b, 19 for c
    vid = lambda p: ((p["a"].cast("long") + (1 << 19)) * (1 << 20) + p["b"] + (1 << 19)) * (1 << 19) + p["c"] + (1 << 18)
    fid = (vid(F.col("cell")) * 6 + F.col("n")) * 2 + F.col("k")
    place = lambda k: F.struct(*[(F.col(f"q{k}")[c] * F.col("voxel_mm")).alias(x) for c, x in zip("abc", "xyz", strict=True)])
    return tri.select(*by, fid.alias("fid"), *[vid(F.col(f"q{k}")).alias(f"v{k}") for k in range(3)], *[place(k).alias(f"p{k}") for k in range(3)])


def span_surface(spans: DataFrame, size: float | DataFrame, by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): the outside of filled voxels (spans of lines) as a closed mesh of squares, two faces each."""
    faces = span_faces(stored(span_sides(spans, by), "sides"), size, by)
    corner = F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), *[F.col(f"p{k}")[c].alias(c) for c in "xyz"]) for k in range(3)]))
    return faces.select(*by, corner.alias("p")).select(*by, "p.*").distinct(), faces.select(*by, "fid", "v0", "v1", "v2")


def voxel_surface(filled: DataFrame, size: float | DataFrame, by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """As span_surface, of filled voxels (job_id, a, b, c)."""
    run = F.col("c") - F.dense_rank().over(Window.partitionBy(*by, "a", "b").orderBy("c"))
    spans = filled.withColumn("__run", run).groupBy(*by, "a", "b", "__run").agg(F.min("c").alias("first"), F.max("c").alias("last")).drop("__run")
    return span_surface(spans, size, by)


def nearest_vertices(points: DataFrame, vertices: DataFrame, columns: list[str], by: list[str] = JOB) -> DataFrame:
    """points (job_id, pid, x, y) with vid, d2 and columns of the vertex nearest in the plane; of
    equal distances the smaller vid.

    Both sides are dealt to squares about a vertex wide; a point looks at 3 x 3 of them. What is
    found within a square's width is nearest for sure; the other points try squares four times as
    wide, and so on.
    """
    keep = [c for c in columns if c not in (*by, "vid")]
    box = bounds(vertices.withColumn("z", F.lit(0.0)), by).join(vertices.groupBy(by).agg(F.count("*").alias("n")), by)
    across, along = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    wide = F.greatest(across, along, F.lit(1e-9))
    # by the box's area, so that squares of a long and narrow mesh hold few vertices too; by its length where it has no area
    side = F.greatest(2 * F.sqrt(across * along / F.col("n")), 2 * wide / F.col("n"))
    size = stored(box.select(*by, side.alias("size"), (wide * 2).alias("whole"), "min_x", "min_y"), "squares")
    left = points.select(*by, "pid", F.col("x").alias("px"), F.col("y").alias("py"))
    out = None
    while True:
        sq = lambda x, y: [F.floor((F.col(x) - F.col("min_x")) / F.col("size")).alias("sa"), F.floor((F.col(y) - F.col("min_y")) / F.col("size")).alias("sb")]
        near = vertices.join(sized(size), by).select(*by, *sq("x", "y"), "vid", "x", "y", *[F.col(c).alias(f"__{c}") for c in keep])
        moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("m")
        asks = left.join(sized(size), by).select(*by, "pid", "px", "py", "size", "whole", *sq("px", "py"), moves)
        asks = asks.select(*by, "pid", "px", "py", "size", "whole", (F.col("sa") + F.col("m.a")).alias("sa"), (F.col("sb") + F.col("m.b")).alias("sb"))
        d2 = F.pow(F.col("px") - F.col("x"), F.lit(2.0)) + F.pow(F.col("py") - F.col("y"), F.lit(2.0))
        met = asks.join(near, [*by, "sa", "sb"], "left")
        best = met.groupBy(*by, "pid", "px", "py", "size", "whole").agg(F.min(F.when(F.col("vid").isNotNull(), F.struct(d2.alias("d2"), F.col("vid"), *[f"__{c}" for c in keep]))).alias("b"))
        best = stored(best.withColumn("sure", F.coalesce(F.col("b.d2") <= F.col("size") * F.col("size"), F.lit(False))), "nearest")
        found = best.where("sure").select(*by, "pid", "b.vid", "b.d2", *[F.col(f"b.__{c}").alias(c) for c in keep])
        out = found if out is None else out.unionByName(found)
        left = best.where("NOT sure").select(*by, "pid", "px", "py")
        if left.isEmpty():
            return points.join(out, [*by, "pid"])
        size = stored(size.withColumn("size", F.col("size") * 4), "squares")


def heights_at(points: DataFrame, vertices: DataFrame, grid: DataFrame, by: list[str] = JOB) -> DataFrame:
    """points (job_id, pid, x, y) with z, u and v inside the grid quad around them.

    grid has a row a job: h, w, west, north, dx, dy (centre of the first cell and cell sizes). The
    quad's lower-left triangle is tried first; points off the grid are left out.
    """
    fj, fi = (F.col("x") - F.col("west")) / F.col("dx"), (F.col("north") - F.col("y")) / F.col("dy")
    last = lambda f, n: F.least(F.floor(f), F.col(n) - 2).cast("long")
    at = points.join(sized(grid), by).withColumns({"__fi": fi, "__fj": fj}).where("__fi >= 0 AND __fj >= 0 AND __fi <= h - 1 AND __fj <= w - 1")
    at = at.withColumns({"__i": last(F.col("__fi"), "h"), "__j": last(F.col("__fj"), "w")})
    s, t = F.col("__fi") - F.col("__i"), F.col("__fj") - F.col("__j")
    a = F.col("__i") * F.col("w") + F.col("__j")
    lower = s + t <= 1
    three = F.when(lower, F.array(F.struct(a.alias("vid"), (1 - s - t).alias("k")), F.struct((a + F.col("w")).alias("vid"), s.alias("k")), F.struct((a + 1).alias("vid"), t.alias("k"))))
    three = three.otherwise(F.array(F.struct((a + F.col("w")).alias("vid"), (1 - t).alias("k")), F.struct((a + F.col("w") + 1).alias("vid"), (s + t - 1).alias("k")), F.struct((a + 1).alias("vid"), (1 - s).alias("k"))))
    parts_of = at.select(*by, "pid", "x", "y", F.inline(three))
    met = parts_of.join(vertices.select(*by, "vid", "z", "u", "v"), [*by, "vid"])
    return met.groupBy(*by, "pid", "x", "y").agg(*[F.sum(F.col("k") * F.col(c)).alias(c) for c in "zuv"])


def tile_of(x: Column, y: Column, nx: int, ny: int) -> dict[str, Column]:
    """Tile column, row and number (1 + ix + iy nx) of a place in the padded box of a job."""
    part = lambda c, v, n: F.least(F.greatest(F.floor((v - (F.col(f"min_{c}") - TILE_PAD)) / ((F.col(f"max_{c}") - F.col(f"min_{c}") + 2 * TILE_PAD) / n)), F.lit(0)), F.lit(n - 1)).cast("int")
    ix, iy = part("x", x, nx), part("y", y, ny)
    return {"ix": ix, "iy": iy, "tile": 1 + ix + iy * nx}


def assign_tiles(faces: DataFrame, vertices: DataFrame, nx: int, ny: int, by: list[str] = JOB) -> DataFrame:
    """faces with ix, iy and tile of their centre."""
    mid = lambda c: (F.col("p0")[c] + F.col("p1")[c] + F.col("p2")[c]) / F.lit(3.0)
    return corners(faces, vertices, by=by).join(sized(bounds(vertices, by)), by).withColumns(tile_of(mid("x"), mid("y"), nx, ny)).select(*faces.columns, "ix", "iy", "tile")


SAMPLES = [(1 / 3, 1 / 3, 1 / 3), (2 / 3, 1 / 6, 1 / 6), (1 / 6, 2 / 3, 1 / 6), (1 / 6, 1 / 6, 2 / 3)]


def label_faces(faces: DataFrame, vertices: DataFrame, labels: DataFrame, base: int = 0, by: list[str] = JOB) -> DataFrame:
    """faces (with is_top, if all should not count as tops) with label: the label found most often
    at four places of the face in the labelled image (job_id, i, j, label), of equal ones the least;
    other faces are the base."""
    top = F.col("is_top") if "is_top" in faces.columns else F.lit(True)
    tri = corners(faces.where(top), vertices, "uv", by).join(sized(grid_size(labels, by)), by)
    spot = lambda s, c: sum((F.col(f"p{k}")[c] * F.lit(s[k]) for k in range(3)), F.lit(0.0))
    cell = lambda x, n: F.greatest(F.lit(0), F.least(x.cast("int"), (F.col(n) - 1).cast("int")))
    at = F.inline(F.array(*[F.struct(cell((F.lit(1.0) - spot(s, "v")) * F.col("h"), "h").alias("i"), cell(spot(s, "u") * F.col("w"), "w").alias("j")) for s in SAMPLES]))
    votes = tri.select(*by, "fid", at).join(labels.select(*by, "i", "j", "label"), [*by, "i", "j"])
    counts = votes.groupBy(*by, "fid", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy(*by, "fid").agg(F.min(F.struct((-F.col("n")).alias("less"), "label"))["label"].alias("label"))
    return faces.join(best, [*by, "fid"], "left").withColumn("label", F.coalesce("label", F.lit(base)).cast("int"))


def submeshes(faces: DataFrame, by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """(faces, numbers): faces with each label's vertices numbered anew from 0, and the table
    (job_id, label, vid, number) of those numbers. A label's vertices are ranked by a count over
    ranges of 4096 numbers, so no label is sorted in one task."""
    faces = stored(faces, "labelled")
    used = faces.select(*by, "label", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().withColumn("block", F.floor(F.col("vid") / 4096))
    blocks = used.groupBy(*by, "label", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy(*by, "label", "block").orderBy("vid"))
    numbers = stored(used.join(blocks.select(*by, "label", "block", before.alias("before")), [*by, "label", "block"]).select(*by, "label", "vid", (F.col("before") + inner - 1).alias("number")), "numbers")
    out = faces
    for k in range(3):
        out = out.join(numbers.select(*by, "label", F.col("vid").alias(f"v{k}"), F.col("number").alias(f"__{k}")), [*by, "label", f"v{k}"])
    return out.select(*by, "label", "fid", *[F.col(f"__{k}").alias(f"v{k}") for k in range(3)]), numbers


def vertex_colors(faces: DataFrame, palette: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, vid, r, g, b): the colour of the last corner and face that a vertex has, corners
    counted first, then faces."""
    corner = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("vid")) for k in range(3)]))
    last = faces.select(*by, "fid", "label", corner).groupBy(*by, "vid").agg(F.max_by("label", F.struct("k", "fid")).alias("index"))
    return last.join(sized(palette.select(*by, "index", "r", "g", "b")), [*by, "index"]).select(*by, "vid", "r", "g", "b")


def numbered(vertices: DataFrame, faces: DataFrame, by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """The mesh with vertex numbers 0, 1, ... without gaps, in the order they had. A mesh that has such numbers
    stays as it is."""
    if vertices.groupBy(by).agg(F.min("vid").alias("lo"), F.max("vid").alias("hi"), F.count("*").alias("n")).where("lo <> 0 OR hi <> n - 1").isEmpty():
        return vertices, faces
    blocked = vertices.withColumn("__block", F.floor(F.col("vid") / 4096))
    counts = blocked.groupBy(*by, "__block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*by, "__block").orderBy("vid"))
    new = blocked.join(counts.select(*by, "__block", before.alias("__before")), [*by, "__block"]).withColumn("__new", F.col("__before") + rank - 1)
    new = stored(new.drop("__block", "__before"), "numbered")
    # places that faces carry stay with them
    found = corners(faces.withColumnsRenamed({f"p{k}": f"__p{k}" for k in range(3)}), new, ["__new"], by)
    out = found.withColumns({f"v{k}": F.col(f"p{k}.__new") for k in range(3)}).drop("p0", "p1", "p2").withColumnsRenamed({f"__p{k}": f"p{k}" for k in range(3)})
    return new.withColumn("vid", F.col("__new")).select(vertices.columns), out.select(faces.columns)
