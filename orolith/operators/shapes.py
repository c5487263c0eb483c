"""Polygons and rasters: validation, rasterising, tests of quads and points, cuts and outlines.

A shape is a row (job_id, ord, id, source, ring), the ring an array of (x, y) structs without a
repeated last corner. On rasters x is the column and y the row, downwards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.functions import geo
from orolith.operators import mesh, raster
from orolith.operators.raster import JOB
from orolith.storage import sized, stored

#: Shapes of a job that a review takes, least cells of an outline, and how far simplified outlines may stray.
MOST_SHAPES, LEAST_CELLS, STRAY = 64, 12, 1.5
POINT = "struct<x: double, y: double>"


def valid_shapes(shapes: DataFrame, sizes: DataFrame, most: int = MOST_SHAPES, by: list[str] = JOB) -> DataFrame:
    """The first `most` shapes of a job that are good, corners moved into its raster (sizes: h, w).

    Corners without both numbers go; a shape needs three corners and an area of 1. A shape without
    an id gets one from a hash of its corners, and an unknown source becomes `manual`.
    """
    inside = lambda v, n: F.greatest(F.lit(0.0), F.least(v, (F.col(n) - 1).cast("double")))
    whole = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    ring = F.transform(whole, lambda p: F.struct(inside(p["x"], "w").alias("x"), inside(p["y"], "h").alias("y")))
    out = shapes.join(sized(sizes), by).withColumn("ring", ring).where(F.size("ring") >= 3).where(F.abs(geo.ring_area(F.col("ring"))) >= 1)
    name = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.sha2(F.to_json("ring"), 256))
    source = F.when(F.col("source").isin("auto", "manual"), F.col("source")).otherwise(F.lit("manual"))
    return out.withColumns({"id": name, "source": source, "__k": F.row_number().over(Window.partitionBy(by).orderBy("ord"))}).where(F.col("__k") <= most).select(*by, "ord", "id", "source", "ring")


def span(ring: Column, axis: str, most: bool) -> Column:
    of = F.transform(ring, lambda p: p[axis])
    return F.array_max(of) if most else F.array_min(of)


def rasterize(shapes: DataFrame, sizes: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j): the cells whose centre is in some shape.

    A shape is spread over the rows of its box; for each row the sorted crossings of its sides give
    the runs of cells. So work follows the shapes' height and area, not shapes times cells.
    """
    low, high = (F.greatest(F.lit(0), F.ceil(span(F.col("ring"), "y", False) - 0.5)).cast("int"), F.least(F.col("h") - 1, F.floor(span(F.col("ring"), "y", True) - 0.5)).cast("int"))
    rows = shapes.join(sized(sizes), by).select(*by, "w", "ring", low.alias("a"), high.alias("b")).where("a <= b").select(*by, "w", "ring", F.explode(F.sequence("a", "b")).alias("i"))
    y, n = F.col("i") + F.lit(0.5), F.size("ring")

    def crossing(k):
        p, q = F.get("ring", k), F.get("ring", (k + 1) % n)
        return F.when((p["y"] > y) != (q["y"] > y), p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]))

    cuts = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), crossing)))
    runs = rows.select(*by, "i", "w", cuts.alias("x")).where(F.size("x") >= 2).select(*by, "i", "w", F.posexplode("x").alias("k", "from"), "x").where("k % 2 = 0")
    first = F.greatest(F.lit(0), F.ceil(F.col("from") - 0.5)).cast("int")
    to = F.element_at("x", F.col("k") + 2) - 0.5
    last = F.least((F.col("w") - 1).cast("int"), F.when(F.ceil(to) == to, F.ceil(to) - 1).otherwise(F.floor(to)).cast("int"))
    return runs.select(*by, "i", first.alias("a"), last.alias("b")).where("a <= b").select(*by, "i", F.explode(F.sequence("a", "b")).alias("j")).distinct()


def polygon_mask(shapes: DataFrame, sizes: DataFrame, footprint: DataFrame | None = None, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j) of the cells in valid shapes, and in the footprint (job_id, i, j) if given."""
    out = rasterize(valid_shapes(shapes, sizes, by=by), sizes, by)
    return out if footprint is None else out.join(footprint.select(*by, "i", "j").distinct(), [*by, "i", "j"], "left_semi")


def sides_cross(ax: Column, ay: Column, bx: Column, by_: Column, p: Column, q: Column) -> Column:
    """Whether the segments a-b and p-q meet."""
    turn = lambda ox, oy, sx, sy, tx, ty: (sx - ox) * (ty - oy) - (sy - oy) * (tx - ox)
    d1, d2 = turn(p["x"], p["y"], q["x"], q["y"], ax, ay), turn(p["x"], p["y"], q["x"], q["y"], bx, by_)
    d3, d4 = turn(ax, ay, bx, by_, p["x"], p["y"]), turn(ax, ay, bx, by_, q["x"], q["y"])
    on = lambda d, sx, sy, tx, ty, x, y: (d == 0) & x.between(F.least(sx, tx), F.greatest(sx, tx)) & y.between(F.least(sy, ty), F.greatest(sy, ty))
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)
    return proper | on(d1, p["x"], p["y"], q["x"], q["y"], ax, ay) | on(d2, p["x"], p["y"], q["x"], q["y"], bx, by_) | on(d3, ax, ay, bx, by_, p["x"], p["y"]) | on(d4, ax, ay, bx, by_, q["x"], q["y"])


def box_state(x0: Column, y0: Column, x1: Column, y1: Column, ring: Column) -> Column:
    """2 if the box is inside the ring, 1 if its outline meets the ring's or holds it, else 0."""
    n = F.size(ring)
    sides = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]

    def meets(k):
        p, q = F.get(ring, k), F.get(ring, (k + 1) % n)
        apart = (F.greatest(p["x"], q["x"]) < x0) | (F.least(p["x"], q["x"]) > x1) | (F.greatest(p["y"], q["y"]) < y0) | (F.least(p["y"], q["y"]) > y1)
        hit = p["x"].between(x0, x1) & p["y"].between(y0, y1)
        for ax, ay, bx, by_ in sides:
            hit = hit | sides_cross(ax, ay, bx, by_, p, q)
        return ~apart & hit

    return F.when(F.exists(F.sequence(F.lit(0), n - 1), meets), 1).when(geo.inside_ring((x0 + x1) / 2, (y0 + y1) / 2, ring), 2).otherwise(0)


def near_box(x0: Column, y0: Column, x1: Column, y1: Column, ring: Column) -> Column:
    return (x1 >= span(ring, "x", False)) & (x0 <= span(ring, "x", True)) & (y1 >= span(ring, "y", False)) & (y0 <= span(ring, "y", True))


def quad_states(cells: DataFrame, boundaries: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, h, w, x0, y0, x1, y1, ring, state) for the quads of a grid (x, y at centres)
    that touch their job's boundary (job_id, ring): state 2 inside it, 1 cut by it."""
    corner = mesh.grid_quads(cells, by).join(cells.select(*by, "i", "j", F.col("x").alias("x0"), F.col("y").alias("y1")), [*by, "i", "j"])
    far = cells.select(*by, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("x").alias("x1"), F.col("y").alias("y0"))
    quads = corner.join(far, [*by, "i", "j"]).join(sized(boundaries.select(*by, "ring")), by)
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return quads.where(near_box(*box, F.col("ring"))).withColumn("state", box_state(*box, F.col("ring"))).where("state > 0")


def quad_mask(cells: DataFrame, boundaries: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, included): every quad, with whether it meets the boundary."""
    met = quad_states(cells, boundaries, by).select(*by, "i", "j", F.lit(True).alias("included"))
    return mesh.grid_quads(cells, by).select(*by, "i", "j").join(met, [*by, "i", "j"], "left").withColumn("included", F.coalesce("included", F.lit(False)))


def touched(cells: DataFrame, boundaries: DataFrame, by: list[str] = JOB) -> DataFrame:
    """The cells (x, y at centres, dx, dy their sizes) of which any part is in the boundary."""
    x0, x1 = F.col("x") - F.col("dx") / 2, F.col("x") + F.col("dx") / 2
    y0, y1 = F.col("y") - F.col("dy") / 2, F.col("y") + F.col("dy") / 2
    near = cells.join(sized(boundaries.select(*by, "ring")), by).where(near_box(x0, y0, x1, y1, F.col("ring")))
    return near.where(box_state(x0, y0, x1, y1, F.col("ring")) > 0).select(cells.columns)


def closed_mask(cells: DataFrame, radius: float, by: list[str] = JOB) -> DataFrame:
    """Morphological closing of cells (job_id, i, j) with a disc of `radius` cells: what a disc that
    stays off the cells cannot reach. It rounds inner corners as growing and shrinking does."""
    reach = int(radius)
    disc = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= radius * radius]
    moves = F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc]))
    grown = stored(cells.select(*by, "i", "j", moves).select(*by, (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).distinct(), "grown")
    # a cell stays if all of its disc is grown
    kept = grown.select(*by, "i", "j", moves).select(*by, "i", "j", (F.col("i") + F.col("a")).alias("ni"), (F.col("j") + F.col("b")).alias("nj"))
    other = grown.select(*by, F.col("i").alias("ni"), F.col("j").alias("nj"))
    return kept.join(other, [*by, "ni", "nj"]).groupBy(*by, "i", "j").agg(F.count("*").alias("n")).where(F.col("n") == len(disc)).select(*by, "i", "j")


def smooth_radius(west: Column, south: Column, east: Column, north: Column, width: Column, height: Column) -> Column:
    """The default smoothing of a boundary in metres: three quarters of the longer cell side."""
    return F.lit(0.75) * F.greatest((east - west) / F.greatest(width - 1, F.lit(1)), (north - south) / F.greatest(height - 1, F.lit(1)))


def cut_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The part of a ring inside a box, one side of the box after the other."""
    for axis, sign, at in ((0, 1, box[0]), (0, -1, box[2]), (1, 1, box[1]), (1, -1, box[3])):
        out = []
        for k, q in enumerate(ring):
            p = ring[k - 1]
            dp, dq = sign * (p[axis] - at), sign * (q[axis] - at)
            if (dp < 0) != (dq < 0):
                t = dp / (dp - dq)
                cross = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
                cross[axis] = at
                out.append(tuple(cross))
            if dq >= 0:
                out.append(q)
        ring = out
    return ring


def area2(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def ears(ring: list[tuple[float, float]]) -> list[tuple]:
    """Triangles of a simple ring, counter-clockwise, by cutting ears."""
    pts = [p for k, p in enumerate(ring) if math.dist(p, ring[k - 1]) > 1e-12]
    if len(pts) < 3:
        return []
    if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1], strict=True)) < 0:
        pts.reverse()
    out = []
    while len(pts) > 3:
        best = None
        for k in range(len(pts)):
            a, b, c = pts[k - 1], pts[k], pts[(k + 1) % len(pts)]
            turn = area2(a, b, c)
            if turn <= 0:
                if turn == 0:
                    best = best or (k, False)
                continue
            if not any(area2(a, b, p) > 0 and area2(b, c, p) > 0 and area2(c, a, p) > 0 for p in pts if p not in (a, b, c)):
                best = (k, True)
                break
        if best is None:
            break
        k, real = best
        if real:
            out.append((pts[k - 1], pts[k], pts[(k + 1) % len(pts)]))
        del pts[k]
    if len(pts) == 3 and area2(*pts) > 0:
        out.append(tuple(pts))
    return out


def cut_quads(frames):
    """Triangles (k, x0, y0, x1, y1, x2, y2) of each quad's part inside its ring."""
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            part = cut_ring([(p["x"], p["y"]) for p in r.ring], (r.x0, r.y0, r.x1, r.y1))
            for k, t in enumerate(t for t in ears(part) if area2(*t) > 2 * mesh.SLIVER):
                rows.append((r.job_id, r.quad, k, *t[0], *t[1], *t[2]))
        yield pd.DataFrame(rows, columns=["job_id", "quad", "k", "ax", "ay", "bx", "by", "cx", "cy"])


def clipped_mesh(cells: DataFrame, boundaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a grid (job_id, i, j, x, y, z at centres) inside its job's boundary.

    Quads inside keep both faces. Quads that the boundary cuts are cut to it and triangulated; corners
    of a cut within CORNER of a grid vertex are that vertex, others are told apart by millimetres and
    get the height of the first quad that has them.
    """
    by = JOB
    states = stored(quad_states(cells, boundaries, by), "quads")
    whole = mesh.quad_faces(states.where("state = 2").select(*by, "i", "j", "h", "w"), by)
    number = F.col("i") * (F.col("w") - 1) + F.col("j")
    cut = states.where("state = 1").select(*by, number.cast("long").alias("quad"), "x0", "y0", "x1", "y1", "ring")
    tri = stored(cut.mapInPandas(cut_quads, "job_id string, quad long, k int, ax double, ay double, bx double, by double, cx double, cy double"), "cut-faces")
    grid_v = mesh.grid_vertices(cells, by)
    place = F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y")) for n, c in enumerate("abc")]))
    at = tri.select(*by, "quad", "k", place)
    frame = states.where("state = 1").select(*by, number.cast("long").alias("quad"), "i", "j", "w", "x0", "y0", "x1", "y1").distinct()
    at = at.join(frame, [*by, "quad"])
    near = lambda v, c: F.abs(F.col(v) - F.col(c)) <= mesh.CORNER
    vid = lambda a, b: ((F.col("i") + a) * F.col("w") + F.col("j") + b).cast("long")
    corner = F.when(near("x", "x0") & near("y", "y1"), vid(0, 0)).when(near("x", "x0") & near("y", "y0"), vid(1, 0)).when(near("x", "x1") & near("y", "y0"), vid(1, 1)).when(near("x", "x1") & near("y", "y1"), vid(0, 1))
    key = [F.bround(c, mesh.KEY_DIGITS).alias(f"k{c}") for c in "xy"]
    at = stored(at.select(*by, "quad", "k", "n", "x", "y", corner.alias("vid"), *key), "cut-corners")
    new = at.where("vid IS NULL").groupBy(*by, "kx", "ky").agg(F.min(F.struct("quad", "k", "n", "x", "y")).alias("f")).select(*by, "kx", "ky", "f.*")
    first = grid_v.groupBy(by).agg((F.max("vid") + 1).alias("__n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("quad", "k", "n"))  # a job's new corners lie along its boundary
    new = stored(new.join(sized(first), by).select(*by, "kx", "ky", "x", "y", (F.col("__n") + rank - 1).cast("long").alias("pid")), "new-corners")
    size = mesh.grid_size(cells, by)
    edge = cells.groupBy(by).agg(F.min("x").alias("west"), F.max("y").alias("north"), F.max("x").alias("east"), F.min("y").alias("south"))
    grid = edge.join(size, by).select(*by, "h", "w", "west", "north", ((F.col("east") - F.col("west")) / (F.col("w") - 1)).alias("dx"), ((F.col("north") - F.col("south")) / (F.col("h") - 1)).alias("dy"))
    snapped = lambda c, a, b: F.greatest(F.col(a), F.least(F.col(b), F.col(c)))
    asks = new.join(sized(edge), by).select(*by, "pid", snapped("x", "west", "east").alias("x"), snapped("y", "south", "north").alias("y"))
    made = mesh.heights_at(asks, grid_v, grid, by).select(*by, F.col("pid").alias("vid"), "x", "y", "z", "u", "v")
    ids = at.join(new.select(*by, "kx", "ky", "pid"), [*by, "kx", "ky"], "left").select(*by, "quad", "k", "n", F.coalesce("vid", "pid").alias("vid"))
    part = ids.groupBy(*by, "quad", "k").agg(*[F.max(F.when(F.col("n") == n, F.col("vid"))).alias(f"v{n}") for n in range(3)])
    offset = whole.groupBy(by).agg((F.max("fid") + 1).alias("__f"))
    part = part.join(sized(offset), by, "left").where("v0 <> v1 AND v1 <> v2 AND v0 <> v2")
    fid = F.coalesce("__f", F.lit(0).cast("long")) + F.row_number().over(Window.partitionBy(by).orderBy("quad", "k")) - 1
    faces = stored(whole.unionByName(part.select(*by, fid.cast("long").alias("fid"), "v0", "v1", "v2")), "faces")
    return mesh.referenced(grid_v.unionByName(made), faces, by), faces


def simplified(ring: np.ndarray, stray: float) -> np.ndarray:
    """A closed ring thinned so that no dropped corner is farther than `stray` from it."""
    if len(ring) < 4:
        return ring
    a = 0
    b = int(((ring - ring[a]) ** 2).sum(1).argmax())
    keep, closed = {a, b}, np.vstack([ring, ring[:1]])
    work = [(a, b), (b, len(ring))]
    while work:
        i, j = work.pop()
        if j - i < 2:
            continue
        p, q = closed[i], closed[j]
        inner, d = closed[i + 1 : j], q - p
        length = float(np.hypot(*d))
        off = np.abs(d[0] * (inner[:, 1] - p[1]) - d[1] * (inner[:, 0] - p[0])) / length if length else np.hypot(*(inner - p).T)
        k = int(off.argmax())
        if off[k] > stray:
            keep.add(i + 1 + k)
            work += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[sorted(k for k in keep if k < len(ring))]


def outline(stray: float):
    """The longest outline of one blob from its border sides, thinned."""

    def run(sides: pd.DataFrame) -> pd.DataFrame:
        sides = sides.sort_values(["i", "j", "di", "dj"])
        after: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, j, di, dj in sides[["i", "j", "di", "dj"]].itertuples(index=False):
            after.setdefault((i, j), []).append((i + di, j + dj))
        best: list[tuple[int, int]] = []
        while after:
            start = min(after)
            here, ring, came = start, [], (0, 0)
            while here in after:
                ring.append(here)
                # where two outlines touch, turn to the right and so keep to the blob's own cells
                nxt = max(after[here], key=lambda p: came[0] * (p[1] - here[1]) * -1 + came[1] * (p[0] - here[0])) if len(after[here]) > 1 else after[here][0]
                after[here].remove(nxt)
                if not after[here]:
                    del after[here]
                came, here = (nxt[0] - here[0], nxt[1] - here[1]), nxt
            if len(ring) > len(best):
                best = ring
        ring = simplified(np.array([(j, i) for i, j in best], dtype=float), stray)
        first = sides.iloc[0]
        return pd.DataFrame({"job_id": [first.job_id], "blob_i": [first.blob_i], "blob_j": [first.blob_j], "ring": [[{"x": float(x), "y": float(y)} for x, y in ring]]})

    return run


def outlines(members: DataFrame, least: int = LEAST_CELLS, stray: float = STRAY) -> DataFrame:
    """Shapes of all blobs (job_id, i, j, blob_i, blob_j) of at least `least` cells: their border in
    corner coordinates, thinned. A group is the border of one blob of one raster."""
    key = ["job_id", "blob_i", "blob_j"]
    sized_blobs = members.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    cells = members.select(*key, "i", "j").join(sized_blobs.select(key), key, "left_semi")
    # each side of a cell runs clockwise around it: (from corner, step, neighbour beyond)
    sides = [(0, 0, 0, 1, -1, 0), (0, 1, 1, 0, 0, 1), (1, 1, 0, -1, 1, 0), (1, 0, -1, 0, 0, -1)]
    side = F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "di", "dj", "ni", "nj"), s, strict=True)]) for s in sides]))
    border = cells.select(*key, "i", "j", side).select(*key, (F.col("i") + F.col("a")).alias("ci"), (F.col("j") + F.col("b")).alias("cj"), "di", "dj", (F.col("i") + F.col("ni")).alias("i"), (F.col("j") + F.col("nj")).alias("j"))
    border = border.join(cells, [*key, "i", "j"], "left_anti").select(*key, F.col("ci").cast("int").alias("i"), F.col("cj").cast("int").alias("j"), "di", "dj")
    rings = border.groupBy(key).applyInPandas(outline(stray), f"job_id string, blob_i int, blob_j int, ring array<{POINT}>")
    good = rings.where(F.size("ring") >= 3).where(F.abs(geo.ring_area(F.col("ring"))) >= least)
    order = F.row_number().over(Window.partitionBy("job_id").orderBy("blob_i", "blob_j"))
    return good.withColumn("ord", order).select("job_id", "ord", F.sha2(F.to_json("ring"), 256).alias("id"), F.lit("auto").alias("source"), "ring")


def delete_at(shapes: DataFrame, clicks: DataFrame, by: list[str] = JOB) -> DataFrame:
    """Shapes without the last drawn one around each job's click (job_id, x, y)."""
    hit = shapes.join(sized(clicks), by).where(geo.inside_ring(F.col("x"), F.col("y"), F.col("ring")))
    gone = hit.groupBy(*by, "x", "y").agg(F.max("ord").alias("ord")).select(*by, "ord").distinct()
    return shapes.join(gone, [*by, "ord"], "left_anti").select(shapes.columns)


def append_drawn(shapes: DataFrame, drafts: DataFrame, by: list[str] = JOB) -> DataFrame:
    """Shapes (job_id, ord, id, source, ring) with each job's finished drafts (job_id, n, ring) after its
    last one, in order of n; a draft of fewer than three corners is left out."""
    last = shapes.groupBy(by).agg(F.max("ord").alias("__last"))
    whole = drafts.where(F.size("ring") >= 3).join(last, by, "left")
    ord_ = F.coalesce("__last", F.lit(-1)) + F.row_number().over(Window.partitionBy(by).orderBy("n"))
    name = F.sha2(F.concat(ord_.cast("string"), F.lit(":"), F.to_json("ring")), 256)
    fresh = whole.select(*by, ord_.cast("long").alias("ord"), name.alias("id"), F.lit("manual").alias("source"), "ring")
    return shapes.select(*by, F.col("ord").cast("long").alias("ord"), "id", "source", "ring").unionByName(fresh)


def soft_alpha(cells: DataFrame, sigma: float | DataFrame = 1.25, by: list[str] = JOB) -> DataFrame:
    """(job_id, i, j, alpha): alpha 0..255 blurred and cut to whole numbers."""
    soft = raster.gaussian(cells, F.col("alpha"), sigma, by)
    return soft.select(*by, "i", "j", F.floor(F.least(F.greatest(F.col("blurred"), F.lit(0.0)), F.lit(255.0)) + 1e-6).cast("int").alias("alpha"))
