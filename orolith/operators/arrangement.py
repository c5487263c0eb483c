"""Rings as arrangements of segments: union, repair of rings that cross themselves, and offsets.

Corners are moved to a lattice of 2^29 steps over a job's box, so that all turns are exact in 64-bit integers. Segments
that share a grid cell are compared, cut where they meet (crossings go to the nearest lattice point, so it is done again
until nothing meets but at ends), and equal ones are added up. A piece's winding number on either side is the sum of the pieces that
a ray from its middle crosses, found by bands. Pieces with the inside on one side alone bound the result and are walked to loops,
a task having whole boundaries, many small ones at once.

Defined results: rings of fewer than three different corners have no area and bound nothing; null rings and corners with a null are left out;
repeated rings count once in a union; outer rings run counter-clockwise and come with a positive area, holes clockwise with a negative one;
an empty table gives none. Results lie within a step of the lattice of the exact ones for each cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.functions import geo
from orolith.operators import polygons
from orolith.operators.raster import JOB
from orolith.storage import sized, stored

#: Steps of the lattice over the longer side of a job's box, and rounds of cutting.
STEPS, ROUNDS = 1 << 29, 12
ENDS = ["ax", "ay", "bx", "by"]


def segments(rings: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, ax, ay, bx, by) on the lattice, and the lattice (by, x0, y0, step, x, y, px, py) of each job: px and py are
    where its corners x and y stood."""
    whole = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rings = rings.select(*by, whole.alias("ring")).where(F.size("ring") > 2)
    points = rings.select(*by, F.inline("ring"))
    box = points.groupBy(by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    lattice = stored(box.select(*by, "x0", "y0", (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)) / STEPS).alias("step")), "lattice")
    place = lambda v, c: F.round((v - F.col(f"{c}0")) / F.col("step")).cast("long")
    n = F.size("ring")
    side = F.transform("ring", lambda p, k: F.struct(place(p["x"], "x").alias("ax"), place(p["y"], "y").alias("ay"), place(F.get("ring", (k + 1) % n)["x"], "x").alias("bx"), place(F.get("ring", (k + 1) % n)["y"], "y").alias("by")))
    out = rings.join(sized(lattice), by).select(*by, F.explode(side).alias("s")).select(*by, *[F.col(f"s.{c}") for c in ENDS])
    corners = points.join(sized(lattice), by).groupBy(*by, "x0", "y0", "step", place(F.col("x"), "x").alias("lx"), place(F.col("y"), "y").alias("ly")).agg(F.min(F.struct("x", "y")).alias("p"))
    return summed(out, by), corners.select(*by, "x0", "y0", "step", F.col("lx").alias("ax"), F.col("ly").alias("ay"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def summed(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Pieces from the smaller end to the larger one with m: how often they run that way, less how often back."""
    ahead = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    m = F.col("m") if "m" in pieces.columns else F.lit(1)
    turned = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(ENDS, ["bx", "by", "ax", "ay"], strict=True)]
    out = pieces.where("ax <> bx OR ay <> by").select(*by, *turned, F.when(ahead, m).otherwise(-m).alias("m"))
    return out.groupBy(*by, *ENDS).agg(F.sum("m").cast("int").alias("m")).where("m <> 0")


def turn(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column]) -> Column:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def cut(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Pieces cut wherever they meet one another, by the compared pairs of one grid cell."""
    for _ in range(ROUNDS):
        pieces = stored(pieces.withColumn("s", F.xxhash64(*ENDS)), "pieces")
        size = pieces.groupBy(by).agg(F.greatest(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))) * 2, F.lit(STEPS / 2048)).cast("long").alias("cell"))
        spread = pieces.join(sized(stored(size, "cells")), by).withColumn("ci", F.explode(F.sequence(F.floor(F.col("ax") / F.col("cell")), F.floor(F.col("bx") / F.col("cell")))))
        # of a column of cells only those that the piece runs through, and what rounding may add
        rise = (F.col("by") - F.col("ay")) / F.greatest(F.col("bx") - F.col("ax"), F.lit(1))
        height = lambda x: F.when(F.col("ax") == F.col("bx"), F.lit(None)).otherwise(F.col("ay") + rise * (x - F.col("ax")))
        here, there = F.coalesce(height(F.greatest("ax", F.col("ci") * F.col("cell"))), "ay"), F.coalesce(height(F.least("bx", (F.col("ci") + 1) * F.col("cell"))), "by")
        rows = F.sequence(F.floor((F.least(here, there) - 2) / F.col("cell")), F.floor((F.greatest(here, there) + 2) / F.col("cell")))
        spread = spread.withColumn("cj", F.explode(rows)).drop("cell", "m")
        other = spread.withColumnsRenamed({c: f"o{c}" for c in (*ENDS, "s")})
        met = spread.join(other, [*by, "ci", "cj"]).where("s <> os AND least(oax, obx) <= greatest(ax, bx) AND greatest(oax, obx) >= least(ax, bx) AND least(oay, oby) <= greatest(ay, by) AND greatest(oay, oby) >= least(ay, by)")
        a, b, p, q = ((F.col(f"{e}x"), F.col(f"{e}y")) for e in ("a", "b", "oa", "ob"))
        d1, d2, d3, d4 = turn(p, q, a), turn(p, q, b), turn(a, b, p), turn(a, b, q)
        proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
        t = d1.cast("double") / (d1.cast("double") - d2.cast("double"))
        cross = F.struct(*[(a[k] + F.round((b[k] - a[k]) * t).cast("long")).alias(c) for k, c in enumerate("xy")])
        on = lambda d, r: F.when((d == 0) & r[0].between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & r[1].between(F.least(a[1], b[1]), F.greatest(a[1], b[1])), F.struct(r[0].alias("x"), r[1].alias("y")))
        # both of a crossing pair must be cut at one place: that of the pair in order
        first = F.col("s") < F.col("os")
        u = d3.cast("double") / (d3.cast("double") - d4.cast("double"))
        mirrored = F.struct(*[(p[k] + F.round((q[k] - p[k]) * u).cast("long")).alias(c) for k, c in enumerate("xy")])
        places = F.array(F.when(proper, F.when(first, cross).otherwise(mirrored)), on(d3, p), on(d4, q))
        found = met.select(*by, "s", F.explode(F.array_compact(places)).alias("at"), *ENDS, proper.alias("crossing")).where("NOT (at.x = ax AND at.y = ay) AND NOT (at.x = bx AND at.y = by)")
        found = stored(found.groupBy(*by, "s").agg(F.collect_set("at").alias("at"), F.max("crossing").alias("crossing")), "meets")
        crossed = found.agg(F.max("crossing")).first()[0]
        if crossed is None:
            return pieces.drop("s")
        # in order along the piece: by x, then y, and for falling pieces by x, then -y
        along = F.array_sort("at", lambda l, r: F.when(l["x"] != r["x"], F.signum(l["x"] - r["x"])).otherwise(F.signum(l["y"] - r["y"]) * F.when(F.col("by") >= F.col("ay"), 1).otherwise(-1)).cast("int"))
        stops = F.concat(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))), F.coalesce(along, F.array().cast("array<struct<x: bigint, y: bigint>>")), F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
        each = pieces.join(found, [*by, "s"], "left").select(*by, "m", stops.alias("stops"))
        k = F.explode(F.sequence(F.lit(0), F.size("stops") - 2)).alias("k")
        each = each.select(*by, "m", "stops", k).select(*by, "m", *[F.get("stops", F.col("k") + d)[c].alias(f"{e}{c}") for e, d in (("a", 0), ("b", 1)) for c in "xy"])
        pieces = summed(each, by)
        if not crossed:  # cuts at corners alone are exact, so nothing new can meet
            break
    return pieces


def windings(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Pieces with left and right: the winding numbers beside them, of rays from their middles that look to +x, from level pieces to +y."""
    pieces = stored(pieces.withColumn("s", F.xxhash64(*ENDS)), "cut-pieces")
    parts = []
    for level in (False, True):
        x, y = ("y", "x") if level else ("x", "y")
        of = pieces.where(F.col("ay") == F.col("by")) if level else pieces.where(F.col("ay") != F.col("by"))
        walls = pieces.where(F.col(f"a{y}") != F.col(f"b{y}"))
        size = stored(walls.groupBy(by).agg(F.greatest(F.avg(F.abs(F.col(f"b{y}") - F.col(f"a{y}"))) * 2, F.lit(STEPS / 4096)).alias("band")), "bands")
        low, high = F.least(f"a{y}", f"b{y}"), F.greatest(f"a{y}", f"b{y}")
        walls = walls.join(sized(size), by).select(*by, F.explode(F.sequence(F.floor(low / F.col("band")), F.floor(high / F.col("band")))).alias("row"), *[F.col(c).alias(f"o{c}") for c in (*ENDS, "m", "s")])
        middle = lambda c: (F.col(f"a{c}") + F.col(f"b{c}")) / F.lit(2.0)
        asks = of.join(sized(size), by, "left").withColumns({"mx": middle(x), "my": middle(y)}).withColumn("row", F.floor(F.col("my") / F.col("band")))
        up = F.col(f"ob{y}") > F.col(f"oa{y}")
        spans = (F.least(f"oa{y}", f"ob{y}") <= F.col("my")) & (F.greatest(f"oa{y}", f"ob{y}") > F.col("my"))
        at = F.col(f"oa{x}") + (F.col("my") - F.col(f"oa{y}")) * (F.col(f"ob{x}") - F.col(f"oa{x}")) / (F.col(f"ob{y}") - F.col(f"oa{y}"))
        beyond = spans & (F.col("os") != F.col("s")) & (at > F.col("mx"))
        sign = F.when(up, F.col("om")).otherwise(-F.col("om")) * (-1 if level else 1)
        told = asks.join(walls, [*by, "row"], "left").groupBy(*by, *ENDS, "m").agg(F.coalesce(F.sum(F.when(beyond, sign)), F.lit(0)).alias("w"))
        if level:  # the piece runs to the right: above it is its left side
            parts.append(told.select(*by, *ENDS, "m", F.col("w").alias("left"), (F.col("w") - F.col("m")).alias("right")))
        else:  # w is to the right of the middle, which is the right side of a piece that rises
            rises = F.col("by") > F.col("ay")
            beside = F.col("w") + F.when(rises, F.col("m")).otherwise(-F.col("m"))
            parts.append(told.select(*by, *ENDS, "m", F.when(rises, beside).otherwise(F.col("w")).alias("left"), F.when(rises, F.col("w")).otherwise(beside).alias("right")))
    return parts[0].unionByName(parts[1])


def whole_jobs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, firsts) of whole jobs from batches sorted by them: many small jobs at once, a job of several batches when its
    last row has come. firsts are the rows where jobs begin."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        before = [held[-1][c].slice(held[-1].num_rows - 1) if held else rows[c].slice(0, 1) for c in by]
        fresh = np.zeros(rows.num_rows, bool)
        for c, one in zip(by, before, strict=True):
            column = rows[c].combine_chunks()
            last = pa.concat_arrays([*one.chunks, column.slice(0, len(column) - 1)])
            differ = pc.or_(pc.xor(pc.is_null(column), pc.is_null(last)), pc.fill_null(pc.not_equal(column, last), False))
            fresh |= differ.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(fresh)
        if len(starts):
            done = pa.concat_tables([*held, rows.slice(0, starts[-1])])
            n = sum(t.num_rows for t in held)
            if done.num_rows:
                at = starts[:-1] + n
                yield done.combine_chunks(), at if len(at) and at[0] == 0 else np.concatenate([[0], at]).astype(int)
            held = [rows.slice(starts[-1])]
        else:
            held.append(rows)
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.array([0])


def paths(ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(job, start, corners): the closed loops of many jobs' pieces, in order of jobs: `corners` are rows of `ends` whose
    beginnings the loops run through, one loop from each `start` on."""
    n = len(ends)
    job = np.zeros(n, np.int64)
    job[firsts[firsts > 0]] = 1
    job = np.cumsum(job)
    x, y, of = np.concatenate([ends[:, 0], ends[:, 2]]), np.concatenate([ends[:, 1], ends[:, 3]]), np.concatenate([job, job])
    order = np.lexsort((y, x, of))
    new = np.ones(2 * n, bool)
    new[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(of[order]) != 0)
    place = np.empty(2 * n, np.int64)
    place[order] = np.cumsum(new) - 1
    a, b = place[:n], place[n:]
    n_places = int(new.sum())
    # places of one piece in and one out are walked from piece to piece; a job with others takes turns at them
    odd = np.zeros(len(firsts), bool)
    odd[of[order][new][(np.bincount(a, minlength=n_places) != 1) | (np.bincount(b, minlength=n_places) != 1)]] = True
    row = np.full(n_places, -1, np.int64)
    row[a[::-1]] = np.arange(n)[::-1]
    after, free = row[b].tolist(), (~odd[job]).tolist()
    jobs, starts, corners = [], [], []
    for k in row[np.sort(a)].tolist():  # by place
        if free[k]:
            jobs.append(job[k])
            starts.append(len(corners))
            while free[k]:
                free[k] = False
                corners.append(k)
                k = after[k]
    stops = np.append(firsts[1:], n)
    for j in np.flatnonzero(odd):
        mine = slice(firsts[j], stops[j])
        where = {int(p): (float(u), float(v)) for p, u, v in [*zip(a[mine], ends[mine, 0], ends[mine, 1], strict=True), *zip(b[mine], ends[mine, 2], ends[mine, 3], strict=True)]}
        for loop in polygons.loops(list(zip(a[mine].tolist(), b[mine].tolist(), strict=True)), where):
            jobs.append(j)
            starts.append(len(corners))
            corners += row[loop].tolist()
    return np.array(jobs, np.int64), np.array(starts, np.int64), np.array(corners, np.int64)


def walked(by: list[str]):
    """Rings of jobs' boundary pieces (ax, ay, bx, by, and px, py where they begin), sorted by job, which have the inside to their left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts in whole_jobs(batches, by):
            ends = np.column_stack([rows[c].to_numpy() for c in ENDS])
            job, start, corners = paths(ends, firsts)
            if not len(job):
                continue
            size = np.diff(np.append(start, len(corners)))
            k = np.arange(len(corners))
            loop = np.repeat(np.arange(len(job)), size)
            before = np.where(k == start[loop], start[loop] + size[loop] - 1, k - 1)
            after = np.where(k == start[loop] + size[loop] - 1, start[loop], k + 1)
            p = ends[corners, :2].astype(float)
            one, other = p - p[before], p[after] - p
            bent = one[:, 0] * other[:, 1] != one[:, 1] * other[:, 0]
            left = np.bincount(loop[bent], minlength=len(job))
            kept = np.flatnonzero(left > 2)
            kept = kept[np.argsort(job[kept], kind="stable")]
            mine = job[kept]
            part = np.arange(len(kept)) - np.searchsorted(mine, mine)
            # the corners of the kept loops, loop after loop
            shown = np.flatnonzero(bent)
            begin = np.cumsum(left) - left
            offsets = np.concatenate([[0], np.cumsum(left[kept])])
            at = corners[shown[np.repeat(begin[kept] - offsets[:-1], left[kept]) + np.arange(offsets[-1])]]
            points = pa.StructArray.from_arrays([pa.array(rows[c].to_numpy()[at]) for c in ("px", "py")], ["x", "y"])
            ring = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points)
            names = rows.select(by).take(pa.array(firsts[mine])).combine_chunks()
            out = pa.table([*names.columns, pa.array(part, pa.int32()), ring], names=[*by, "part", "ring"])
            yield from out.to_batches()

    return run


def bounded(rings: DataFrame, by: list[str] = JOB, positive: bool = False) -> DataFrame:
    """(by, part, ring, area): the rings that bound what a job's rings (by, ring) wind around: not 0 times, or with
    `positive` more than 0 times."""
    pieces, lattice = segments(rings, by)
    wound = windings(cut(pieces, by), by)
    inside = lambda c: F.col(c) > 0 if positive else F.col(c) != 0
    rim = wound.where(inside("left") != inside("right"))
    ways = [F.when(inside("left"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(ENDS, ["bx", "by", "ax", "ay"], strict=True)]
    kinds = {f.name: f.dataType.simpleString() for f in rings.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "part int", "ring array<struct<x: double, y: double>>"])
    lattice = stored(lattice, "corners")
    step = lattice.select(*by, "x0", "y0", "step").distinct()
    # a corner that was given stands where it stood, a cut where the lattice has it
    begins = rim.select(*by, *ways).join(sized(step), by).join(lattice.select(*by, "ax", "ay", "px", "py"), [*by, "ax", "ay"], "left")
    begins = begins.select(*by, *ENDS, *[F.coalesce(f"p{c}", F.col(f"{c}0") + F.col(f"a{c}") * F.col("step")).alias(f"p{c}") for c in "xy"])
    out = stored(begins, "rims").repartition(*by).sortWithinPartitions(*by, *ENDS).mapInArrow(walked(by), schema)
    return stored(out, "walked").withColumn("area", geo.ring_area(F.col("ring")))


def convex(ring: Column) -> Column:
    """The ring as `bounded` would give it, if all its corners bend one way and it goes round once: counter-clockwise, from the
    first of its corners on the lattice. Null for any other ring, and for one whose corners the lattice does not tell apart."""
    side = lambda r, c, f: f(F.transform(r, lambda p: p[c]))

    def placed(box):
        place = lambda p, c: F.round((p[c] - box[f"{c}0"]) / box["step"])
        return F.transform(box["r"], lambda p: F.struct(place(p, "x").alias("lx"), place(p, "y").alias("ly"), p["x"].alias("x"), p["y"].alias("y")))

    def told(q):
        n = F.size(q)
        ways = F.transform(q, lambda p, k: F.struct((F.get(q, (k + 1) % n)["lx"] - p["lx"]).alias("x"), (F.get(q, (k + 1) % n)["ly"] - p["ly"]).alias("y")))
        ahead = lambda w: (w["x"] > 0) | ((w["x"] == 0) & (w["y"] > 0))

        def bends(w):
            # as doubles, by which `walked` takes corners for straight: of unequal products the larger one is the larger one
            after = lambda k: F.get(w, (k + 1) % n)
            left = F.transform(w, lambda v, k: v["x"] * after(k)["y"] > v["y"] * after(k)["x"])
            right = F.transform(w, lambda v, k: v["x"] * after(k)["y"] < v["y"] * after(k)["x"])
            once = F.size(F.filter(F.transform(w, lambda v, k: ahead(v) != ahead(after(k))), lambda c: c)) == 2
            turned = F.when(F.forall(left, lambda c: c), q).when(F.forall(right, lambda c: c), F.reverse(q))
            return F.when(once, turned)

        return geo.let(ways, bends)

    def begun(q):
        first = F.array_position(q, F.array_min(q)).cast("int")
        return F.transform(F.concat(F.slice(q, first, F.size(q)), F.slice(q, 1, first - 1)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))

    def tried(r):
        x0, y0 = side(r, "x", F.array_min), side(r, "y", F.array_min)
        step = F.greatest(side(r, "x", F.array_max) - x0, side(r, "y", F.array_max) - y0, F.lit(1e-9)) / STEPS
        return geo.let(F.struct(x0.alias("x0"), y0.alias("y0"), step.alias("step"), r.alias("r")), lambda box: geo.let(placed(box), lambda q: geo.let(told(q), lambda c: F.when(c.isNotNull(), begun(c)))))

    whole = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return geo.let(whole, lambda r: F.when(F.size(r) > 2, tried(r)))


def united(rings: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(by, part, ring, area): the union of a job's rings, whichever way they run. A ring that crosses itself is
    taken as all that it winds around. Convex rings need no repair, and a job of a single one no union."""
    each = rings.select(*by, "ring").withColumn("__ring", F.xxhash64(F.to_json("ring"))).dropDuplicates([*by, "__ring"])
    each = stored(each.select("*", convex(F.col("ring")).alias("__convex")), "different-rings")
    plain, rest = each.where("__convex IS NOT NULL").select(*by, F.col("__convex").alias("ring"), F.lit(True).alias("__plain")), each.where("__convex IS NULL").drop("__convex")
    if not rest.isEmpty():
        plain = plain.unionByName(bounded(rest, [*by, "__ring"]).select(*by, "ring", F.lit(False).alias("__plain")))
    plain = stored(plain.withColumn("__n", F.count("*").over(Window.partitionBy(*by))), "repaired")
    alone = F.col("__plain") & (F.col("__n") == 1)
    single = plain.where(alone).select(*by, F.lit(0).alias("part"), "ring", geo.ring_area(F.col("ring")).alias("area"))
    many = plain.where(~alone).select(*by, "ring")
    return single if many.isEmpty() else single.unionByName(bounded(many, by, positive=True))


def repaired(rings: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(by, part, ring, area): each row's ring (by names the row) as rings that do not cross themselves."""
    return bounded(rings, by)


def offset_ring(ring: Column, distance: Column, segs: Column) -> Column:
    """A ring's raw offset, to its right by `distance`: sides moved, arcs of `segs` pieces a quarter at corners that
    open, and the corner itself at those that close. What it winds around more than 0 times is the offset area."""
    n = F.size(ring)

    def corner(p, k):
        before, after = F.get(ring, (k + n - 1) % n), F.get(ring, (k + 1) % n)
        angle = lambda s, t: F.atan2(t["y"] - s["y"], t["x"] - s["x"]) - F.lit(np.pi / 2)
        at = lambda a: F.struct((p["x"] + distance * F.cos(a)).alias("x"), (p["y"] + distance * F.sin(a)).alias("y"))

        def bend(a):
            first, then = a["first"], a["then"]
            sweep = then - first + F.when(then - first > np.pi, -2 * np.pi).when(then - first <= -np.pi, 2 * np.pi).otherwise(0.0)
            steps = F.ceil(F.abs(sweep) / F.lit(np.pi / 2) * segs).cast("int")
            arc = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(1))), lambda s: at(first + sweep * s / F.greatest(steps, F.lit(1))))
            return F.when(sweep * distance >= 0, arc).otherwise(F.array(at(first), F.struct(p["x"].alias("x"), p["y"].alias("y")), at(then)))

        return geo.let(F.struct(angle(before, p).alias("first"), angle(p, after).alias("then")), bend)

    return F.flatten(F.transform(ring, corner))


def tidy(rings: DataFrame) -> DataFrame:
    """rings without corners at the place of the one before."""
    last = F.size("ring") - 1
    same = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"])
    return rings.withColumn("ring", F.filter("ring", lambda p, k: ~same(p, F.get("ring", F.when(k == 0, last).otherwise(k - 1)))))


def offset(rings: DataFrame, distance: str, segs: str, by: list[str] = JOB) -> DataFrame:
    """(by, part, ring, area): a job's area grown by its column `distance` (shrunk, if negative), round at corners of `segs`
    pieces a quarter (a column too). Rings must not cross: outer ones counter-clockwise, holes clockwise."""
    raw = tidy(rings).where(F.size("ring") > 2).select(*by, offset_ring(F.col("ring"), F.col(distance), F.col(segs)).alias("ring"))
    return bounded(raw, by, positive=True)


def largest(rings: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(by, ring, area): of each job the ring of largest area, of equal ones the first part."""
    best = rings.where("area > 0").groupBy(by).agg(F.max_by(F.struct("ring", "area"), F.struct(F.col("area"), -F.col("part"))).alias("b"))
    return best.select(*by, "b.ring", "b.area")


def smoothed(rings: DataFrame, radius: DataFrame, by: list[str] = JOB) -> DataFrame:
    """(by, ring): boundaries closed by a disc of each job's radius (by, radius): grown, shrunk back, and the largest part
    taken. Inner corners and narrow bays become round; a job with a radius of 0 or less keeps its ring."""
    segs = F.greatest(F.lit(16), F.least(F.lit(48), (F.lit(12) + F.col("radius") * 2).cast("int")))
    given = stored(rings.select(*by, "ring").join(sized(radius.select(*by, "radius")), by, "left").withColumn("segs", segs), "given")
    wanted = given.where("radius > 0")
    if wanted.isEmpty():
        return given.select(*by, "ring")
    whole = stored(largest(repaired(wanted.select(*by, "ring"), by), by), "whole")
    known = wanted.select(*by, "radius", "segs")
    grown = stored(offset(whole.join(sized(known), by), "radius", "segs", by), "grown")
    back = stored(offset(grown.join(sized(known), by).withColumn("radius", -F.col("radius")), "radius", "segs", by), "shrunk")
    round_ = largest(back, by).select(*by, F.col("ring").alias("__ring"))
    return given.join(sized(round_), by, "left").select(*by, F.coalesce("__ring", "ring").alias("ring"))
