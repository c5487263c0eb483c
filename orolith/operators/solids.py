"""Solids from footprints, and holes of meshes filled: what needs rings triangulated, by task and ring.

Defined results: rings that cross themselves are repaired first and give a solid for each part; rings without an area
give none; a hole's loop that does not close stays open; null heights give no solid; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orolith.operators import arrangement, graph, mesh, polygons
from orolith.operators.raster import JOB
from orolith.storage import sized, stored


def triangulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triangles (n, a, b, c: corners counted over the rings in order of `part`) of jobs' rings, sorted by job and part."""
    for rows, firsts in arrangement.whole_jobs(batches, JOB):
        jobs, found = [], []
        for first, stop in zip(firsts, [*firsts[1:], rows.num_rows], strict=True):
            rings, at = [], []
            for ring in rows["ring"].slice(first, stop - first).to_pylist():
                rings.append(list(range(len(at), len(at) + len(ring))))
                at += [(p["x"], p["y"]) for p in ring]
            tri = np.array(polygons.triangles(rings, np.array(at)), np.int64).reshape(-1, 3)
            jobs.append(np.full(len(tri), first))
            found.append(np.column_stack([np.arange(len(tri)), tri]))
        found, job = np.concatenate(found), rows["job_id"].take(pa.array(np.concatenate(jobs)))
        yield from pa.table([job, *[pa.array(c) for c in found.T.copy()]], names=["job_id", "n", "a", "b", "c"]).combine_chunks().to_batches()


def extruded(rings: DataFrame, heights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of closed upright solids over the area of a job's rings (job_id, ring), holes kept, from `low` to
    `high` (heights: job_id, low, high). A job's rings are triangulated by one task."""
    flat = stored(arrangement.united(rings), "footprints")
    levels = heights.where("low < high").select(*JOB, F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    flat = stored(flat.join(sized(levels), JOB), "raised")
    size = F.size("ring")
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*JOB).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(Window.partitionBy(*JOB))
    numbered = stored(flat.select(*JOB, "low", "high", before.alias("at"), total.alias("total"), size.alias("size"), "ring"), "numbered")  # before corners become rows
    corners = stored(numbered.select(*JOB, "low", "high", "at", "total", "size", F.posexplode("ring").alias("k", "p")), "corners")
    number = F.col("at") + F.col("k")
    both = F.inline(F.array(F.struct(number.cast("long").alias("vid"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("low").alias("z")), F.struct((number + F.col("total")).cast("long").alias("vid"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("high").alias("z"))))
    vertices = corners.select(*JOB, both)
    tasks = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes here are much work
    tri = stored(flat.select(*JOB, "part", "ring").repartition(tasks, *JOB).sortWithinPartitions(*JOB, "part").mapInArrow(triangulated, "job_id string, n long, a long, b long, c long"), "lids")
    counts = stored(corners.select(*JOB, F.col("total").cast("long").alias("total")).distinct(), "corner-counts")
    face = lambda fid, *v: F.struct(fid.cast("long").alias("fid"), *[x.cast("long").alias(f"v{k}") for k, x in enumerate(v)])
    n, t = F.col("n"), F.col("total")
    a, b, c = (F.col(x) for x in "abc")
    lids = tri.join(sized(counts), JOB).select(*JOB, F.inline(F.array(face(t * 2 + n * 2, a, c, b), face(t * 2 + n * 2 + 1, a + t, b + t, c + t))))
    after = F.col("at") + (F.col("k") + 1) % F.col("size")
    walls = corners.select(*JOB, F.inline(F.array(face(number * 2, number, after, after + t), face(number * 2 + 1, number, after + t, number + t))))
    return vertices, walls.unionByName(lids)


def covered(ids: np.ndarray, ends_at: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Triangles over the open half-edges of one border (from ids, lying at `at`, to ends_at), wound against them."""
    by = np.argsort(ids)
    starts, ids, at = ids, ids[by], at[by]
    to, source = np.searchsorted(ids, ends_at), np.searchsorted(ids, starts)
    known = ids[np.minimum(to, len(ids) - 1)] == ends_at
    ends = list(zip(to[known].tolist(), source[known].tolist(), strict=True))
    # seen along the border's own normal (the sum of its turns), the loop runs counter-clockwise
    middle = at - at.mean(axis=0)
    normal = np.cross(middle[to[known]], middle[source[known]]).sum(axis=0)
    length = np.linalg.norm(normal)
    first = np.cross(normal, np.eye(3)[np.abs(normal).argmin()]) if length else np.array([1.0, 0, 0])
    first /= np.linalg.norm(first)
    second = np.cross(normal / length, first) if length else np.array([0, 1.0, 0])
    flat = np.column_stack([middle @ first, middle @ second])
    tri = []
    for loop in polygons.loops(ends, dict(enumerate(map(tuple, flat)))):
        if len(loop) > 2 and polygons.area2(flat[loop]) >= 0:
            tri += polygons.ears(loop, flat)
        elif len(loop) > 2:
            tri += [t[::-1] for t in polygons.ears(loop[::-1], flat)]
    return ids[np.array(tri, int).reshape(-1, 3)]


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triangles (n, v0, v1, v2) over borders' open half-edges (a, b, and where a lies), sorted by job and root; many small
    borders at once."""
    for rows, firsts in arrangement.whole_jobs(batches, [*JOB, "root"]):
        a, b = (rows[c].to_numpy() for c in "ab")
        at = np.column_stack([rows[c].to_numpy() for c in "xyz"])
        found = [covered(a[i:j], b[i:j], at[i:j]) for i, j in zip(firsts, [*firsts[1:], len(a)], strict=True)]
        sizes = np.array([len(t) for t in found])
        which, tri = pa.array(np.repeat(firsts, sizes)), np.concatenate(found)
        n = np.arange(len(tri)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield from pa.table([rows["job_id"].take(which), rows["root"].take(which), *[pa.array(c) for c in (n, *tri.T.copy())]], names=["job_id", "root", "n", "v0", "v1", "v2"]).combine_chunks().to_batches()


def fill_holes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with each closed loop of open edges covered by triangles over its own corners, projected along the loop's
    normal; a border is filled by one task, small ones many at once."""
    rim = stored(mesh.rim(faces), "open-edges")
    if rim.isEmpty():
        return faces.select(*JOB, "fid", "v0", "v1", "v2")
    root = graph.banded(rim, JOB, mesh.BAND).select(*JOB, F.col("node").alias("a"), "root")
    rows = rim.join(root, [*JOB, "a"]).join(vertices.select(*JOB, F.col("vid").alias("a"), "x", "y", "z"), [*JOB, "a"])
    tasks = int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as in extruded
    dealt = rows.select(*JOB, "root", "a", "b", "x", "y", "z").repartition(tasks, *JOB, "root").sortWithinPartitions(*JOB, "root")
    patch = stored(dealt.mapInArrow(filled, "job_id string, root long, n long, v0 long, v1 long, v2 long"), "filled")
    last = faces.groupBy(*JOB).agg((F.max("fid") + 1).alias("__f"))
    rank = F.row_number().over(Window.partitionBy(*JOB).orderBy("root", "n"))  # a job's new faces cover its borders alone
    more = patch.join(sized(last), JOB).select(*JOB, (F.col("__f") + rank - 1).cast("long").alias("fid"), "v0", "v1", "v2")
    return faces.select(*JOB, "fid", "v0", "v1", "v2").unionByName(more)
