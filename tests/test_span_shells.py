"""Shells of voxels come from spans of lines, and corners from blocks of faces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orolith.operators import mesh

MOVES = {0: (-1, 0, 0), 1: (1, 0, 0), 2: (0, -1, 0), 3: (0, 1, 0), 4: (0, 0, -1), 5: (0, 0, 1)}


def squares(spans):
    """(a, b, c, n) of each square between the voxels of spans and empty space."""
    cells = {(a, b, c) for a, b, first, last in spans for c in range(first, last + 1)}
    return {(*x, n) for x in cells for n, d in MOVES.items() if tuple(np.add(x, d)) not in cells}


def test_sides_of_spans_are_those_of_their_voxels(spark):
    rng, spans = np.random.default_rng(5), []
    for a in range(-3, 3):
        for b in range(4):
            edges = sorted(int(x) for x in rng.choice(30, 6, replace=False))
            # of each line two spans that touch and one apart, or none
            spans += [(a, b, edges[0], edges[1]), (a, b, edges[1] + 1, edges[2]), (a, b, edges[3] + 1, edges[4] + 1)] if (a + b) % 5 else []
    spans = [s for s in spans if s[2] <= s[3]]
    df = spark.createDataFrame([("s", *s) for s in spans], "job_id string, a int, b int, first int, last int")
    sides = [(r.a, r.b, c, r.n) for r in mesh.span_sides(df).collect() for c in range(r.first, r.last + 1)]
    assert len(sides) == len(set(sides)) and set(sides) == squares(spans)
    v, f = mesh.span_surface(df, 0.5)
    told = mesh.volume(f, v).collect()[0]
    assert told.volume == pytest.approx(0.125 * sum(s[3] - s[2] + 1 for s in spans)) and told.area == pytest.approx(0.25 * len(sides))
    assert mesh.edge_counts(f).collect()[0].open_edges == 0 and f.select("fid").distinct().count() == 2 * len(sides)


def test_a_tall_block_has_few_sides(spark):
    """Nothing is made for each of its 36 million voxels."""
    df = spark.createDataFrame([("s", a, b, 0, 999_999) for a in range(6) for b in range(6)], "job_id string, a int, b int, first int, last int")
    assert mesh.span_sides(df).count() == 2 * 36 + 4 * 6


def test_far_voxels_have_corners_of_their_own(spark):
    filled = spark.createDataFrame([("s", 0, 10_000, 0), ("s", 1, -6_384, 0), ("s", -90_000, 400_000, 9_000)], "job_id string, a int, b int, c int")
    v, f = mesh.voxel_surface(filled, 1.0)
    told = mesh.edge_counts(f).collect()[0]
    assert v.count() == v.select("vid").distinct().count() == 24 and f.select("fid").distinct().count() == 36
    assert (told.open_edges, told.non_manifold_edges) == (0, 0) and mesh.volume(f, v).collect()[0].volume == pytest.approx(3.0)


def test_corners_keep_columns_and_leave_out_what_is_unknown(spark):
    v = spark.createDataFrame([(j, k, float(k), -float(k), None if k == 3 else 0.5) for j in "ab" for k in range(6)], "job_id string, vid long, x double, y double, z double")
    rows = [("a", 0, 0, 1, 2, None, "p"), ("a", 1, 2, 1, 3, 7, None), ("a", 1 << 40, 5, 0, 5, 8, "q"), ("b", 0, 4, 3, 9, 9, "r"), ("b", 2, None, 1, 2, 1, "s"), ("c", 0, 0, 1, 2, 1, "t"), ("b", 1, 4, 3, 2, 2, "u")]
    f = spark.createDataFrame(rows, "job_id string, fid long, v0 long, v1 long, v2 long, n int, t string")
    got = {(r.job_id, r.fid): r for r in mesh.corners(f, v).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 1 << 40), ("b", 1)}
    assert got["a", 0].n is None and got["a", 1].t is None and got["a", 1].p2.z is None and tuple(got["b", 1].p0) == (4.0, -4.0, 0.5)
    assert [r.x for r in (got["a", 1 << 40][k] for k in ("p0", "p1", "p2"))] == [5.0, 0.0, 5.0]
    assert mesh.corners(f, v.limit(0)).count() == 0 and mesh.corners(f.limit(0), v).count() == 0


def test_faces_are_shuffled_once_for_their_corners(spark):
    v = spark.range(1000).select(F.lit("a").alias("job_id"), F.col("id").alias("vid"), *[F.lit(1.0).alias(c) for c in "xyz"])
    f = spark.range(900).select(F.lit("a").alias("job_id"), F.col("id").alias("fid"), *[(F.col("id") + k).alias(f"v{k}") for k in range(3)])
    plan = mesh.corners(f, v)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "fid" not in x.split("hashpartitioning")[1]]) == 4


def test_columns_that_are_never_null_become_corners_too(spark):
    v = spark.range(9).select(F.lit("a").alias("job_id"), F.col("id").alias("vid"), F.lit(0.0).alias("x"), *[F.col("id").cast("double").alias(c) for c in "yz"])
    f = spark.range(7).select(F.lit("a").alias("job_id"), F.col("id").alias("fid"), F.array(F.lit(1.0)).alias("more"), F.struct(F.lit(2).alias("s")).alias("inner"), *[(F.col("id") + k).alias(f"v{k}") for k in range(3)])
    got = mesh.corners(f, v, ["x", "z"]).where("fid = 4").collect()[0]
    assert (tuple(got.p0), tuple(got.p2), got.more, got.inner.s) == ((0.0, 4.0), (0.0, 6.0), [1.0], 2)
