"""Faces of wrong sense come back; twisted strips are told; open parts follow the most of their faces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orolith.operators import mesh, winding
from test_solids import solid

FACE = "job_id string, fid long, v0 long, v1 long, v2 long"
VERTEX = "job_id string, vid long, x double, y double, z double"


def rows(faces):
    return {r.fid: (r.v0, r.v1, r.v2) for r in faces.collect()}


@pytest.mark.parametrize("share", [0.3, 1.0])
def test_any_set_of_turned_faces_comes_back(spark, share):
    v, f = solid(spark, [(0, 0, 0, 3, 2, 1), (1e6, 5, 5, 1e6 + 1, 6, 6), (10, 10, 10, 12, 12, 12)])
    good = rows(f)
    rng = np.random.default_rng(int(share * 10))
    wrong = [fid for fid in good if rng.random() < share]
    bad = winding.turned(f, F.col("fid").isin(wrong)).withColumn("note", F.lit("n"))
    fixed, parts = winding.wound(v, bad)
    assert fixed.columns == bad.columns
    volume = mesh.volume(fixed, v).collect()[0].volume
    assert volume == pytest.approx(6 + 1 + 8, rel=1e-6)
    told = {r.part: r for r in parts.collect()}
    outward = mesh.volume(f, v).collect()[0].volume > 0
    assert {k: r.n_faces for k, r in told.items()} == {0: 12, 12: 12, 24: 12} and all(r.closed and not r.twisted for r in told.values())
    assert rows(fixed) == good if outward else {k: (a, c, b) for k, (a, b, c) in good.items()} == rows(fixed)
    assert sum(r.n_turned for r in told.values()) == sum(rows(bad)[k] != x for k, x in rows(fixed).items())


def test_moebius_strip_is_told_and_stays(spark):
    n = 7
    f = [("m", 2 * k, 2 * k, 2 * k + 1, 2 * (k + 1)) for k in range(n - 1)] + [("m", 2 * k + 1, 2 * k + 1, 2 * (k + 1) + 1, 2 * (k + 1)) for k in range(n - 1)]
    f += [("m", 2 * n - 2, 2 * n - 2, 2 * n - 1, 1), ("m", 2 * n - 1, 2 * n - 1, 0, 1)]
    v = spark.createDataFrame([("m", k, float(k), float(k * k % 5), float(k % 3)) for k in range(2 * n)], VERTEX)
    faces = spark.createDataFrame(f, FACE)
    fixed, parts = winding.wound(v, faces)
    assert [(r.n_faces, r.n_turned, r.closed, r.twisted) for r in parts.collect()] == [(2 * n, 0, False, True)] and rows(fixed) == rows(faces)


def test_open_parts_loose_faces_and_edges_of_three(spark):
    v = spark.createDataFrame([("a", k, float(k % 3), float(k // 3), 0.0) for k in range(9)], VERTEX)
    # Faces 0, 1, 2 in a row (1 turned); 10 and 11 disagree: the least stays; 20 to 22 share one edge; 30 repeats a corner.
    faces = [("a", 0, 0, 1, 3), ("a", 1, 1, 3, 4), ("a", 2, 4, 6, 3), ("b", 10, 0, 1, 3), ("b", 11, 1, 3, 4), ("c", 20, 0, 1, 2), ("c", 21, 0, 1, 3), ("c", 22, 0, 1, 4), ("d", 30, 0, 0, 1), ("d", 31, None, 1, 2)]
    fixed, parts = winding.wound(v.crossJoin(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "j string")).withColumn("job_id", F.col("j")).drop("j"), spark.createDataFrame(faces, FACE))
    want = {fid: tuple(c) for _, fid, *c in faces} | {1: (1, 4, 3), 11: (1, 4, 3)}
    assert rows(fixed) == want
    assert {(r.job_id, r.part): r.n_turned for r in parts.collect()} == {("a", 0): 1, ("b", 10): 1, ("c", 20): 0, ("c", 21): 0, ("c", 22): 0, ("d", 30): 0, ("d", 31): 0}
    empty = winding.wound(v, spark.createDataFrame([], FACE))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_repair_closes_and_turns_outwards(spark):
    v, f = solid(spark, [(0, 0, 0, 3, 2, 1)])
    bad = winding.turned(f.where("fid <> 4"), F.col("fid") % 3 == 0)
    v2, f2 = winding.repaired(v, bad)
    assert mesh.edge_counts(f2).collect()[0].open_edges == 0
    assert mesh.volume(f2, v2).collect()[0].volume == pytest.approx(6.0)
