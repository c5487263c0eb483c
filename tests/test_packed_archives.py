"""Archives are packed piece by piece, meshes without gaps stay as they are, and records of placed faces stay where they are."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_parallel_files import made

from orolith.operators import mesh
from orolith.sinks import files, meshes


def test_archives_are_packed(spark, tmp_path):
    text = made(spark, 40, 3).withColumn("payload", F.repeat(F.sha2(F.col("n").cast("string"), 256), 40).cast("binary"))
    size = {r.file: r.size for r in files.save(text, str(tmp_path)).collect()}
    archive = zipfile.ZipFile(tmp_path / "a/x.zip")
    assert archive.testzip() is None and sum(x.file_size for x in archive.infolist()) == 80 * 64 * 40
    assert {x.compress_type for x in archive.infolist()} == {zipfile.ZIP_DEFLATED}
    assert size["x.zip"] == os.path.getsize(tmp_path / "a/x.zip") < size["x.bin"] / 4 and size["x.bin"] == 80 * 64 * 40


def grid(spark, gap=0):
    cells = spark.range(600).select(F.lit("a").alias("job_id"), F.floor(F.col("id") / 20).alias("i"), (F.col("id") % 20).alias("j"), *[(F.col("id") * k % 17).cast("double").alias(c) for k, c in ((3, "x"), (5, "y"), (7, "z"))])
    v, f = mesh.grid_vertices(cells), mesh.quad_faces(mesh.grid_quads(cells))
    return v.withColumn("vid", F.col("vid") * (1 + gap)), f.withColumns({f"v{k}": F.col(f"v{k}") * (1 + gap) for k in range(3)})


def test_numbers_without_gaps_are_left_alone(spark, monkeypatch):
    calls, real = [], mesh.corners
    monkeypatch.setattr(mesh, "corners", lambda *a, **b: calls.append(1) or real(*a, **b))
    v, f = grid(spark)
    nv, nf = mesh.numbered(v, f)
    assert not calls and (nv, nf) == (v, f)
    want = {r.fid: (r.v0, r.v1, r.v2) for r in f.collect()}
    gv, gf = grid(spark, 4)
    nv, nf = mesh.numbered(gv, gf.withColumn("p1", F.lit("kept")))
    assert len(calls) == 1 and {r.fid: (r.v0, r.v1, r.v2) for r in nf.collect()} == want and {r.p1 for r in nf.collect()} == {"kept"}
    assert sorted((r.vid, r.x, r.y) for r in nv.collect()) == sorted((r.vid, r.x, r.y) for r in v.collect())


def test_an_stl_shuffles_its_records_no_more(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mesh, "BLOCK_BITS", 6)
    v, f = grid(spark)
    made_of = meshes.stl(v, f.repartition(3, "fid"))
    plan = made_of._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    files.save(made_of, str(tmp_path))
    data = np.fromfile(tmp_path / "a/print.stl", np.uint8)[84:].reshape(-1, 50)[:, 12:48].copy().view("<f4")
    place = {r.vid: (r.x, r.y, r.z) for r in v.collect()}
    want = [[x for k in range(3) for x in place[r[f"v{k}"]]] for r in f.orderBy("fid").collect()]
    assert data.tolist() == np.array(want, "f4").tolist()


def test_records_out_of_order_are_refused(spark):
    rows = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0)], "job_id string, n long, x double").coalesce(1)
    with pytest.raises(Exception, match="out of order"):
        meshes.packed_in_place(rows, "f", None, 0, [("x", "<f4")]).collect()
