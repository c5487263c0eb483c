"""What keeps work bounded on large tables: how tables are cut, joined and dealt."""

from pyspark.sql import functions as F

from orolith.operators import mesh
from orolith.plans import mesh_queries
from orolith.storage import FILE_ROWS, stored


def test_one_tasks_rows_are_stored_in_several_files(spark):
    back = stored(spark.range(2 * FILE_ROWS + 5).coalesce(1), "long")
    assert len(back.inputFiles()) == 3
    assert back.count() == 2 * FILE_ROWS + 5


def test_corners_are_never_broadcast_by_packed_size(spark):
    v = stored(spark.range(1000).select(F.lit("a").alias("job_id"), F.col("id").alias("vid"), *[F.lit(1.0).alias(c) for c in "xyz"]), "flat")
    f = spark.range(10).select(F.lit("a").alias("job_id"), F.col("id").alias("fid"), *[(F.col("id") + k).alias(f"v{k}") for k in range(3)])
    out = mesh.corners(f, v)
    assert out.count() == 10
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_solid_of_queries_is_a_stored_table(spark):
    from compare import DATA

    for df in mesh_queries.solid(spark, f"{DATA}/sf0.001"):
        assert df.inputFiles() and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_squares_of_a_narrow_mesh_hold_few_vertices(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(mesh, "stored", lambda df, name: kept.append((name, out := stored(df, name))) or out)
    v = spark.range(40_000).select(F.lit("a").alias("job_id"), F.col("id").alias("vid"), (F.col("id") % 4).cast("double").alias("x"), F.floor(F.col("id") / 4).cast("double").alias("y"))
    p = spark.range(50).select(F.lit("a").alias("job_id"), F.col("id").alias("pid"), F.lit(1.2).alias("x"), (F.col("id") * 3 + 0.1).alias("y"))
    got = {r.pid: r.vid for r in mesh.nearest_vertices(p, v, []).collect()}
    assert got == {k: 4 * 3 * k + 1 for k in range(50)}
    assert max(r.size for name, df in kept if name == "squares" for r in df.limit(1).collect()) < 10
