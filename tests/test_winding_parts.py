"""Winding a mesh of one part gathers no side of a join by part."""

from orolith.operators import winding


def test_faces_are_not_shuffled_by_part(spark):
    v = spark.createDataFrame([("a", n, float(x), float(y), float(z)) for n, (x, y, z) in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)])], "job_id string, vid long, x double, y double, z double")
    faces = [(0, 2, 1), (0, 3, 1), (1, 2, 3), (0, 3, 2)]  # the second is turned
    f = spark.createDataFrame([("a", n, *t) for n, t in enumerate(faces)], "job_id string, fid long, v0 long, v1 long, v2 long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fixed, parts = winding.wound(v, f)
        plan = fixed._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "part#" in line]
        assert sorted(tuple(r) for r in fixed.collect()) == [("a", 0, 0, 2, 1), ("a", 1, 0, 1, 3), ("a", 2, 1, 2, 3), ("a", 3, 0, 3, 2)]
        assert [(r.n_faces, r.n_turned, r.closed) for r in parts.collect()] == [(4, 1, True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
