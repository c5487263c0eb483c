"""Voxels are counted once without being gathered again."""

from test_solids import OVERLAPS, solid

from orolith.operators import mesh


def test_voxels_are_not_shuffled(spark):
    filled = mesh.voxels(*solid(spark, OVERLAPS), 1.0)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and not [line for line in plan.splitlines() if "hashpartitioning" in line and ", c#" in line]
    got = [tuple(r) for r in filled.select("a", "b", "c").collect()]
    assert len(got) == len(set(got)) == 10 * 10 * 15 + 3 * 10 * 10 + 2 * 3 * 3
