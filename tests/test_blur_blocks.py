"""A blur worked out by blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orolith.operators import raster


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_blur_agree_with_the_whole(spark, monkeypatch):
    """missing cells count as nothing, and blocks meet without a seam; no side is shuffled by job alone."""
    monkeypatch.setattr(raster, "BLUR_BLOCK", 7)
    h, w, sigma, rng = 23, 31, 0.9, np.random.default_rng(4)
    z = rng.integers(0, 256, (h, w)).astype(float)
    there = rng.random((h, w)) < 0.8
    there[-1, -1] = True
    cells = spark.createDataFrame([("a", i, j, float(z[i, j])) for i in range(h) for j in range(w) if there[i, j]], "job_id string, i int, j int, v double")
    soft = raster.gaussian(cells, F.col("v"), sigma)
    got = {(r.i, r.j): r.blurred for r in soft.collect()}
    reach = int(4 * sigma + 0.5)
    kernel = np.array([math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)])
    wide = np.pad(np.where(there, z, 0.0), reach, mode="symmetric")
    want = np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, wide, kernel / kernel.sum(), "valid"), kernel / kernel.sum(), "valid")
    assert set(got) == {(int(i), int(j)) for i, j in np.argwhere(there)} and all(v == pytest.approx(want[at]) for at, v in got.items())
    assert plan(soft).split("Initial Plan")[0].count("Exchange hashpartitioning") <= 2  # the raster's size, and blocks
