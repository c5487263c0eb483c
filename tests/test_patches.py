"""Patches of a rough surface hang together: few of its corners lie in several of them."""

import numpy as np
from pyspark.sql import functions as F

from orolith.operators import collapse


def test_a_rough_and_long_surface_is_cut_in_few_places(spark, monkeypatch):
    monkeypatch.setattr(collapse, "PATCH", 1000)
    rng = np.random.default_rng(5)
    w, h = 20, 400
    v = [("a", i * w + j, 10.0 * j, 10.0 * i, float(rng.normal(0, 5))) for i in range(h) for j in range(w)]
    quads = [i * w + j for i in range(h - 1) for j in range(w - 1)]
    f = [("a", 2 * n + k, *t) for n, q in enumerate(quads) for k, t in enumerate([(q, q + w, q + 1), (q + 1, q + w, q + w + 1)])]
    v = spark.createDataFrame(v, "job_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame(f, "job_id string, fid long, v0 long, v1 long, v2 long")
    for turn in (0, 1):
        dealt = collapse.patches(f, v, f.groupBy("job_id").agg(F.count("*").alias("nf")), turn)
        of = dealt.select("fid", "patch", F.explode(F.array("v0", "v1", "v2")).alias("vid")).groupBy("vid").agg(F.count_distinct("patch").alias("n"))
        shared = of.where("n > 1").count()
        sizes = [r[0] for r in dealt.groupBy("patch").agg(F.count("*")).collect()]
        assert dealt.count() == 2 * len(quads) and max(sizes) <= 1500 and len(sizes) > 10
        assert shared < 0.12 * w * h
