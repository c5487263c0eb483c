"""Small rules on messages, reliefs, built exports and drawn shapes."""

from pyspark.sql import functions as F

from orolith.functions import names
from orolith.operators import shapes


def test_timed_messages(spark):
    df = spark.createDataFrame([(0.0,), (7.99,), (8.0,), (61.7,), (None,)], "s double")
    assert [r.m for r in df.select(names.timed(F.lit("Working"), F.col("s")).alias("m")).collect()] == ["Working", "Working", "Working (8s)", "Working (61s)", "Working"]


def test_relief_notes(spark):
    rows = [(100.0, 4.0, 10.0, 9.0), (100.0, 5.0, 10.0, 0.4), (1.0, 0.0, 0.5, 0.0), (None, 1.0, 10.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select(names.relief_notes(*[F.col(c) for c in "abcd"]).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, False)]


def test_built_exports(spark):
    rows = [({"print_stl": False}, True, False, True, True, 3), (None, True, None, None, True, 0), ({}, None, True, False, None, None)]
    df = spark.createDataFrame(rows, "f map<string, boolean>, print_ok boolean, textured_glb boolean, ams_glb boolean, pieces_ok boolean, pieces int")
    facts = {c: F.col(c) for c in df.columns[1:]}
    keys = ["print_stl", "print_ams", "print_3mf", "print_textured_glb", "print_ams_glb", "print_pieces", "preview_glb"]
    got = [tuple(r) for r in df.select(*[names.built(k, F.col("f"), facts).alias(k) for k in keys]).collect()]
    assert got == [(False, True, True, False, True, True, False), (True, True, True, False, False, False, False), (False, False, False, True, False, False, False)]


def test_drafts_are_appended(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4))]
    kinds = "ring array<struct<x: double, y: double>>"
    old = spark.createDataFrame([("a", 5, "p", "auto", ring)], f"job_id string, ord long, id string, source string, {kinds}")
    drafts = spark.createDataFrame([("a", 2, ring), ("a", 1, ring), ("a", 3, ring[:2]), ("b", 1, ring)], f"job_id string, n int, {kinds}")
    got = sorted((r.job_id, r.ord, r.source) for r in shapes.append_drawn(old, drafts).collect())
    assert got == [("a", 5, "auto"), ("a", 6, "manual"), ("a", 7, "manual"), ("b", 0, "manual")]
    assert len({r.id for r in shapes.append_drawn(old, drafts).collect()}) == 4
