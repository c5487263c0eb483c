"""Many small borders."""

import pyarrow as pa
from pyspark.sql import functions as F
from test_cutting import tables, terrain, torus

from orolith.operators import mesh, solids


def test_holes_are_filled_many_at_once(spark):
    """F16: borders are no groups of their own, and each is filled."""
    at, ts = torus(24, 10)
    v, f = tables(spark, {"a": (at, [t for k, t in enumerate(ts) if k % 17]), "b": terrain()})
    out = solids.fill_holes(v, f)
    assert {r.job_id: r.open_edges for r in mesh.edge_counts(out).collect()} == {"a": 0, "b": 0}
    assert {r.job_id: r.n for r in out.groupBy("job_id").agg(F.count("*").alias("n")).collect()} == {"a": len(ts), "b": len(terrain()[1])}
    rows = [("a", 5, 1, 2, 0.0, 0.0, 0.0), ("a", 5, 2, 3, 1.0, 0.0, 0.0), ("a", 5, 3, 1, 0.0, 1.0, 0.0), ("a", 7, 7, 9, 0.0, 0.0, 0.0), ("a", 7, 9, 8, 1.0, 0.0, 0.0), ("a", 7, 8, 7, 0.0, 1.0, 0.0)]
    batch = pa.table(dict(zip(["job_id", "root", "a", "b", "x", "y", "z"], map(pa.array, zip(*rows, strict=True)), strict=True))).to_batches()
    got = [tuple(r.values()) for b in solids.filled(iter(batch)) for r in b.to_pylist()]
    assert [r[:3] for r in got] == [("a", 5, 0), ("a", 7, 0)] and [set(r[3:]) for r in got] == [{1, 2, 3}, {7, 8, 9}]
