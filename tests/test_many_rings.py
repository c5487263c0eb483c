"""Many small jobs of rings: parsed once, convex ones left alone, walked by the batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orolith.functions import geo
from orolith.operators import arrangement, solids
from orolith.sources import boundaries

RING = "ring array<struct<x: double, y: double>>"


def test_a_ring_is_parsed_at_one_place_of_the_plan(spark):
    files = spark.createDataFrame([("a", "<Polygon><outerBoundaryIs><coordinates>0,0 2,0 2,1 0,0</coordinates></outerBoundaryIs></Polygon>")], "job_id string, text string")
    found = boundaries.rings(files.repartition(2)).where(F.abs(geo.ring_area(F.col("ring"))) > 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
    assert [[(p.x, p.y) for p in r.ring] for r in found.collect()] == [[(0, 0), (2, 0), (2, 1)]]


def test_convex_rings_are_what_repair_gives(spark):
    turn = np.arange(7) * 2 * np.pi / 7
    heptagon = list(zip(np.cos(turn), np.sin(turn), strict=True))
    rings = {
        "square": [(3, 1), (3, 4), (0, 4), (0, 1)], "clockwise": [(0, 0), (0, 2), (2, 0)], "heptagon": heptagon, "backwards": heptagon[::-1],
        "twice round": heptagon + [(0.9 * x, 0.9 * y) for x, y in heptagon], "star": [heptagon[3 * k % 7] for k in range(7)], "straight corner": [(0, 0), (1, 0), (2, 0), (2, 2)],
        "dent": [(0, 0), (4, 0), (1, 1), (0, 4)], "bow": [(0, 0), (2, 2), (2, 0), (0, 2)], "flat": [(0, 0), (1, 1), (2, 2)], "repeated": [(0, 0), (0, 0), (1, 0), (0, 1)], "two": [(0, 0), (1, 1)],
    }
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in rings.items()], f"job_id string, {RING}")
    quick = {r.job_id: [tuple(p) for p in r.ring] for r in df.select("job_id", arrangement.convex(F.col("ring")).alias("ring")).where("ring IS NOT NULL").collect()}
    assert set(quick) == {"square", "clockwise", "heptagon", "backwards"}
    slow = {r.job_id: [tuple(p) for p in r.ring] for r in arrangement.bounded(df.where(F.col("job_id").isin(*quick))).collect()}
    assert quick == slow


def test_jobs_come_whole_however_their_rows_are_dealt():
    rng = np.random.default_rng(3)
    names = [n for n in [None, *"abcdefgh"] for _ in range(rng.integers(1, 9))]
    rows = pa.table({"job_id": pa.array(names, pa.string()), "n": np.arange(len(names))})
    for size in (1, 2, 3, 7, 100):
        found = []
        for whole, firsts in arrangement.whole_jobs(iter(rows.to_batches(max_chunksize=size)), ["job_id"]):
            for a, b in zip(firsts, [*firsts[1:], whole.num_rows], strict=True):
                assert len(set(whole["job_id"].slice(a, b - a).to_pylist())) == 1
                found.append(whole["job_id"][a].as_py())
        assert found == list(dict.fromkeys(names))


def test_loops_of_many_jobs_are_those_of_each():
    """A square, two squares that touch at a corner (which take turns there), and a piece that leads nowhere."""
    ring = lambda x, y: [(x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)]
    jobs = [ring(0, 0), ring(0, 0) + ring(1, 1), [(0, 0, 5, 5)]]
    pieces = [("abc"[k], *e, float(e[0]), float(e[1])) for k, job in enumerate(jobs) for e in sorted(job)]
    rows = pa.table(dict(zip(["job_id", *arrangement.ENDS, "px", "py"], map(list, zip(*pieces, strict=True)), strict=True)))
    out = pa.Table.from_batches(arrangement.walked(["job_id"])(iter(rows.to_batches(max_chunksize=5)))).to_pylist()
    got = [(r["job_id"], r["part"], [(p["x"], p["y"]) for p in r["ring"]]) for r in out]
    square = lambda x, y: [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    assert sorted((j, sorted(r)) for j, _, r in got) == [("a", sorted(square(0, 0))), ("b", sorted(square(0, 0))), ("b", sorted(square(1, 1)))]
    assert [(j, p) for j, p, _ in got] == [("a", 0), ("b", 0), ("b", 1)]


def test_lids_of_many_jobs_come_from_one_call():
    point = lambda x, y: {"x": float(x), "y": float(y)}
    square = lambda a, b: [point(a, a), point(b, a), point(b, b), point(a, b)]
    rings = [("a", square(0, 1)), ("b", square(0, 4)), ("b", square(1, 2)[::-1]), ("c", square(0, 2)[:3])]
    rows = pa.table({"job_id": [j for j, _ in rings], "part": [0, 0, 1, 0], "ring": [r for _, r in rings]})
    for size in (1, 2, 4):
        out = pa.Table.from_batches(solids.triangulated(iter(rows.to_batches(max_chunksize=size)))).to_pylist()
        at = {j: [p for k, r in rings if k == j for p in r] for j in "abc"}
        area = dict.fromkeys("abc", 0.0)
        for r in out:
            p, q, s = (at[r["job_id"]][r[c]] for c in "abc")
            area[r["job_id"]] += ((q["x"] - p["x"]) * (s["y"] - p["y"]) - (q["y"] - p["y"]) * (s["x"] - p["x"])) / 2
        assert area == {"a": 1, "b": 15, "c": 2}
        assert [r["n"] for r in out if r["job_id"] == "b"] == list(range(8))
