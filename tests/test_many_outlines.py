"""Every blob of a raster has its outline, however many there are."""

from orolith.operators import ponds, shapes


def test_outlines_of_more_blobs_than_a_review_takes(spark):
    many = shapes.MOST_SHAPES + 6
    lit = spark.createDataFrame([("a", 6 * (n // 10) + i, 8 * (n % 10) + j) for n in range(many) for i in range(3) for j in range(5)], "job_id string, i int, j int")
    got = shapes.outlines(lit.join(ponds.blobs(lit), ["job_id", "i", "j"])).collect()
    assert sorted(r.ord for r in got) == list(range(1, many + 1))
    assert {(min(p.y for p in r.ring), min(p.x for p in r.ring)) for r in got} == {(6.0 * (n // 10), 8.0 * (n % 10)) for n in range(many)}
