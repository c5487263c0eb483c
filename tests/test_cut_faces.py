"""Faces that are cut carry their corners, so that vertices are asked for once."""

from test_cutting import tables, terrain, torus

from orolith.operators import cutting, mesh


def test_corners_are_fetched_once_for_all_cuts(spark, monkeypatch):
    calls, real = [], mesh.corners
    monkeypatch.setattr(mesh, "corners", lambda *a, **b: calls.append(1) or real(*a, **b))
    gone, drop = [], cutting.removed
    monkeypatch.setattr(cutting, "removed", lambda spark, *paths: gone.extend(paths) or drop(spark, *paths))
    v, f = tables(spark, {"torus": torus(12, 6), "terrain": terrain(5, 7)})
    key = ["job_id", "tile", "ix", "iy"]
    tv, tf = cutting.tiles(v, f, 3, 2)
    size = {(r.job_id, r.tile): (r.volume, r.area) for r in mesh.volume(tf, by=key).collect()}
    assert len(calls) == 1 and len(size) == 12
    # the first cut's faces are not kept beside the second's
    assert len(gone) == 1 and "slabs" in gone[0]
    # what faces carry are the places of their vertices, to the last bit
    place = {(r.job_id, r.tile, r.vid): (r.x, r.y, r.z) for r in tv.collect()}
    for r in tf.collect():
        assert [tuple(r[f"p{k}"]) for k in range(3)] == [place[r.job_id, r.tile, r[f"v{k}"]] for k in range(3)]


def test_only_faces_with_sides_in_planes_are_looked_at_for_caps(spark, monkeypatch):
    """Of a block of 13 x 9 x 2 corners, cut along a row of them, few faces are."""
    seen, real = [], cutting.sections
    monkeypatch.setattr(cutting, "sections", lambda body, *more: seen.append(body.count()) or real(body, *more))
    v, f = tables(spark, {"terrain": terrain(33, 13)})
    lines = spark.createDataFrame([("terrain", [16.0])], "job_id string, lines array<double>")
    _, sf = cutting.split(v, f, lines, "y")
    assert mesh.edge_counts(sf, ["job_id", "slab"]).where("open_edges + non_manifold_edges > 0").count() == 0
    assert seen[0] <= 2 * 2 * 2 * 12 + 8 < f.count() / 10
