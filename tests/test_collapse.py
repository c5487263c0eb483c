"""Edge collapse by quadric error: targets, closed results, distances, and what must not collapse."""

import numpy as np
import pytest

from orolith.operators import collapse, mesh


def sphere(rounds):
    """A sphere of 20 * 4**rounds faces by halving the edges of an icosahedron."""
    t = (1 + 5**0.5) / 2
    p = np.array([(-1, t, 0), (1, t, 0), (-1, -t, 0), (1, -t, 0), (0, -1, t), (0, 1, t), (0, -1, -t), (0, 1, -t), (t, 0, -1), (t, 0, 1), (-t, 0, -1), (-t, 0, 1)], float)
    f = np.array([(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8), (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)])
    p /= np.linalg.norm(p, axis=1)[:, None]
    for _ in range(rounds):
        n, half = len(p), np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]])
        key, at = np.unique(half.min(1) * n + half.max(1), return_inverse=True)
        middle = p[key // n] + p[key % n]
        ab, bc, ca = at.reshape(3, -1) + n
        p = np.vstack([p, middle / np.linalg.norm(middle, axis=1)[:, None]])
        f = np.concatenate([np.stack(x, 1) for x in ((f[:, 0], ab, ca), (f[:, 1], bc, ab), (f[:, 2], ca, bc), (ab, bc, ca))])
    return p, f


def grid(n, height):
    p = np.array([(i, j, height(i, j)) for i in range(n) for j in range(n)], float)
    quad = [(i * n + j, (i + 1) * n + j, (i + 1) * n + j + 1, i * n + j + 1) for i in range(n - 1) for j in range(n - 1)]
    return p, np.array([t for a, b, c, d in quad for t in ((a, b, c), (a, c, d))])


def tables(spark, meshes):
    import pandas as pd

    v = pd.concat([pd.DataFrame({"job_id": j, "vid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "u": p[:, 0] / 10}) for j, (p, _) in meshes.items()])
    f = pd.concat([pd.DataFrame({"job_id": j, "fid": np.arange(len(t)), "v0": t[:, 0], "v1": t[:, 1], "v2": t[:, 2]}) for j, (_, t) in meshes.items()])
    return spark.createDataFrame(v), spark.createDataFrame(f)


def plain_quadrics(p, f):
    out = np.zeros((len(p), 4, 4))
    for t in f:
        n = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        plane = np.append(n / np.linalg.norm(n), -n @ p[t[0]] / np.linalg.norm(n))
        for k in t:
            out[k] += np.outer(plane, plane) * np.linalg.norm(n) / 2
    return out


def test_quadrics_and_best_points_equal_plain_ones():
    p, f = sphere(1)
    q = collapse.quadrics(p, f)
    assert np.allclose(q, plain_quadrics(p, f))
    a, b, count, _ = collapse.edge_table(f, len(p))
    assert (count == 2).all() and len(a) == 120
    place, error = collapse.best_points(q[a] + q[b], p[a], p[b], np.zeros(len(a), int))
    at = np.column_stack([place, np.ones(len(a))])
    assert np.allclose(error, np.einsum("ei,eij,ej->e", at, q[a] + q[b], at), atol=1e-9)
    for step in np.eye(3) * 1e-3:
        near = np.column_stack([place + step, np.ones(len(a))])
        assert (np.einsum("ei,eij,ej->e", near, q[a] + q[b], near) >= error - 1e-12).all()


@pytest.mark.parametrize("target,off", [(2000, 3e-3), (300, 2e-2)])
def test_one_patch_reaches_its_target_exactly(target, off):
    p, f = sphere(4)
    at, left, _, _ = collapse.collapse(p, f, collapse.quadrics(p, f), np.zeros(len(p), bool), target, np.zeros((len(p), 0)))
    a, _, count, _ = collapse.edge_table(left, len(p))
    used = np.unique(left)
    assert len(left) == target and (count == 2).all() and len(used) - len(a) + len(left) == 2
    assert abs(np.linalg.norm(at[used], axis=1) - 1).max() < off


def test_locked_corners_and_small_solids_stay():
    p, f = sphere(2)
    locked = p[:, 2] > 0
    at, left, _, _ = collapse.collapse(p, f, collapse.quadrics(p, f), locked, 4, np.zeros((len(p), 0)))
    assert (at[locked] == p[locked]).all() and set(np.flatnonzero(locked)) <= set(np.unique(left)) and len(left) < len(f)
    tetra = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], float), np.array([(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)])
    assert len(collapse.collapse(*tetra, collapse.quadrics(*tetra), np.zeros(4, bool), 1, np.zeros((4, 0)))[1]) == 4


def test_flat_parts_go_first_and_rims_keep_their_corners():
    p, f = grid(21, lambda i, j: 5.0 if i == 10 and j == 10 else 0.0)
    at, left, _, _ = collapse.collapse(p, f, collapse.quadrics(p, f), np.zeros(len(p), bool), 60, np.zeros((len(p), 0)))
    used = np.unique(left)
    assert len(left) <= 60 and at[used][:, 2].max() == pytest.approx(5, abs=1e-6) and at[used][:, 2].min() == pytest.approx(0, abs=1e-6)
    n = np.cross(at[left[:, 1]] - at[left[:, 0]], at[left[:, 2]] - at[left[:, 0]])
    assert n[:, 2].sum() / 2 == pytest.approx(400, rel=1e-6) and {(0, 0), (0, 20), (20, 0), (20, 20)} <= {tuple(np.round(x[:2], 6)) for x in at[used]}


def test_a_sphere_of_many_patches_ends_just_under_its_target(spark):
    small = sphere(2)
    v, f = tables(spark, {"big": sphere(6), "small": small})
    cv, cf = (df.persist() for df in collapse.decimate(v, f, 80_000))
    counts = {r.job_id: r["count"] for r in cf.groupBy("job_id").count().collect()}
    assert 79_900 <= counts["big"] <= 80_000 and counts["small"] == len(small[1])
    assert {(r.open_edges, r.non_manifold_edges) for r in mesh.edge_counts(cf).collect()} == {(0, 0)}
    far = cv.select(mesh.F.max(mesh.F.abs(mesh.F.expr("sqrt(x * x + y * y + z * z)") - 1)).alias("far")).first().far
    assert far < 1e-3 and cv.where("abs(u - x / 10) > 2e-3").count() == 0
    assert {r.job_id: r.volume for r in mesh.volume(cf, cv).collect()}["big"] == pytest.approx(4 / 3 * np.pi, rel=1e-3)


def test_patches_are_cut_elsewhere_in_each_pass(spark, monkeypatch):
    monkeypatch.setattr(collapse, "PATCH", 300)
    v, f = tables(spark, {"a": sphere(4), "b": grid(30, lambda i, j: np.sin(i / 5) * 3)})
    cv, cf = (df.persist() for df in collapse.decimate(v, f, 500))
    facts = {r.job_id: r for r in mesh.edge_counts(cf).join(cf.groupBy("job_id").agg(mesh.F.count("*").alias("nf")), "job_id").join(cv.groupBy("job_id").agg(mesh.F.count("*").alias("nv")), "job_id").collect()}
    assert all(380 <= r.nf <= 500 and r.non_manifold_edges == 0 for r in facts.values())
    assert {j: r.nv - r.n_edges + r.nf for j, r in facts.items()} == {"a": 2, "b": 1} and facts["a"].open_edges == 0
    ev, ef = collapse.decimate(v.limit(0), f.limit(0), 10)
    assert ev.count() == 0 and ef.count() == 0
