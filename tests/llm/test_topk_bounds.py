"""Top-k on clustered and on very large vectors, and how the tree grows and prunes."""

import math

import numpy as np
import pytest

from orolith.llm import exact_topk
from orolith.llm.exact_topk import CoverTree


def brute(rows, k, every):
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    out = []
    for q, a in whole.items():
        if q % every == 0:
            best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True)))), p) for p, b in whole.items() if p != q)[:k]
            out += [(q, r, p, -s) for r, (s, p) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.search(df, **how).collect())


@pytest.mark.parametrize("scale", [2.0**15, 2.0**21, 2.0**26, 2.0**29])
def test_large_components_are_exact(spark, scale):
    """Sums below 2^53, below 2^63 and beyond that."""
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in np.floor(rng.uniform(-1, 1, 5) * scale)]) for i in range(80)]
    assert found(spark, rows, k=6, every=10) == brute(rows, 6, 10)


def test_components_beyond_long(spark):
    rows = [(0, [1e30, 0.0]), (1, [1.0, 2.0]), (2, [-1e30, 1.0]), (20, [0.0, 1.0])]
    top = (1 << 63) - 1
    got = found(spark, rows, k=3, every=20)
    assert got[:3] == [(0, 1, 1, top), (0, 2, 20, 0), (0, 3, 2, -top - 1)]


def test_clusters_copies_and_bands(spark, monkeypatch):
    """A third of the rows is one vector; nodes are small, so leaves, bands and blocks all are many."""
    for name, value in (("BLOCK", 16), ("QUERIES", 8), ("LEAF", 24)):
        monkeypatch.setattr(exact_topk, name, value)
    rng = np.random.default_rng(3)
    centres = 30 * rng.normal(size=(8, 6))
    vectors = [centres[k % 8] + rng.normal(size=6) * (1 + k % 5) for k in range(400)] + [centres[0]] * 200
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert found(spark, rows, k=7, every=20) == brute(rows, 7, 20)
    assert found(spark, rows, k=7, every=20, sample=50) == brute(rows, 7, 20)


def test_tree_covers_and_deepens():
    rng = np.random.default_rng(1)
    points = np.unique(np.floor(64 * rng.normal(size=(2000, 8))), axis=0)
    depths = []
    for leaves in (1, 8, 64, 256):
        tree = CoverTree.over(points, leaves)
        assert leaves / 2 <= len(tree.points) <= 2 * leaves
        leaf, dist = tree.nearest(points)
        radii = tree.radii(np.array([dist[leaf == k].max() if (leaf == k).any() else -1.0 for k in range(len(tree.points))]))
        depth = {len(tree.children) - 1: 0}
        for n in range(len(tree.children) - 1, -1, -1):
            for c in tree.children[n]:
                depth[c] = depth[n] + 1
                assert c < n
        depths.append(max(depth.values()))
        under = {k: {k} for k in range(len(tree.points))}
        for n in range(len(tree.points), len(tree.children)):
            under[n] = set().union(*(under[c] for c in tree.children[n]))
            rows = points[np.isin(leaf, list(under[n]))]
            assert not len(rows) or np.linalg.norm(rows - tree.points[tree.center[n]], axis=1).max() <= radii[n] + 1e-6
        assert under[len(tree.children) - 1] == set(range(len(tree.points)))
        tops = tree.tops(8)
        assert set().union(*(under[t] for t in tops)) == set(range(len(tree.points))) and sum(len(under[t]) for t in tops) == len(tree.points)
    assert depths == sorted(depths) and depths[-1] > depths[1]


def test_walks_below_tops_are_the_whole_walk():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(60, 5)) + 30 * rng.normal(size=5) for _ in range(12)])
    tree = CoverTree.over(points, 40)
    leaf, dist = tree.nearest(points)
    m = len(tree.points)
    radii = tree.radii(np.array([dist[leaf == k].max() if (leaf == k).any() else -1.0 for k in range(m)]))
    bar = np.array([np.sort(points[leaf == k] @ points.T, axis=1)[:, -6].min() if (leaf == k).any() else np.inf for k in range(m)])
    whole = set(tree.walk(radii, radii, bar))
    parts = [tree.walk(radii, radii, bar, top) for top in tree.tops(10)]
    assert whole == set().union(*map(set, parts)) and sum(map(len, parts)) == len(whole)
    assert len(whole) < 0.6 * (radii[:m] >= 0).sum() ** 2
    for i in range(len(points)):
        for j in np.argsort(-(points @ points[i]))[:6]:
            assert (leaf[i], leaf[j]) in whole
