"""Components by bands of numbers against plain union."""

import random

import numpy as np
import pytest

from orolith.operators import graph


def brute(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(root)}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_banded_components(spark, width):
    rng, rows = random.Random(4), []
    for job in ("x", "y", None):
        rows += [(job, k, k + 1) for k in range(-30, 0)]
        rows += [(job, rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    df = spark.createDataFrame(rows, "job_id string, a long, b long").repartition(3)
    got = {}
    for r in graph.banded(df.where("job_id IS NOT NULL"), ["job_id"], width).collect():
        assert (r.job_id, r.node) not in got
        got[r.job_id, r.node] = r.root
    for job in ("x", "y"):
        assert {n: r for (j, n), r in got.items() if j == job} == brute([(a, b) for j, a, b in rows if j == job])


def test_least_reachable_on_a_long_path():
    order = np.random.default_rng(1).permutation(5000)
    node, root = graph.least_reachable(order[:-1], order[1:])
    assert (node == np.arange(5000)).all() and (root == 0).all()
    node, root = graph.least_reachable(np.array([3, 9]), np.array([3, 8]))
    assert node.tolist() == [3, 8, 9] and root.tolist() == [3, 8, 8]
