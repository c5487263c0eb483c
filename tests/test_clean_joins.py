"""What cleaning a mesh shuffles."""

from test_cutting import tables, torus

from orolith.operators import mesh


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_soup_is_cleaned_and_its_rim_needs_no_window(spark):
    """repeated and thin faces go, and half-edges are added up before they are shuffled."""
    at, ts = torus(8, 6)
    soup = [at[k] for t in ts for k in t]
    v, f = tables(spark, {"a": (soup + [(9.0, 9.0, 9.0)], [(3 * k, 3 * k + 1, 3 * k + 2) for k in range(len(ts))] + [(0, 1, 2), (0, 0, 1)])})
    cv, cf = mesh.clean(v, f)
    assert cv.count() == len(at) and cf.count() == len(ts) and {r.fid for r in cf.collect()} == set(range(len(ts)))
    assert [(r.open_edges, r.non_manifold_edges) for r in mesh.edge_counts(cf).collect()] == [(0, 0)]
    assert "Window" not in plan(mesh.rim(f)) and mesh.rim(f.where("fid < 3")).count() >= 3
