"""Triangles of long sections."""

import numpy as np
import pytest

from orolith.operators import polygons


def test_ears_of_a_long_section_look_at_few_corners(monkeypatch):
    """F8: a rough bar of 4,000 corners, whose level side has half of them."""
    n, seen, within = 2000, [], polygons.within
    monkeypatch.setattr(polygons, "within", lambda p, *abc: seen.append(len(p)) or within(p, *abc))
    x, rng = np.linspace(0, 200, n), np.random.default_rng(1)
    at = np.vstack([np.column_stack([x, np.zeros(n)]), np.column_stack([x, 1 + rng.random(n) * 0.02])[::-1]])
    tri = polygons.triangles([list(range(2 * n))], at)
    areas = [polygons.area2(at[list(t)]) for t in tri]
    assert len(tri) == 2 * n - 2 and min(areas) > 0 and sum(areas) == pytest.approx(polygons.area2(at))
    assert sum(seen) < 200 * n
