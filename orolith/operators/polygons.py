"""Rings in the plane, for the tasks of other operators: loops of directed edges, and triangles of rings with holes."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np


def loops(edges: list[tuple[int, int]], place: dict[int, tuple[float, float]]) -> list[list[int]]:
    """Closed loops of directed edges between numbered places; where several edges leave a place the one most
    to the left of the way in is taken, so loops that touch stay apart. What does not close is left out."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        after.setdefault(a, []).append(b)
    out = []
    for start in sorted(after):
        while after.get(start):
            path, at = [start], {start: 0}
            while True:
                here, ways = path[-1], after.get(path[-1])
                if not ways:
                    break
                nxt = ways[0] if len(ways) == 1 or len(path) < 2 else min(ways, key=lambda b: turned(place[path[-2]], place[here], place[b]))
                ways.remove(nxt)
                if nxt in at:
                    out.append(path[at[nxt] :])
                    for k in path[at[nxt] + 1 :]:
                        del at[k]
                    del path[at[nxt] + 1 :]
                else:
                    at[nxt] = len(path)
                    path.append(nxt)
    return out


def turned(p, q, r) -> float:
    """How far the way p, q, r is turned from sharply left (0) to sharply right (2 pi)."""
    a, b = np.arctan2(q[1] - p[1], q[0] - p[0]), np.arctan2(r[1] - q[1], r[0] - q[0])
    return float((a + np.pi - b) % (2 * np.pi)) or 2 * np.pi


def area2(p: np.ndarray) -> float:
    """Twice the signed area of a ring."""
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())


def holds(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether the ring has (x, y) inside, by crossings to the right."""
    p, q = ring, np.roll(ring, -1, axis=0)
    over = (p[:, 1] > y) != (q[:, 1] > y)
    p, q = p[over], q[over]
    return int((p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]) > x).sum()) % 2 == 1


def grouped(rings: list[list[int]], at: np.ndarray) -> list[tuple[list[int], list[list[int]]]]:
    """Outer rings (counter-clockwise) with their holes (clockwise): each hole goes to the smallest outer ring around it."""
    sizes = [area2(at[r]) for r in rings]
    outer = sorted((k for k, s in enumerate(sizes) if s > 0), key=lambda k: sizes[k])
    holes: dict[int, list[list[int]]] = {k: [] for k in outer}
    for k, s in enumerate(sizes):
        if s < 0:
            x, y = at[rings[k]][0]
            mine = next((o for o in outer if sizes[o] > -s and (set(rings[k]) & set(rings[o]) or holds(at[rings[o]], x, y))), None)
            if mine is not None:
                holes[mine].append(rings[k])
    return [(rings[k], holes[k]) for k in sorted(outer)]


def bridged(outer: list[int], holes: list[list[int]], at: np.ndarray) -> list[int]:
    """One ring of an outer ring and its holes: each hole, the rightmost first, is joined by a cut from its rightmost
    corner to a corner that this one sees."""
    ring = list(outer)
    for hole in sorted(holes, key=lambda h: -at[h][:, 0].max()):
        k = int(at[hole][:, 0].argmax())
        x, y = at[hole[k]]
        p, q = at[ring], np.roll(at[ring], -1, axis=0)
        span = (np.minimum(p[:, 1], q[:, 1]) <= y) & (np.maximum(p[:, 1], q[:, 1]) >= y) & (p[:, 1] != q[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = np.where(span, p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]), np.inf)
        cross[cross < x] = np.inf
        side = int(cross.argmin())
        # the end of the side hit that lies to the right; a corner inside the triangle to it may hide it
        best = side if p[side, 0] > q[side, 0] else (side + 1) % len(ring)
        hit, tip = np.array([cross[side], y]), at[ring[best]]
        inside = within(p, np.array([x, y]), hit, tip) & ~(p == tip).all(axis=1)
        if inside.any():
            seen = np.flatnonzero(inside)
            steep = np.abs(p[seen, 1] - y) / np.maximum(p[seen, 0] - x, 1e-300)
            best = int(seen[np.lexsort((p[seen, 0], steep))[0]])
        # cuts give a place several corners: take the one whose inner angle the hole lies in
        same = np.flatnonzero((p == p[best]).all(axis=1))
        best = next((int(k) for k in same if in_angle(p[k - 1], p[k], q[k], np.array([x, y]))), best)
        ring = ring[: best + 1] + hole[k:] + hole[: k + 1] + ring[best:]
    return ring


def in_angle(a: np.ndarray, b: np.ndarray, c: np.ndarray, at: np.ndarray) -> bool:
    """Whether `at` lies in the angle to the left of the way a, b, c."""
    left = lambda s, t, r: (t[0] - s[0]) * (r[1] - s[1]) - (t[1] - s[1]) * (r[0] - s[0])
    first, then = left(a, b, at) >= 0, left(b, c, at) >= 0
    return bool(first and then if left(a, b, c) > 0 else first or then)


def within(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which points lie in the closed triangle a, b, c of either sense."""
    side = lambda s, t: (t[0] - s[0]) * (p[:, 1] - s[1]) - (t[1] - s[1]) * (p[:, 0] - s[0])
    d = np.stack([side(a, b), side(b, c), side(c, a)])
    return (d >= 0).all(axis=0) | (d <= 0).all(axis=0)


def ears(ring: list[int], at: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (counter-clockwise) of a ring of numbered places that uses all its corners, by cutting ears, those
    with the shortest cut first, so that triangles stay local.

    Only corners that do not turn to the left can lie in an ear, so only they are tried, found by their place along the
    ring's longer side. An ear that holds such a corner waits until this one is cut off or turns to the left. A ring that
    has no ear left by rounding is cut at its least bad corner."""
    left = len(ring)
    if left <= 3:
        return [tuple(ring)] if left == 3 else []
    after, before = [*range(1, left), 0], [left - 1, *range(left - 1)]
    xy = np.asarray(at)[ring]
    x, y = xy[:, 0].tolist(), xy[:, 1].tolist()
    along, across = (x, y) if np.ptp(xy[:, 0]) >= np.ptp(xy[:, 1]) else (y, x)
    level = np.array(across)

    def turn(k):
        a, c = before[k], after[k]
        return (x[k] - x[a]) * (y[c] - y[a]) - (y[k] - y[a]) * (x[c] - x[a])

    p, q = np.roll(xy, 1, axis=0), np.roll(xy, -1, axis=0)
    turns = (xy[:, 0] - p[:, 0]) * (q[:, 1] - p[:, 1]) - (xy[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])
    alive, risky, stamp, out = np.ones(left, bool), turns <= 0, [0] * left, []
    waiting: dict[int, list[int]] = {}
    heap: list[tuple[float, int, int]] = []

    def listed():
        ids = np.flatnonzero(risky)
        ids = ids[np.argsort(np.array(along)[ids], kind="stable")]
        return ids, np.array(along)[ids]

    def asked(k):
        a, c = before[k], after[k]
        heappush(heap, ((x[c] - x[a]) ** 2 + (y[c] - y[a]) ** 2, k, stamp[k]))

    def changed(k):
        turns[k] = turn(k)
        stamp[k] += 1
        was, risky[k] = risky[k], turns[k] <= 0
        if risky[k] and not was:
            late.append(k)
        if turns[k] > 0:
            asked(k)
            freed(k)

    def freed(k):
        for w in waiting.pop(k, []):
            if alive[w] and turns[w] > 0:
                asked(w)

    index, places = listed()
    n_risky, late = len(index), []  # late ones turned to the right by rounding, after they were listed
    for k in np.flatnonzero(turns > 0).tolist():
        asked(k)
    while left > 3:
        here = None
        while heap:
            _, k, n = heappop(heap)
            if not alive[k] or n != stamp[k]:
                continue
            a, c = before[k], after[k]
            three = (along[a], along[k], along[c])
            near = index[np.searchsorted(places, min(three)) : np.searchsorted(places, max(three), "right")]
            three = (across[a], across[k], across[c])
            near = near[risky[near] & (level[near] >= min(three)) & (level[near] <= max(three))]
            near = np.concatenate([near, [w for w in late if risky[w]]]).astype(int) if late else near
            if len(near):
                put = xy[near]
                near = near[within(put, xy[a], xy[k], xy[c]) & ~((put == xy[a]).all(1) | (put == xy[k]).all(1) | (put == xy[c]).all(1))]
            if not len(near):
                here = k
                break
            waiting.setdefault(int(near[0]), []).append(k)
        if here is None:  # none is left
            rest = np.flatnonzero(alive)
            here = int(rest[np.abs(turns[rest]).argmin()])
        a, c = before[here], after[here]
        out.append((ring[a], ring[here], ring[c]))
        alive[here] = risky[here] = False
        after[a], before[c] = c, a
        left -= 1
        changed(a)
        changed(c)
        freed(here)
        if left < n_risky:
            index, places = listed()
            n_risky, late = min(len(index), left) // 2, []
    a = int(np.flatnonzero(alive)[0])
    out.append((ring[a], ring[after[a]], ring[after[after[a]]]))
    return out


def triangles(rings: list[list[int]], at: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of the area that rings of numbered places bound: outer rings counter-clockwise, holes clockwise."""
    out = []
    for outer, holes in grouped(rings, at):
        out += ears(bridged(outer, holes, at), at)
    return out
