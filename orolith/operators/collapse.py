"""Meshes made coarser by collapsing edges, least quadric error first.

Each vertex has a quadric: the sum over its faces of the squared distance to their planes, weighed by area, and
for open edges of the plane upright on them. An edge collapses to the point of least error of both quadrics. In a
round, all edges collapse that are least among the edges of their own and their neighbours' corners, so no face
meets two of them; an edge is left alone if it fails the link condition (what both ends have as neighbours must be the corners
opposite to it), if it would join two parts of a border, or if a face would turn over.

Jobs are cut into patches of about PATCH faces that lie together (in Morton order, counted by blocks), one for each task. A task
collapses what lies inside its patch down to the patch's share of the target and leaves corners of other patches where
they are; the next pass cuts the patches elsewhere. So a job needs a few passes, each of three shuffles, however many faces it has. The share is
even over the job, and the least errors come first within a patch.

Defined results: jobs with at most `target` faces stay as they are; a job ends at the target or under it by a few faces a patch, or above
it where no edge is left that may collapse; numbers besides x, y and z are averaged; vertices without a face stay only in jobs that are
left alone; repeated faces and edges of more than two faces never collapse; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.operators import mesh
from orolith.operators.raster import JOB
from orolith.storage import sized, stored

#: Faces of a patch and of a block, bits of a Morton code for each axis, and the least cosine between a face before and after.
PATCH, BLOCK, BITS, UPRIGHT = 16_384, 256, 20, 0.2


def quadrics(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """(n, 4, 4): the quadric of each vertex, from its faces and its open edges."""
    out = np.zeros((len(points), 4, 4))
    p = points[faces]
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.linalg.norm(n, axis=1)
    ok = size > 0
    unit = n[ok] / size[ok, None]
    plane = np.column_stack([unit, -(unit * p[ok, 0]).sum(1)])
    q = plane[:, :, None] * plane[:, None, :] * size[ok, None, None] / 2
    for k in range(3):
        np.add.at(out, faces[ok, k], q)
    a, b, count, face = edge_table(faces, len(points))
    rim = (count == 1) & ok[face]
    side = points[b[rim]] - points[a[rim]]
    wall = np.cross(side, n[face[rim]])
    length = np.linalg.norm(wall, axis=1)
    good = length > 0
    wall = wall[good] / length[good, None]
    plane = np.column_stack([wall, -(wall * points[a[rim][good]]).sum(1)])
    q = plane[:, :, None] * plane[:, None, :] * (side[good] ** 2).sum(1)[:, None, None]
    np.add.at(out, a[rim][good], q)
    np.add.at(out, b[rim][good], q)
    return out


def edge_table(faces: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, faces, one face) of each edge, a < b."""
    half = np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]])
    key = half.min(1) * n + half.max(1)
    key, first, count = np.unique(key, return_index=True, return_counts=True)
    return key // n, key % n, count, first % len(faces) if len(faces) else first


def best_points(q: np.ndarray, one: np.ndarray, other: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, errors): where the quadric is least for each edge, seen from its middle; an end that is fixed (1 or 2) is the point itself."""
    middle = (one + other) / 2
    shift = np.broadcast_to(np.eye(4), q.shape).copy()
    shift[:, :3, 3] = middle
    local = np.swapaxes(shift, 1, 2) @ q @ shift
    a, b = local[:, :3, :3], -local[:, :3, 3]
    scale = np.trace(a, axis1=1, axis2=2)
    sure = np.linalg.det(a) > 1e-6 * np.maximum(scale, 1e-300) ** 3
    move = np.zeros_like(middle)
    move[sure] = np.linalg.solve(a[sure], b[sure][:, :, None])[:, :, 0]
    half = (other - one) / 2
    far = np.linalg.norm(move, axis=1) > 2 * np.linalg.norm(half, axis=1) + 1e-300
    choices = np.stack([np.where((sure & ~far)[:, None], move, 0.0), np.zeros_like(half), -half, half])
    homogeneous = np.concatenate([choices, np.ones((*choices.shape[:2], 1))], axis=2)
    error = np.einsum("kei,eij,kej->ke", homogeneous, local, homogeneous)
    pick = np.where(fixed == 1, 2, np.where(fixed == 2, 3, error.argmin(0)))
    at = np.arange(len(pick))
    return middle + choices[pick, at], np.maximum(error[pick, at], 0.0)


def linked(a: np.ndarray, b: np.ndarray, ends: tuple[np.ndarray, np.ndarray], locked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each edge (a, b): neighbours that both ends have, neighbours of either one, and whether an end that is free beside a
    locked one has no further locked neighbours; ends are the mesh's edges. Locked neighbours may be joined in another patch."""
    n = len(locked)
    u, v = np.concatenate(ends), np.concatenate(ends[::-1])
    by = np.argsort(u, kind="stable")
    u, v = u[by], v[by]
    start = np.searchsorted(u, np.arange(n + 1))
    owner, near = [], []
    for x in (a, b):
        size = start[x + 1] - start[x]
        owner.append(np.repeat(np.arange(len(a)), size))
        near.append(v[np.repeat(start[x] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])
    key, count = np.unique(np.concatenate(owner) * n + np.concatenate(near), return_counts=True)
    both = key[count == 2]
    known = np.bincount(both // n, weights=locked[both % n], minlength=len(a))
    near_locked = np.bincount(u, weights=locked[v], minlength=n)
    alone = ~(locked[a] | locked[b]) | (near_locked[np.where(locked[a], b, a)] - 1 == known)
    return np.bincount(both // n, minlength=len(a)), np.bincount(key // n, minlength=len(a)), alone


def collapse(points: np.ndarray, faces: np.ndarray, q: np.ndarray, locked: np.ndarray, target: int, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, faces, quadrics, more) after rounds of collapses down to `target` faces; `more` has further numbers of the
    vertices, averaged. Vertices keep their numbers, a collapsed edge that of its smaller or locked end; locked ones stay."""
    n, banned = len(points), np.zeros(0, np.int64)
    points, faces, q, more = points.copy(), faces.copy(), q.copy(), more.copy()
    while len(faces) > target:
        a, b, count, _ = edge_table(faces, n)
        rim = np.zeros(n, bool)
        rim[a[count == 1]], rim[b[count == 1]] = True, True
        odd = np.zeros(n, bool)
        odd[a[count > 2]], odd[b[count > 2]] = True, True
        free = ~(locked[a] & locked[b]) & ~(rim[a] & rim[b] & (count != 1)) & ~odd[a] & ~odd[b] & ~np.isin(a * n + b, banned)
        ca, cb, cn = a[free], b[free], count[free]
        if not len(ca):
            break
        place, error = best_points(q[ca] + q[cb], points[ca], points[cb], np.where(locked[ca], 1, np.where(locked[cb], 2, 0)))
        length = ((points[ca] - points[cb]) ** 2).sum(1)
        rank = np.empty(len(ca), np.int64)
        rank[np.argsort(error + 1e-7 * length * length, kind="stable")] = np.arange(len(ca))
        least = np.full(n, len(ca))
        np.minimum.at(least, ca, rank)
        np.minimum.at(least, cb, rank)
        around = least.copy()
        np.minimum.at(around, a, least[b])
        np.minimum.at(around, b, least[a])
        win = np.flatnonzero((rank == around[ca]) & (rank == around[cb]))
        common, either, alone = linked(ca[win], cb[win], (a, b), locked)
        good = alone & (common == cn[win]) & (either - 2 >= np.where(cn[win] == 2, 3, 2))
        # faces with one end of a winner move; with both they go
        owner = np.full(n, -1)
        owner[ca[win]], owner[cb[win]] = np.arange(len(win)), np.arange(len(win))
        of = owner[faces]
        which = of.max(1)
        moved = (which >= 0) & ((of >= 0).sum(1) == 1)
        before = points[faces[moved]]
        after = np.where((of[moved] >= 0)[:, :, None], place[win][which[moved]][:, None, :], before)
        old, new = (np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]) for x in (before, after))
        size = np.linalg.norm(old, axis=1) * np.linalg.norm(new, axis=1)
        over = ((old * new).sum(1) <= UPRIGHT * size) & (np.linalg.norm(old, axis=1) > 0)
        good[which[moved][over]] = False
        banned = np.concatenate([banned, ca[win[~good]] * n + cb[win[~good]]])
        win = win[good]
        if not len(win):
            continue
        win = win[np.argsort(rank[win])]
        gone = np.cumsum(cn[win])
        win = win[: int(np.searchsorted(gone, len(faces) - target)) + 1]
        keep = np.where(locked[cb[win]], cb[win], ca[win])
        drop = ca[win] + cb[win] - keep
        points[keep] = np.where(locked[keep][:, None], points[keep], place[win])
        more[keep] = np.where(locked[keep][:, None], more[keep], (more[keep] + more[drop]) / 2)
        q[keep] = q[keep] + q[drop]
        to = np.arange(n)
        to[drop] = keep
        faces = to[faces]
        faces = faces[(faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 0] != faces[:, 2])]
        changed = np.zeros(n, bool)
        changed[keep] = True
        banned = banned[~changed[banned // n] & ~changed[banned % n]]
    return points, faces, q, more


def patches(faces: DataFrame, vertices: DataFrame, count: DataFrame, turn: int) -> DataFrame:
    """faces with patch: faces in Morton order of their first corners, cut by counts of blocks of that order. `turn` moves the grid of the order.

    Blocks are cubes of about BLOCK faces, were the mesh flat in the two longest sides of its box: a surface that is rough across
    stays in one layer of them, so patches hang together and share few corners."""
    size = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]
    sides = F.array_sort(F.array(*size))
    flat = F.sqrt(F.get(sides, F.lit(1)) * F.get(sides, F.lit(2)) * BLOCK / F.col("nf"))
    cube = F.greatest(flat, F.get(sides, F.lit(2)) * 1.5 / ((1 << BITS) - 1), F.lit(1e-300))
    box = mesh.bounds(vertices).join(sized(count), JOB)
    box = box.select(*JOB, "nf", *[f"min_{c}" for c in "xyz"], cube.alias("__cube"), (F.get(sides, F.lit(2)) * (turn % 4 / 7)).alias("__shift"))
    at = faces.join(vertices.select(*JOB, F.col("vid").alias("v0"), "x", "y", "z"), [*JOB, "v0"]).join(sized(box), JOB)

    def level(c: str) -> Column:
        return F.least(F.floor((F.col(c) - F.col(f"min_{c}") + F.col("__shift")) / F.col("__cube")), F.lit((1 << BITS) - 1)).cast("long")

    levels = {c: F.col(f"__{c}") for c in "xyz"}
    block = F.lit(0).cast("long")
    for bit in range(BITS):
        for k, c in enumerate("xyz"):
            block = block + F.shiftleft(F.shiftright(levels[c], bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + k)
    at = at.select(*faces.columns, "nf", *[level(c).alias(f"__{c}") for c in "xyz"])
    at = stored(at.select(*faces.columns, "nf", block.alias("__block")), "blocks")
    counts = at.groupBy(*JOB, "__block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*JOB).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counts.select(*JOB, "__block", F.floor((before + F.col("n") / 2) / PATCH).cast("long").alias("patch"))
    return at.join(sized(numbered), [*JOB, "__block"]).drop("__block")


def decimate(vertices: DataFrame, faces: DataFrame, target: int, passes: int = 12) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of meshes (job_id, vid, x, y, z, ...) and (job_id, fid, v0, v1, v2) with at most `target` faces a job."""
    further = [f.name for f in vertices.schema.fields if f.name not in (*JOB, "vid", "x", "y", "z")]
    count = stored(faces.groupBy(*JOB).agg(F.count("*").alias("nf")), "face-counts")
    large = count.where(F.col("nf") > target)
    done = count.where(F.col("nf") <= target).select(*JOB)
    out_v, out_f = vertices.join(sized(done), JOB, "left_semi"), faces.select(*JOB, "fid", "v0", "v1", "v2").join(sized(done), JOB, "left_semi")
    if large.isEmpty():
        return out_v, out_f
    v = vertices.join(sized(large.select(*JOB)), JOB, "left_semi").withColumn("q", F.lit(None).cast("array<double>"))
    v, f = stored(v, "rough-vertices"), stored(faces.select(*JOB, "fid", "v0", "v1", "v2").join(sized(large.select(*JOB)), JOB, "left_semi"), "rough-faces")
    extra = "".join(f", `{c}` double" for c in further)
    schema = f"job_id string, fid long, v0 long, v1 long, v2 long, vid long, x double, y double, z double, q array<double>, locked boolean{extra}"

    def run(key: tuple, mine: pd.DataFrame, corners: pd.DataFrame) -> pd.DataFrame:
        corners = corners.sort_values("vid")
        ids, points = corners["vid"].to_numpy(), corners[["x", "y", "z"]].to_numpy(float)
        tri = np.searchsorted(ids, mine[["v0", "v1", "v2"]].to_numpy())
        fresh = corners["q"].isna().to_numpy()
        q = quadrics(points, tri)
        if not fresh.all():
            q[~fresh] = np.stack(corners["q"][~fresh].to_list()).reshape(-1, 4, 4)
        locked, more = corners["locked"].to_numpy(), corners[further].to_numpy(float)
        points, left, q, more = collapse(points, tri, q, locked, int(len(tri) * target // int(mine["nf"].iloc[0])), more)
        used = np.unique(left)
        a = pd.DataFrame({"job_id": key[0], "fid": mine["fid"].to_numpy()[: len(left)], **{f"v{k}": ids[left[:, k]] for k in range(3)}, "q": [None] * len(left), "locked": False})
        b = pd.DataFrame({"job_id": key[0], "vid": ids[used], **dict(zip("xyz", points[used].T, strict=True)), "q": list(q[used].reshape(-1, 16)), "locked": locked[used], **{c: more[used, k] for k, c in enumerate(further)}})
        out = pd.concat([a, b])
        return out[["job_id", "fid", "v0", "v1", "v2", "vid", "x", "y", "z", "q", "locked", *further]].astype({c: "Int64" for c in ("fid", "v0", "v1", "v2", "vid")})

    for turn in range(passes):
        dealt = stored(patches(f, v, large, turn), "patches")
        used = dealt.select(*JOB, "patch", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
        shared = used.groupBy(*JOB, "vid").agg((F.count("*") > 1).alias("locked"))
        corners = stored(used.join(v, [*JOB, "vid"]).join(shared, [*JOB, "vid"]), "patch-corners")
        # only corners inside a patch have all their faces there
        worked = stored(dealt.groupBy(*JOB, "patch").cogroup(corners.groupBy(*JOB, "patch")).applyInPandas(run, schema), "collapsed")
        f = worked.where("fid IS NOT NULL").select(*JOB, "fid", "v0", "v1", "v2")
        kept = worked.where("fid IS NULL AND NOT locked").select(v.columns)
        still = stored(v.join(shared.where("locked"), [*JOB, "vid"], "left_semi").select(v.columns), "locked")
        v = stored(mesh.referenced(kept.unionByName(still), f), "coarse-vertices")
        now = stored(f.groupBy(*JOB).agg(F.count("*").alias("nf")), "face-counts")
        stuck = now.withColumnRenamed("nf", "now").join(large, JOB).where((F.col("now") <= target) | (F.lit(turn % 4 == 3) & (F.col("now") == F.col("nf"))))
        ready = stored(stuck.select(*JOB) if turn < passes - 1 else now.select(*JOB), "ready")
        out_v = out_v.unionByName(v.drop("q").join(sized(ready), JOB, "left_semi"))
        out_f = out_f.unionByName(f.join(sized(ready), JOB, "left_semi"))
        large = stored(now.join(sized(ready), JOB, "left_anti"), "still-large")
        if large.isEmpty():
            break
        v, f = stored(v.join(sized(large.select(*JOB)), JOB, "left_semi"), "rough-vertices"), stored(f.join(sized(large.select(*JOB)), JOB, "left_semi"), "rough-faces")
    return out_v, out_f
