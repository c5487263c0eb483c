"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orolith.storage import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table of longs: (node, root), root the least node reachable.

    Alternates large-star and small-star steps, a few rounds of joins and grouped minima, each
    round stored in the shared folder. No group is gathered: a hub's edges are only joined with
    their minimum. Nodes without an edge are not listed.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e, before = stored(e, "edges"), None
    while True:
        both = e.select("a", "b").union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.union(least).distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = now


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def banded(edges: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by, node, root): components of edges (by, a, b) of longs whose numbers tell where they lie.

    Edges are dealt to bands of `width` numbers by their smaller end, and a task joins up one band; then only
    what nodes in several bands link is left for `components`. Bands must hold few edges: those of a
    mesh's vertices or a raster's rows do. Nodes without an edge are not listed."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        node, root = least_reachable(frame["a"].to_numpy(), frame["b"].to_numpy())
        out = pd.DataFrame({"node": node, "root": root})
        for k, name in enumerate(by):
            out.insert(k, name, key[k])
        return out

    band = F.floor(F.least("a", "b") / F.lit(width)).cast("long")
    dealt = edges.select(*by, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), band.alias("__band"))
    local = dealt.groupBy(*by, "__band").applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "node long", "root long"]))
    local = stored(local, "band-components")
    ends = local.groupBy(*by, "node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(*by, "node", "lo")
    place = lambda c: F.struct(*by, F.col(c).alias("node"))
    links = stored(local.join(ends, [*by, "node"]).where("root <> lo").select(place("root").alias("a"), place("lo").alias("b")).distinct(), "band-links")
    if links.isEmpty():
        return local
    roots = components(links).select(*[F.col(f"node.{c}").alias(c) for c in by], F.col("node.node").alias("root"), F.col("root.node").alias("__top"))
    joined = local.join(roots, [*by, "root"], "left")
    return joined.groupBy(*by, "node").agg(F.min(F.coalesce("__top", "root")).alias("root"))
