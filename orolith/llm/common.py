"""Small pieces that several operators share: shared storage, row keys, components, exact selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orolith.operators.graph import components
from orolith.storage import BROADCAST_ROWS, fits_broadcast, removed, scratch, shared_dir, sized, stored, table_path

__all__ = ["BROADCAST_ROWS", "components", "fits_broadcast", "kth_largest", "others", "removed", "row_keys", "scratch", "shared_dir", "sized", "stored", "table_path"]


def others(df: DataFrame, *made: str) -> list[Column]:
    """The columns of df but those that an operator makes anew under the same name."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in {m.lower() for m in made}]


def row_keys(*cols: str | Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns: a key of 128 bits for rows without a sure id."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*cs), F.xxhash64(F.lit(7), *reversed(cs), F.lit(1))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest finite value of a double column, exactly; None if there are fewer than k.

    Counts narrow an interval step by step; only `bins` counts reach the driver each time.
    """
    v = F.col(col)
    lo, hi, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    if k < 1 or n < k:
        return None
    above = 0
    while True:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        cell = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        found = df.where(v.between(lo, hi)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy(F.desc("c")).collect()
        for r in found:
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        if lo == hi or r.n <= 1:
            break
    if lo == hi:
        return lo
    rest = df.where(v.between(lo, hi)).groupBy(v.alias("v")).count().orderBy(F.desc("v")).limit(bins).collect()
    for r in rest:
        above += r["count"]
        if above >= k:
            return r.v
    return lo
