"""Exact top-k inner-product search with a dual cover tree (operator 5).

Queries and data are indexed together. A cover tree, in which a node's children lie within half of its
radius of their centers as far as WIDTH of them suffice, is laid over a sample of at most `sample` rows
(those of the smallest hash), down to a leaf for each LEAF rows of the table, or each eighth row
of the sample if that is less. Every row goes to its nearest leaf. Below, a leaf's rows are cut into
bands by their distance to its point, a band for each BLOCK rows and BANDS at most; rows that no
distance tells apart are dealt by hash. A leaf has, apart for queries and data, the largest distance
of its rows to its point, a band has its own; inner nodes get their radii from those below.

For a node pair no inner product exceeds <q, p> + rq |p| + rp |q| + rq rp. Each query leaf first
scores the data leaves nearest by, which gives its queries' k-th scores; the worst of them is the
leaf's bar. The two trees are then walked together, one task a part of the query tree, and a pair whose
bound is under the bar of every query leaf below it is pruned; bands of a leaf pair are pruned in the
same way. Query leaves that are neighbours form groups of up to QUERIES rows; what is left for a group
is scored in blocks of about BLOCK rows, a matrix product each, and the k best of each query and
block are merged. On vectors without structure nothing can be pruned, and the work is that of all pairs.

Components become floor(64 x) as integers (beyond the range of long, its end) and scores are their exact
integer inner products: by floating point where all sums stay below 2^53, else by 64-bit integers, else
by Python's. A score beyond the range of long is its end, and ties there go to the smaller id.
Defined results: a vector that is null, or holds null or non-finite components, takes no part, nor
does a row of null id; a shorter vector counts as padded with zeros; rows that share an id are each
a query and a candidate, of each other too; equal scores go to the smaller id; fewer than k candidates are all
listed; an empty table gives an empty result. The bounds hold for any data, so the result is exact
whatever the sample; only the amount of pruning depends on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orolith.llm import common

#: Rows of data in a block, of queries in a group or a block of one, and of a leaf as far as the sample allows.
BLOCK, QUERIES, LEAF = 4096, 1024, 1024
#: Children of a tree node, bands of a leaf, and parts of the query tree that are walked by themselves.
WIDTH, BANDS, WALKS = 8, 32, 64
LONG = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """floor(64 x) of each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("long"))
    return F.when(vector.isNotNull() & ~bad, ints)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of an integer matrix, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(column) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    if len(flat):
        out[rows, np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)] = flat
    return out


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The exact inner products of integer rows, made in the plainest type that holds all sums; one
    beyond the range of long is its end."""
    top = max(1, q.shape[1]) * int(np.abs(q.astype(object)).max(initial=0)) * int(np.abs(p.astype(object)).max(initial=0))
    if top < 1 << 53:
        return q.astype(np.float64) @ p.astype(np.float64).T
    return q @ p.T if top <= LONG else np.clip(q.astype(object) @ p.astype(object).T, -LONG - 1, LONG).astype(np.int64)


def span(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Distances of rows to a point (or to one each), with room for rounding."""
    return np.linalg.norm(rows - point, axis=1) * (1 + 1e-9) + 1e-9 * np.linalg.norm(rows, axis=1)


@dataclass(frozen=True)
class CoverTree:
    """Leaf points and, for each inner node, its children; node numbers below len(points) are leaves."""

    points: np.ndarray
    children: list[list[int]]
    center: np.ndarray  # of each node, the number of its point

    @staticmethod
    def over(sample: np.ndarray, leaves: int) -> CoverTree:
        """A node takes centers farthest first, beginning with its own, until all its rows are within
        half of its radius or it has WIDTH; the leaves are shared out by the rows that each gets."""
        sample = sample.astype(np.float64)
        points, inner = [], []  # inner nodes as lists of (is leaf, number)

        def grow(rows: np.ndarray, want: int) -> tuple[bool, int]:
            far = np.linalg.norm(sample[rows] - sample[rows[0]], axis=1)
            if want <= 1 or far.max() == 0:
                points.append(sample[rows[0]])
                return True, len(points) - 1
            half, owner, n = far.max() / 2, np.zeros(len(rows), int), 1
            while n < min(WIDTH, want) and (n < 2 or far.max() > half):
                d = np.linalg.norm(sample[rows] - sample[rows[int(far.argmax())]], axis=1)
                owner, far, n = np.where(d < far, n, owner), np.minimum(far, d), n + 1
            parts = [rows[owner == k] for k in range(n)]
            below = [grow(part, max(1, round(want * len(part) / len(rows)))) for part in parts if len(part)]
            inner.append(below)
            return False, len(inner) - 1

        grow(np.arange(len(sample)), max(1, leaves))
        m = len(points)
        children = [[] for _ in points] + [[k if leaf else m + k for leaf, k in below] for below in inner]
        center = list(range(m))
        for below in children[m:]:
            center.append(center[below[0]])
        return CoverTree(np.array(points), children, np.array(center))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and distance of each row."""
        rows, leaf = rows.astype(np.float64), np.zeros(len(rows), int)
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            leaf[at : at + 1024] = ((self.points**2).sum(1)[None] - 2 * part @ self.points.T).argmin(1)
        return leaf, span(rows, self.points[leaf])

    def radii(self, leaf_radii: np.ndarray) -> np.ndarray:
        """Of all nodes; -1 for a node without rows. Children have smaller numbers than parents."""
        out = np.full(len(self.children), -1.0)
        out[: len(leaf_radii)] = leaf_radii
        for n in range(len(leaf_radii), len(out)):
            for c in self.children[n]:
                if out[c] >= 0:
                    out[n] = max(out[n], out[c] + np.linalg.norm(self.points[self.center[c]] - self.points[self.center[n]]))
        return out

    def tops(self, most: int) -> list[int]:
        """Nodes that hold all leaves between them: the widest level of at most `most` nodes."""
        level = [len(self.children) - 1]
        while True:
            below = [c for n in level for c in (self.children[n] or [n])]
            if len(below) > most or len(below) == len(level):
                return level
            level = below

    def groups(self, asked: np.ndarray, most: int, top: int, number: int = 0) -> dict[int, int]:
        """A number for each leaf below `top`: leaves that are neighbours in the tree share one as long
        as they have at most `most` queries together."""
        out, held, work = {}, 0, [top]
        while work:
            n = work.pop()
            work += self.children[n]
            if not self.children[n]:
                if held and held + asked[n] > most:
                    number, held = number + 1, 0
                out[n], held = number, held + asked[n]
        return out

    def bounds(self, q: np.ndarray, p: np.ndarray, rq: np.ndarray, rp: np.ndarray) -> np.ndarray:
        """The most that rows within rq of node q's center and rp of node p's can score."""
        a, b = self.points[self.center[q]], self.points[self.center[p]]
        na, nb = np.linalg.norm(a, axis=1) + rq, np.linalg.norm(b, axis=1) + rp
        return (a * b).sum(1) + na * nb - (na - rq) * (nb - rp) + 1e-9 * na * nb + 1e-6

    def walk(self, rq: np.ndarray, rp: np.ndarray, bar: np.ndarray, top: int | None = None) -> list[tuple[int, int]]:
        """Leaf pairs that may hold a score at or above the query leaf's bar, of queries below `top`."""
        root, m = len(self.children) - 1, len(self.points)
        low = np.full(len(self.children), np.inf)
        low[:m] = np.where(rq[:m] >= 0, bar, np.inf)
        for n in range(m, len(low)):
            low[n] = min(low[c] for c in self.children[n])
        size = np.array([len(c) for c in self.children])
        start, flat = np.concatenate([[0], np.cumsum(size)[:-1]]), np.array([c for below in self.children for c in below], int)
        q, p, out = np.array([root if top is None else top]), np.array([root]), []
        while len(q):
            ok = (rq[q] >= 0) & (rp[p] >= 0)
            q, p = q[ok], p[ok]
            ok = self.bounds(q, p, rq[q], rp[p]) >= low[q]
            q, p = q[ok], p[ok]
            done = (q < m) & (p < m)
            out.append(np.stack([q[done], p[done]], 1))
            q, p = q[~done], p[~done]
            split_q = (q >= m) & ((p < m) | (rq[q] >= rp[p]))
            one, other = np.where(split_q, q, p), np.where(split_q, p, q)
            n = size[one]
            below = flat[np.repeat(start[one] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(one) else one
            other, split_q = np.repeat(other, n), np.repeat(split_q, n)
            q, p = np.where(split_q, below, other), np.where(split_q, other, below)
        return [tuple(x) for x in np.concatenate(out).tolist()]


def best_of_blocks(k: int, width: int):
    """Grouped function: the k best of a block of data rows for each query of a group, as far as they
    reach what the query has already (`low`)."""

    def run(table: pa.Table) -> pa.Table:
        out, table = [], table.sort_by("vec_id")
        queries, data = table.filter(table.column("asks")), table.filter(pc.invert(table.column("asks")))
        if not queries.num_rows or not data.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})
        (query, qid), (row, pid) = ([t.column(c).to_numpy() for c in ("key", "vec_id")] for t in (queries, data))
        low = queries.column("low").fill_null(-LONG - 1).to_numpy()
        p = matrix(data.column("v").combine_chunks(), width)
        q = matrix(queries.column("v").combine_chunks(), width)
        for at in range(0, len(qid), 256):
            keys, score = query[at : at + 256], products(q[at : at + 256], p)
            own = keys[:, None] == row[None, :]
            for i in range(len(keys)):
                ok = np.flatnonzero(~own[i] & (score[i] >= low[at + i]))
                s = score[i, ok]
                if len(ok) > k:
                    kept = s >= np.partition(s, len(s) - k)[len(s) - k]
                    ok, s = ok[kept], s[kept]
                best = np.lexsort((pid[ok], -s if s.dtype == float else ~s))[:k]  # pid ascends, so ties keep the smaller id
                s = s[best]
                out.append((np.full(len(s), keys[i]), np.full(len(s), qid[at + i]), pid[ok[best]], s.astype(np.int64)))
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("query", "query_id", "vec_id", "score"), map(pa.array, cols), strict=True)))

    return run


def score_pairs(rows: DataFrame, pairs: DataFrame, k: int, width: int, kth: DataFrame | None = None) -> DataFrame:
    """(query, query_id, vec_id, score): candidates for the k best over pairs (g, leaf, band, chunk) of a query
    group and a data band; query is the key of the query's row; with kth (query, low) only those of at least a query's low score.

    A task's group is one block of a query group's rows and one chunk: some small bands, or one
    block of a large one. So no leaf is gathered whole, and a data row is sent once a group."""
    keys = ["g", "qblock", "chunk", "block"]
    queries = rows.where("is_query").select("g", "qblock", F.lit(True).alias("asks"), "key", "vec_id", "v")
    if kth is None:
        queries = queries.withColumn("low", F.lit(None).cast("long"))
    else:
        queries = queries.join(kth.withColumnRenamed("query", "key"), "key", "left")
    placed = pairs.join(queries.select("g", "qblock").distinct(), "g").select("g", "qblock", "leaf", "band", "chunk")
    data = rows.select("leaf", "band", "block", F.lit(False).alias("asks"), "key", "vec_id", "v", F.lit(None).cast("long").alias("low")).join(placed, ["leaf", "band"])
    groups = data.select(keys).distinct()
    both = data.select(*keys, "asks", "key", "vec_id", "v", "low").unionByName(queries.join(groups, ["g", "qblock"]).select(*keys, "asks", "key", "vec_id", "v", "low"))
    return both.groupBy(*keys).applyInArrow(best_of_blocks(k, width), "query long, query_id long, vec_id long, score long")


def keep_best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def chunks(pairs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A chunk number for each row of pairs (g, ...), sorted by g: neighbours of one g share one up to BLOCK rows."""
    out, number, held, last = np.zeros(len(pairs), np.int32), 0, 0, -1
    for i, g in enumerate(pairs[:, 0]):
        if g != last or held + size[i] > BLOCK:
            number, held, last = number + 1, 0, g
        held += size[i]
        out[i] = number
    return out


def search(vectors: DataFrame, k: int = 20, every: int = 20, sample: int = 16_384, leaves: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all others.
    Rows are told apart by a number that they get when they are stored, as ids may repeat.

    The driver holds the sample, and a few numbers for each band."""
    spark = vectors.sparkSession
    ints = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vec_col)).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    ints = common.stored(ints.withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, width = ints.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bits = max(1, n // sample)
    taken = ints.where(F.pmod(F.xxhash64("key"), F.lit(bits)) == 0).select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow() if n > sample else ints.select("v").toArrow()
    points = np.unique(matrix(taken.column("v").combine_chunks(), width), axis=0) if taken.num_rows else np.zeros((1, width), np.int64)
    tree = CoverTree.over(points, leaves or max(1, min(-(-n // LEAF), len(points) // 8)))

    def place(batches):
        for batch in batches:
            leaf, dist = tree.nearest(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(dist)], names=["vec_id", "v", "key", "leaf", "dist"])

    rows = ints.mapInArrow(place, "vec_id long, v array<long>, key long, leaf int, dist double").withColumn("is_query", F.col("vec_id") % every == 0)
    rows = common.stored(rows, "leaves")
    cuts = F.percentile_approx("dist", F.array(*[F.lit((b + 1) / BANDS) for b in range(BANDS)]), F.lit(1000))
    stats = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("is_query").alias("nq"), F.max(F.when(F.col("is_query"), F.col("dist"))).alias("rq"), cuts.alias("cuts"))
    m = len(tree.points)
    rq, asked, group, work = np.full(m, -1.0), np.zeros(m, int), np.zeros(m, int), []
    edges = {}
    for r in stats.collect():
        asked[r.leaf], rq[r.leaf] = r.nq, -1.0 if r.rq is None else r.rq
        bands = min(BANDS, -(-r.n // BLOCK))
        edges[r.leaf] = sorted({r.cuts[(b + 1) * BANDS // bands - 1] for b in range(bands - 1)})
    tops = tree.tops(WALKS)
    for top in tops:
        for leaf, g in tree.groups(asked, QUERIES, top, group.max(initial=0) + 1).items():
            group[leaf] = g
    total = np.bincount(group, weights=asked).astype(int)
    told = [(leaf, [float(e) for e in es], int(group[leaf]), max(1, -(-int(total[group[leaf]]) // QUERIES))) for leaf, es in edges.items()]
    rows = rows.join(common.sized(spark.createDataFrame(told, "leaf int, edges array<double>, g int, qparts int")), "leaf")
    hashed = F.xxhash64("key")
    rows = rows.withColumns({"band": F.size(F.filter("edges", lambda e: e < F.col("dist"))).cast("int"), "qblock": F.pmod(hashed, F.col("qparts")).cast("int")}).drop("edges", "qparts")
    banded = {(r.leaf, r.band): (r.n, r.rp) for r in rows.groupBy("leaf", "band").agg(F.count("*").alias("n"), F.max("dist").alias("rp")).collect()}
    parts = [(leaf, band, max(1, -(-size // BLOCK))) for (leaf, band), (size, _) in banded.items()]
    rows = rows.join(common.sized(spark.createDataFrame(parts, "leaf int, band int, parts int")), ["leaf", "band"])
    rows = rows.select("key", "vec_id", "v", "leaf", "band", "g", "is_query", F.pmod(hashed, F.col("parts")).cast("int").alias("block"), "qblock")
    rows = common.stored(rows, "bands")
    bands_of: list[list[int]] = [[] for _ in range(m)]
    for leaf, band in sorted(banded):
        bands_of[leaf].append(band)
    count = np.array([sum(banded[i, b][0] for b in bands_of[i]) for i in range(m)])
    rp = np.array([max((banded[i, b][1] for b in bands_of[i]), default=-1.0) for i in range(m)])

    near, first = tree.points @ tree.points.T, set()
    for q in np.flatnonzero(asked):
        held = 0
        for p in np.argsort(-near[q], kind="stable"):
            if count[p]:
                first |= {(int(group[q]), int(p), b) for b in bands_of[p]}
                held += count[p]
                if held > k:
                    break

    def dealt(pairs: np.ndarray) -> pa.RecordBatch:
        chunk = chunks(pairs, np.array([banded[leaf, band][0] for _, leaf, band in pairs.tolist()], int))
        return pa.RecordBatch.from_arrays([*[pa.array(pairs[:, c].astype(np.int32)) for c in range(3)], pa.array(chunk)], names=["g", "leaf", "band", "chunk"])

    begun = pa.Table.from_batches([dealt(np.array(sorted(first), int).reshape(-1, 3))])
    known = common.stored(keep_best(score_pairs(rows, common.sized(spark.createDataFrame(begun)), k, width), k), "first")
    kth = known.groupBy("query").agg(F.max("rank").alias("got"), F.min("score").alias("low")).select("query", F.when(F.col("got") >= k, F.col("low")).alias("low"))
    of = rows.where("is_query").select(F.col("key").alias("query"), "leaf").join(kth, "query", "left")
    bar = np.full(m, np.inf)
    for r in of.groupBy("leaf").agg(F.min(F.coalesce(F.col("low").cast("double"), F.lit(float("-inf")))).alias("bar")).collect():
        bar[r.leaf] = r.bar - 1e-9 * abs(r.bar) if np.isfinite(r.bar) else r.bar
    node_rq, node_rp = tree.radii(rq), tree.radii(rp)

    def walked(batches):
        for batch in batches:
            for top in batch.column(0).to_pylist():
                found = np.array([(q, p, b) for q, p in tree.walk(node_rq, node_rp, bar, top) for b in bands_of[p]], int).reshape(-1, 3)
                reach = np.array([banded[p, b][1] for _, p, b in found.tolist()])
                found = found[tree.bounds(found[:, 0], found[:, 1], rq[found[:, 0]], reach) >= bar[found[:, 0]]] if len(found) else found
                found[:, 0] = group[found[:, 0]]
                pairs = sorted(set(map(tuple, found.tolist())) - first)
                yield dealt(np.array(pairs, int).reshape(-1, 3))

    asked_tops = spark.createDataFrame([(int(t),) for t in tops], "top long").repartition(len(tops), "top")
    rest = common.stored(asked_tops.mapInArrow(walked, "g int, leaf int, band int, chunk int"), "node-pairs")
    scored = known.select("query", "query_id", "vec_id", "score")
    if not rest.isEmpty():
        scored = scored.union(score_pairs(rows, common.sized(rest), k, width, kth))
    return keep_best(scored, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The rows of search(embeddings) in DuckDB.
SEARCH_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.key, q.vec_id AS query_id, p.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND q.key <> p.key
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
