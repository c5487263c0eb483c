"""Near copies by word shingles: texts of a Jaccard similarity of 0.8 or more (operator 9 as a pipeline stage).

A text is the set of its hashed five-word shingles (fewer words: one shingle of all; none: one of
nothing), its ASCII letters lower-cased. First the covering tables of `simhash` find all pairs of texts whose
64-bit fingerprints of these sets differ in at most RADIUS bits, which are the close copies. A pair of
similarity 0.8 differs in about ten bits, and covering tables for that radius would be too many and too
coarse. So further candidates share one of `TABLES` buckets of `ROWS` min-hashes each; a pair of similarity
0.8 is in none with a chance of (1 - 0.8^5)^32, 3 in a million. Whether a candidate is a link is
decided by the exact similarity of both sets. Of a bucket each text is first held against the least. In
buckets that these links leave in several components the texts outside the largest one are then held
against all others, in tasks of a part of the bucket each, which give only links between components. No
bucket is capped; in one of n texts of which m are outside the largest component, m n sets are compared.

Defined results: texts of equal 128-bit hashes are one node, which gets a number of its own; of each
component one row stays, that of the least id (nulls last), then of the least hash; columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orolith.llm import common, simhash

WORDS, RADIUS, TABLES, ROWS = 5, 4, 32, 5
SHINGLE_CHUNK = 1 << 13
#: Rows of a batch that are worked on at a time.
SLICE = 512
#: Texts and shingles in a part of a bucket.
PART, PART_SHINGLES = 512, 1 << 21
_rng = np.random.default_rng(11)
MULTIPLY = _rng.integers(0, 1 << 63, TABLES * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, TABLES * ROWS, np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes of a whole text."""
    digest, seen = xxhash.xxh64_intdigest, {}
    tokens = (text or b"").lower().split()
    for t in set(tokens):
        seen[t] = digest(t)
    h = np.array([seen[t] for t in tokens], np.uint64)
    if len(h) < WORDS:
        return np.array([digest(b" ".join(tokens), 1)], np.uint64)
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def buckets(s: np.ndarray) -> np.ndarray:
    """A value for each table: the hash of its min-hashes."""
    least = np.full(TABLES * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), SHINGLE_CHUNK):
        mixed = s[at : at + SHINGLE_CHUNK, None] * MULTIPLY + ADD
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, mixed.min(0))
    value = np.arange(TABLES, dtype=np.uint64)
    for k in range(ROWS):
        value = (value ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
    return value.view(np.int64)


def fingerprint(s: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes, mixed once more."""
    mixed = s * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), SHINGLE_CHUNK):
        ones += np.unpackbits(mixed[at : at + SHINGLE_CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(s)).tobytes(), "big", signed=True)


#: Columns that name a row: both halves of its text's hash, its id, and whether that is null.
ROW = ["hi", "lo", "id", "none"]


def row_names(text: Column, doc_id: Column) -> dict[str, Column]:
    """The columns of ROW; the hashes' seeds differ, so the halves are independent."""
    text = F.coalesce(text, F.lit(""))
    return dict(zip(ROW, (F.xxhash64(text), F.xxhash64(F.lit(1), text), F.coalesce(doc_id, F.lit(0)), doc_id.isNull()), strict=True))


def signatures(rows: DataFrame) -> DataFrame:
    """(hi, lo, id, none, size, fp, buckets) of (hi, lo, id, none, text)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch, size, fp, values = whole.slice(at, SLICE), [], [], []
                for t in batch.column(4).cast(pa.binary()):
                    s = shingles(t.as_py())
                    size.append(len(s))
                    fp.append(fingerprint(s))
                    values.append(buckets(s))
                cols = [pa.array(size, pa.int32()), pa.array(fp, pa.int64()), pa.array(values, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], names=[*ROW, "size", "fp", "buckets"])

    return rows.select(*ROW, "text").mapInArrow(run, "hi long, lo long, id long, none boolean, size int, fp long, buckets array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sets = pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(1).cast(pa.binary())], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more. A text in many pairs is sent out in 32 parts."""
    part = F.pmod(F.xxhash64("a"), F.lit(32))
    pairs = pairs.withColumn("part", part)
    seconds = pairs.select("b", "part").distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    firsts = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = F.size(F.array_intersect("s", "t"))
    return firsts.join(seconds, ["b", "part"]).where(9 * both >= 4 * (F.size("s") + F.size("t"))).select("a", "b")


def close_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that join all whose fingerprints link: texts of one fingerprint with the least
    of them, and the least ones of linked fingerprints."""
    heads = common.stored(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "near-heads")
    same = nodes.join(heads.where("n > 1"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    met = simhash.hamming_links(heads.select("fp"), RADIUS)
    for c in "ab":
        met = met.join(heads.select(F.col("fp").alias(c), F.col("head").alias(f"n{c}")), c).drop(c)
    return same.union(met.select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b"))).distinct()


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join all near copies, directly or through others.

    nodes: (node, hi, lo, id, none, size, fp, buckets), one row a text; texts: (hi, lo, id, none, text),
    with at least one row for each node."""
    dealt = nodes.select("node", "size", F.explode("buckets").alias("bucket"))
    least = dealt.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("top"), F.min_by("size", "node").alias("b_size")).where("b < top").drop("top")
    shared = common.stored(dealt.join(least, "bucket"), "near-buckets")
    alike = "9 * least(size, b_size) >= 4 * (size + b_size)"
    stars = shared.where(f"node <> b AND {alike}").select(F.col("node").alias("a"), "b")
    stars = common.stored(stars.union(common.stored(close_pairs(nodes), "near-close")).distinct(), "near-stars")
    wanted = shared.select("node").union(stars.select("a")).union(stars.select("b")).distinct().join(nodes.select("node", *ROW), "node")
    sets = common.stored(shingle_sets(texts.join(common.sized(wanted), ROW).dropDuplicates(["node"]).select("node", "text")), "near-sets")
    found = common.stored(verified(stars, sets), "near-links")

    roots = common.components(found)
    placed = common.stored(shared.join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root")), "near-placed")
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = groups.groupBy("bucket").agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("n"), F.sum("size").alias("all"), F.count("*").alias("k")).where("k > 1 AND n > 2")
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("all") / PART_SHINGLES))
    mixed = common.stored(mixed.select("bucket", "main", parts.cast("int").alias("parts")), "near-mixed")
    if mixed.isEmpty():
        return found
    rest = placed.join(common.sized(mixed), "bucket")
    told = rest.select("bucket", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "node", "root")
    asks = rest.where("root <> main").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "node", "root")
    sent = told.union(asks).join(sets, "node").select("bucket", "part", "asks", "node", "root", "shingles")
    sent = sent.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "asks", "node")
    return found.union(common.stored(sent.mapInArrow(joined_parts, "a long, b long").distinct(), "near-links"))


def index_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles in order, whose set each is of, and the sets' sizes."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes


def similar(s: np.ndarray, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the sets of an index that are of similarity 0.8 or more to s."""
    lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
    n = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    both = np.bincount(owner[at], minlength=len(sizes))
    return np.flatnonzero(9 * both >= 4 * (len(s) + sizes))


def joined_parts(batches):
    """Rows (bucket, part, asks, node, root, shingles), a part's own texts before those that ask: links
    (a, b) of a text that asks and one of the part, where these join two components for the first time.

    A task holds one part of a bucket; the texts that ask stream by."""
    key, nodes, roots, sets, index, up = None, [], [], [], None, {}

    def top(r):
        while up.get(r, r) != r:
            r = up[r]
        return r

    for batch in batches:
        bucket, part, asks, node, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        ends, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
        found_a, found_b = [], []
        for i in range(batch.num_rows):
            s = flat[ends[i] : ends[i + 1]]
            if key != (bucket[i], part[i]):
                key, nodes, roots, sets, index, up = (bucket[i], part[i]), [], [], [], None, {}
            if not asks[i]:
                nodes.append(node[i])
                roots.append(root[i])
                sets.append(s.copy())
                continue
            index = index or (index_of(sets) if sets else None)
            for k in similar(s, *index) if index else ():
                x, y = top(root[i]), top(roots[k])
                if x != y:
                    up[x] = y
                    found_a.append(node[i])
                    found_b.append(nodes[k])
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies; columns stay."""
    names = row_names(F.col("text").cast("string"), F.col("doc_id").cast("long"))
    rows = docs.select(*[c.alias(n) for n, c in names.items()], F.col("text").cast("string").alias("text"))
    signed = common.stored(signatures(rows), "near-signatures")
    # Equal texts have equal buckets: one row of each is taken, after the least id is known.
    lows = signed.groupBy("hi", "lo").agg(F.min(F.struct("none", "id")).alias("w")).select("hi", "lo", "w.id", "w.none")
    one = signed.join(lows, ROW).dropDuplicates(ROW)
    # Numbered when the table is written, so the numbers stay as they are.
    nodes = common.stored(one.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    roots = common.components(links(nodes, rows))
    placed = nodes.select("node", *ROW).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.min(F.struct("none", "id", "hi", "lo")).alias("w")).select(*[F.col(f"w.{c}").alias(f"__{c}") for c in ROW])
    keyed = docs.withColumns({f"__{n}": c for n, c in names.items()})
    mine = [f"__{c}" for c in ROW]
    return keyed.dropDuplicates(mine).join(kept, mine, "left_semi").select(docs.columns)
