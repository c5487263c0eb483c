"""SimHash near-dedup with covering locality-sensitive hashing (operator 9).

A fingerprint of 64 bits sums up the shingles of a text. Two fingerprints link at `radius` or
fewer differing bits. Each bit position gets a random code of radius + 1 bits; for each non-zero
vector v of radius + 1 bits, one mask keeps the positions whose code has an odd product with v.
The codes of `radius` differing positions cannot span all vectors, so some v has an even product
with each of them and its mask leaves them all out: every pair within the radius shares a masked
value in one of the 2^(radius+1) - 1 tables. Pairs that share a value are then compared bit by bit, so links are exact.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; equal
fingerprints are one node, so copies are never paired; repeated rows come back as often as given;
null ids take part in linking but never name a component (a component of null ids alone has id
null); an empty table gives an empty result; columns besides the id and text are not read.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orolith.llm import common

SHINGLE_CHUNK = 1 << 16


def text_fingerprint(text: bytes | None, words: int, seed: int = 42) -> int:
    """The fingerprint of one whole text: bit i is 1 if set in over half of the shingle hashes."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined, ends = b" ".join(tokens), np.cumsum([len(t) + 1 for t in tokens])
    last = ends[min(words, len(tokens)) - 1 :] - 1
    first = np.concatenate([[0], ends[: len(last) - 1]])
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), SHINGLE_CHUNK):
        spans = zip(first[at : at + SHINGLE_CHUNK].tolist(), last[at : at + SHINGLE_CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[i:j], seed) for i, j in spans], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for each row."""

    def run(batches):
        for batch in batches:
            fps = [text_fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, seed: int) -> list[int]:
    """2^(radius+1) - 1 signed masks of 64 bits; see the module's text."""
    rng = random.Random(seed)
    codes = [rng.randrange(1 << (radius + 1)) for _ in range(64)]
    masks = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bucket_links(radius: int, most: int):
    """Arrow function over rows (bucket, fp) sorted by both: (kind, x, y) is a link of two
    fingerprints (kind 0), or a row of a bucket with more than `most` members (kind 1)."""

    def forest(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
        left, xs, ys = np.ones(len(f), bool), [], []
        for i in range(len(f)):
            if left[i]:
                left[i], front = False, np.array([i])
                while len(front):
                    front = np.flatnonzero(near[front].any(0) & left)
                    left[front] = False
                    xs.append(np.full(len(front), f[i]))
                    ys.append(f[front])
        return np.concatenate(xs or [f[:0]]), np.concatenate(ys or [f[:0]])

    def links(bucket: np.ndarray, fp: np.ndarray):
        """Of whole buckets."""
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.concatenate([start, [len(bucket)]]))
        for s, n in zip(start[(size > 8) & (size <= most)], size[(size > 8) & (size <= most)], strict=True):
            yield 0, *forest(fp[s : s + n])
        hot = np.repeat(size > most, size)
        if hot.any():
            yield 1, bucket[hot], fp[hot]
        few = np.repeat(size <= 8, size)
        b, f = bucket[few], fp[few]
        for lag in range(1, 8):
            same = (b[lag:] == b[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= radius)
            if len(b) > lag and same.any():
                yield 0, f[:-lag][same], f[lag:][same]

    def table(kind: int, x: np.ndarray, y: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["kind", "x", "y"])

    def run(batches):
        b, f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            b = np.concatenate([b, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            f = np.concatenate([f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(b):
                continue
            whole = int(np.searchsorted(b != b[-1], False)) if b[0] == b[-1] else int(np.flatnonzero(b != b[-1])[-1]) + 1
            yield from (table(*x) for x in links(b[:whole], f[:whole]) if whole)
            b, f = b[whole:], f[whole:]
            if len(b) > most + 1:  # the bucket is too large whatever follows; keep enough to know it by
                yield table(1, b[: -most - 1], f[: -most - 1])
                b, f = b[-most - 1 :], f[-most - 1 :]
        if len(b):
            yield from (table(*x) for x in links(b, f))

    return run


def distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def pivots(hot: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Links of the members of large buckets to a pivot, and the buckets that these leave open.

    hot: (bucket, fp). A bucket's pivot is the member nearest to the majority of its bits, so of a
    crowd of copies with few changes it is the middle. Members within the radius of it are linked to it and
    take its name; a bucket whose members all have one name is settled, and (bucket, fp) of the others
    comes back. All of it are grouped sums and minima over the members."""
    ones = [F.sum(F.getbit("fp", F.lit(k)).cast("long")).alias(f"b{k}") for k in range(64)]
    counts = hot.groupBy("bucket").agg(F.count("*").alias("n"), *ones)
    middle = reduce(lambda x, y: x.bitwiseOR(y), [F.when(2 * F.col(f"b{k}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k in range(64)])
    middles = common.sized(common.stored(counts.select("bucket", middle.alias("middle")), "middles"))
    near = hot.join(middles, "bucket").groupBy("bucket").agg(F.min_by("fp", F.struct(distance("fp", "middle").alias("d"), F.col("fp"))).alias("pivot"))
    named = hot.join(common.sized(common.stored(near, "pivots")), "bucket")
    inside = distance("fp", "pivot") <= radius
    found = named.where(inside & (F.col("fp") != F.col("pivot"))).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    name = F.when(inside, F.col("pivot")).otherwise(F.col("fp"))
    open_ = named.groupBy("bucket").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo < hi").select("bucket")
    return found, hot.join(common.sized(common.stored(open_, "open-buckets")), "bucket", "left_semi")


def hamming_links(nodes: DataFrame, radius: int = 4, most: int = 512, seed: int = 1) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join exactly those within `radius`,
    directly or through others of the same component.

    Buckets of at most `most` members are compared within a task. Members of a larger one are first
    linked to its pivot; only if that leaves some apart, the bucket is dealt again under further masks:
    two members within the radius still share some masked value there, and with more and more bits
    held equal a bucket of distinct fingerprints must shrink. Nothing is dropped. Members that differ
    in no more than `radius` positions taken together always share some table, so `most` is raised
    to four times their number.
    """
    most = max(most, 4 << radius)
    rows = nodes.select(F.lit(0).cast("long").alias("bucket"), "fp")
    found = []
    while rows is not None:
        masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius, seed)])
        dealt = rows.select("bucket", "fp", F.posexplode(masks).alias("t", "mask")).select(F.xxhash64("bucket", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")
        dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
        out = common.stored(dealt.mapInArrow(bucket_links(radius, most), "kind int, x long, y long"), "links")
        found.append(out.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
        hot, seed, rows = out.where("kind = 1").select(F.col("x").alias("bucket"), F.col("y").alias("fp")), seed + 1, None
        if not hot.isEmpty():
            stars, open_ = pivots(hot, radius)
            found.append(common.stored(stars.distinct(), "stars"))
            open_ = common.stored(open_, "open")
            rows = None if open_.isEmpty() else open_
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links."""
    fps = common.stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = common.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    stars = common.components(hamming_links(nodes, radius))
    placed = nodes.join(stars, nodes.fp == stars.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component of docs; columns stay. It is that of the least id (nulls last), and of
    several with that id the one whose text has the least hash, so rows that share an id but not a
    component all stand for themselves."""
    text = F.col("text").cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    fps = common.stored(fingerprints(docs.select(key.alias("key"), "text"), words, "key", "text").distinct(), "fingerprints")
    stars = common.components(hamming_links(fps.select("fp").distinct(), radius))
    placed = fps.join(stars, fps.fp == stars.node, "left").select(F.col("doc_id").alias("__key"), F.coalesce("root", "fp").alias("__root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__key").alias("key")))
    rows = docs.select("doc_id", key.alias("__key")).join(placed, "__key").groupBy("__root").agg(first.alias("w"))
    kept = rows.select(F.col("w.key").alias("__key"), F.col("w.id").alias("__id"))
    keyed = docs.withColumns({"__key": key, "__id": F.col("doc_id")}).dropDuplicates(["__key", "__id"])
    return keyed.join(kept.withColumnsRenamed({"__key": "__k", "__id": "__i"}), (F.col("__key") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i")), "left_semi").select(docs.columns)


def digest(df: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
