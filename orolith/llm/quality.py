"""Quality by importance resampling (operator 2).

Two generative models of hashed n-grams, one of target text and one of all raw text, give each
document a weight: the ratio of its likelihoods under them. Documents are drawn without replacement
in proportion to the weights by the Gumbel trick: add hash-seeded Gumbel noise to the logarithm of
the weight and keep the k largest sums.

N-grams are words and word pairs, A-Z lower-cased, hashed to `buckets`; the models are the smoothed
frequencies of the buckets over all documents, each counted whole. The logarithm of the ratio is
the sum over a document's n-grams: that of the likelihoods' ratio. With `per_gram` it is their mean times
that number instead, so that a long text is not weighted by its length; off by default. Only bucket counts and exact selection bounds reach the driver.

Defined results: null, empty and blank texts have log_ratio 0; all rows whose sum equals the last
one drawn are drawn too, so repeated rows, which draw the same noise, stand or fall together; a
null id hashes like the empty text; no target rows: the target model is the raw one and all ratios are 0;
an empty table gives an empty result; a fraction of 1 keeps all rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orolith.llm import common

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def gram_buckets(text: bytes, buckets: int) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours."""
    data = np.frombuffer(text, np.uint8)
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(start):
        return np.zeros(0, np.int64)
    # a word's hash: the sum of mixed (byte, place) values, from differences of running sums
    length = end - start
    owner = np.maximum(np.cumsum(inside[1:-1] & ~inside[:-2]) - 1, 0)
    place = np.arange(len(data)) - start[owner]
    mixed = (data.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    word = sums[end] - sums[start] + length.astype(np.uint64)
    word ^= word >> np.uint64(32)
    pair = (word[:-1] * np.uint64(0x94D049BB133111EB)) ^ word[1:]
    grams = np.concatenate([word, pair]) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((grams >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """(2, buckets): n-grams of all rows and of the rows where `target` holds."""

    def run(batches):
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(gram_buckets(text or b"", buckets), minlength=buckets)
                counts[0] += n
                if target:
                    counts[1] += n
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "n", "m"])

    out = np.zeros((2, buckets))
    sums = docs.select("text", "target").mapInArrow(run, "bucket long, n long, m long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    for r in sums.collect():
        out[:, r.bucket] = r.n, r.m
    return out


def log_ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    raw, target = counts
    if not target.sum():
        return np.zeros(len(raw))
    prior = (raw + smoothing) / (raw + smoothing).sum()
    p = (target + smoothing * len(raw) * prior) / (target.sum() + smoothing * len(raw))
    return np.log(p / prior)


def resample(docs: DataFrame, target_ids: DataFrame, k: int | None = None, fraction: float = 0.5, buckets: int = 10_000, per_gram: float | None = None, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_ratio, gumbel_key) of the rows drawn: k of them, or the fraction of all.

    target_ids holds the ids (doc_id) of target documents."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = common.sized(target_ids.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True)))
    counts = bucket_counts(docs.join(known, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")), buckets)
    ratios = log_ratios(counts)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                at = gram_buckets(text or b"", buckets)
                out.append(float(ratios[at].sum()) * (1.0 if per_gram is None else per_gram / max(1, len(at))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "log_ratio"])

    scored = docs.mapInArrow(run, "doc_id long, log_ratio double")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    scored = common.stored(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(u))), "scored")
    n = scored.count()
    k = min(n, round(fraction * n)) if k is None else min(n, k)
    bar = common.kth_largest(scored, "gumbel_key", k)
    if bar is None:
        return scored.limit(0)
    return scored.where(F.col("gumbel_key") >= bar)


def from_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Draws towards documents labelled of quality and not toxic, as many of all as their share
    among the labelled ones."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    n, m = labels.agg(F.count("*"), F.count_if(good)).first()
    return resample(docs, labels.where(good).select("doc_id"), fraction=m / n if n else 1.0)
