"""Mixing sources to target weights by Poisson replication (operator 10).

A source's rate is the wanted number of its rows over the number it has. Each document is given a
number of copies from a Poisson distribution with that mean, by inverting the distribution at a
uniform value hashed from seed and id: the same everywhere and on every run. Documents are exploded
by their copies and all copies are shuffled: dealt to partitions and ordered there by a hash.

Without given weights a source's share follows its row count to the power `alpha` (1: as it is, 0:
all alike). A rate above 256 is a sum of equal parts of at most 256, each inverted by itself, so
that no probability underflows.

Defined results: a null source is the source ''; a null id hashes like the empty text; repeated
rows get the same number of copies each; a source absent from given weights has weight 0; an empty
table gives an empty result; other columns stay, but those named copy or shuffle_key are replaced; null and empty texts are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orolith.llm import common

LARGEST_PART = 256


def uniform(*parts: Column) -> Column:
    """A value in [0, 1) from the MD5 of the parts, 52 bits of it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, total: int | None = None, alpha: float = 0.5, weights: dict[str, float] | None = None, source_col: str = "source") -> DataFrame:
    """(src, n, rate): rate is the expected number of copies of each document of the source."""
    n = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        share = F.coalesce(*[F.when(F.col("src") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))
    n = common.stored(n.withColumn("share", share), "sources")
    rows, shares = n.agg(F.sum("n"), F.sum("share")).first()
    wanted = F.lit(float(total if total is not None else rows or 0))
    return n.select("src", "n", F.round(wanted * F.col("share") / F.lit(shares or 1.0) / F.col("n"), 9).alias("rate"))


def distribution(rate: Column) -> tuple[Column, Column]:
    """Into how many equal parts the rate is cut, and the distribution function of one part."""
    parts = F.greatest(F.lit(1), F.ceil(rate / F.lit(float(LARGEST_PART))).cast("int"))
    part = rate / parts
    last = F.ceil(part + F.lit(12.0) * F.sqrt(part) + F.lit(20.0)).cast("int")
    first = F.exp(-part)
    zero = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("cdf"))
    step = lambda s, k: F.struct((s.p * part / k).alias("p"), (s["sum"] + s.p * part / k).alias("sum"), F.concat(s.cdf, F.array(s["sum"] + s.p * part / k)).alias("cdf"))
    return parts, F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s.cdf)


def copies(us: Column, cdf: Column) -> Column:
    """The number of copies: for each part's uniform value, how many of the distribution's are passed."""
    return F.aggregate(us, F.lit(0), lambda s, u: s + F.size(F.filter(cdf, lambda c: c <= u)))


def replicate(docs: DataFrame, total: int | None = None, alpha: float = 0.5, weights: dict[str, float] | None = None, seed: int = 17, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs, each row as often as drawn, with copy (from 1) and shuffle_key; shuffled globally."""
    parts, cdf = distribution(F.col("rate"))
    rate = rates(docs, total, alpha, weights, source_col).select(F.col("src").alias("__src"), parts.alias("__parts"), cdf.alias("__cdf"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    us = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda j: uniform(F.lit(str(seed)), key, j.cast("string")))
    drawn = docs.withColumn("__src", F.coalesce(F.col(source_col), F.lit(""))).join(common.sized(rate), "__src").withColumn("__n", copies(us, F.col("__cdf"))).where("__n > 0")
    kept = common.others(docs, "copy", "shuffle_key")
    out = drawn.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))).alias("copy"))
    text = F.concat_ws(":", F.lit(f"{seed}-shuffle"), key, F.col("copy").cast("string"))
    return out.withColumn("shuffle_key", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: The rows of replicate(documents, alpha=0.5, seed=17) in DuckDB.
REPLICATE_SQL = """
WITH n AS (
  SELECT coalesce(source, '') AS src, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS share
  FROM documents GROUP BY 1
), rate AS (
  SELECT src, round((SELECT sum(n) FROM n) * share / (SELECT sum(share) FROM n) / n, 9) AS rate FROM n
), part AS (
  SELECT src, greatest(1, CAST(ceil(rate / 256) AS INT)) AS parts,
         rate / greatest(1, CAST(ceil(rate / 256) AS INT)) AS part FROM rate
), pmf AS (
  SELECT src, k, exp(-part + k * ln(part) - lgamma(k + 1)) AS p
  FROM part, unnest(generate_series(0, CAST(ceil(part + 12 * sqrt(part) + 20) AS INT))) AS g(k)
), cdf AS (
  SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM pmf
), u AS (
  SELECT doc_id, coalesce(source, '') AS src,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents JOIN part ON coalesce(source, '') = src, unnest(generate_series(0, parts - 1)) AS g(j)
), drawn AS (
  SELECT doc_id, src, count(*) FILTER (WHERE c <= u) AS copies FROM u JOIN cdf USING (src) GROUP BY doc_id, src
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy,
       CAST('0x' || substr(md5('17-shuffle:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM documents d JOIN drawn w ON d.doc_id = w.doc_id, unnest(generate_series(1, copies)) AS g(copy)
"""
