"""A pipeline over documents: each stage keeps or rewrites rows for the next one.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last one adds
`copy` and `shuffle_key`. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orolith.llm import common, decontaminate, language_id, line_dedup, mixing, near_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scores begin at 0.25, where neither the family nor the language is told from the next one; a
#: prediction this close to it is a mere guess.
LEAST_SCORE = 0.28
#: The languages that the corpus is made of; documents told to be in another one go.
LANGUAGES = ("de", "en", "es", "fr")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES stay as they are; those in another one, without one (`und`), or
    with a mere guess of one go."""
    model = language_id.learn(language_id.learned_from(docs))
    told = language_id.predict(docs, model).where(F.col("lang_pred").isin(*LANGUAGES) & (F.col("score") >= LEAST_SCORE))
    return told.select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines found in at least 10 different texts; copies of one text are left to the next
    stage, and every row stays."""
    kept = line_dedup.dedup_lines(docs, min_docs=10, by_text=True)
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id. Near copies share
    five-word shingles to a Jaccard similarity of 0.8 or more."""
    return near_copies.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to shares that follow the square root of their sizes."""
    return mixing.replicate(docs, alpha=0.5, seed=17)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix),
]

#: Near-copy components and language models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents. What each returns is stored before the next reads it, and
    what it stored on its way is removed, as is what its predecessor returned."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = common.table_path(spark, f"stage-{name}")
        with common.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        common.removed(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
