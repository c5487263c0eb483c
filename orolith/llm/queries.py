"""Registered queries of this package: one per operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orolith.llm import chat_format, decontaminate, divergence, exact_topk, language_id, line_dedup, mixing, periodic_runs, personal_data, quality, secret_scan, simhash, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.from_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_table(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_chat(table(spark, sf_dir, "conversations")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"), alpha=0.5, seed=17)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.scan_table(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_resampling": op2_quality_resampling,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_topk": op5_exact_topk,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_language_id": op8_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_personal_data": op11_personal_data,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}

#: DuckDB SQL for those that SQL can express.
SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.DIGEST_SQL,
    "op5_exact_topk": exact_topk.SEARCH_SQL,
    "op10_source_mixing": mixing.REPLICATE_SQL,
    "op12_source_divergence": divergence.AUDIT_SQL,
    "op13_periodic_runs": periodic_runs.RUNS_SQL,
}
