"""Rasters, meshes and job logs laid over the tables of a scale-factor folder.

i and j are row and column of a cell. Every view has job_id, the key by which work is dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, i, j, z): a dense raster, one embedding a row."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("i"), F.posexplode("embedding").alias("j", "z"))
    return cells.select(F.lit("emb").alias("job_id"), "i", "j", F.col("z").cast("double").alias("z"))


def ev_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, i, j, z): summed event values by user and hour, with missing cells."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    cells = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("int").alias("i"), F.hour("ts").alias("j")).agg(cents.alias("cents"))
    return cells.select(F.lit("ev").alias("job_id"), "i", "j", (F.col("cents") / F.lit(100.0)).alias("z"))


def li_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, r, g, b): a bag of pixels from the line items."""
    channel = lambda c, k: F.round(F.col(c) * k).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.lit("px").alias("job_id"), channel("l_quantity", 5).alias("r"), channel("l_discount", 2550).alias("g"), channel("l_tax", 3187).alias("b"))


def px_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, i, j, r, g, b, z): an image with elevation, from line items by part and supplier."""
    mean = lambda c, k: F.expr(f"sum(cast(round({c} * {k}) AS bigint)) div count(*)").cast("int")
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 100).cast("int").alias("i"), F.col("l_suppkey").cast("int").alias("j"))
    cells = cells.agg(mean("l_quantity", 5).alias("r"), mean("l_discount", 2550).alias("g"), mean("l_tax", 3187).alias("b"))
    height = (F.col("i") % 20 + F.col("j") % 15 + F.col("b") % 7).cast("double")
    return cells.select(F.lit("px").alias("job_id"), "i", "j", "r", "g", "b", height.alias("z"))


#: Corners of the fixed boundary over px_grid, as (x, y) = (column, row).
BOUNDARY = [(10.2, 8.3), (88.7, 5.1), (95.4, 60.6), (60.9, 91.8), (12.5, 80.2)]


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, status, percent, updated_at): events as progress snapshots of jobs."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "purchase", "done").when(kind == "error", "error").when(kind == "click", "running").otherwise("busy")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("updated_at")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), status.alias("status"), (F.col("event_id") % 130 - 10).cast("int").alias("percent"), at, "event_id")


#: The same views as DuckDB CTEs.
SQL = {
    "emb": """emb AS (SELECT CAST(vec_id AS INT) AS i, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS j,
        CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings)""",
    "ev": """ev AS (SELECT CAST(user_id AS INT) AS i, CAST(hour(ts) AS INT) AS j,
        sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS z FROM events GROUP BY 1, 2)""",
    "li": """li AS (SELECT CAST(round(l_quantity * 5) AS INT) AS r, CAST(round(l_discount * 2550) AS INT) AS g,
        CAST(round(l_tax * 3187) AS INT) AS b FROM lineitem)""",
    "px": """px AS (SELECT i, j, r, g, b, CAST(i % 20 + j % 15 + b % 7 AS DOUBLE) AS z FROM (
        SELECT CAST(l_partkey % 100 AS INT) AS i, CAST(l_suppkey AS INT) AS j,
        CAST(sum(CAST(round(l_quantity * 5) AS BIGINT)) // count(*) AS INT) AS r,
        CAST(sum(CAST(round(l_discount * 2550) AS BIGINT)) // count(*) AS INT) AS g,
        CAST(sum(CAST(round(l_tax * 3187) AS BIGINT)) // count(*) AS INT) AS b FROM lineitem GROUP BY 1, 2))""",
    "jobs": """jobs AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'signup' THEN 'queued'
        WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' ELSE 'busy' END AS status,
        CAST(event_id % 130 - 10 AS INT) AS percent, epoch_us(ts) / 1e6 AS updated_at, event_id FROM events)""",
}


def sql(names: str, rest: str) -> str:
    """DuckDB SQL with views named in front; rest is a SELECT, or further CTEs after a comma."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + rest
