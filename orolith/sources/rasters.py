"""A store of rasters that is read by box and size.

A raster is kept at several levels, each with cells twice as wide as the one before (means of 2 x 2
finite cells). The store is one Parquet table, partitioned by level and sorted by blocks of BLOCK x
BLOCK cells within it, and a table `where` with each raster's and level's origin and cell size. A read
picks the level that a box needs for the wanted number of cells, and turns the box into ranges of
blocks: a filter on the level's folder and on sorted columns, so that Spark opens the files and row
groups of these blocks alone. A raster is named by `source`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orolith.operators import raster
from orolith.storage import sized

#: Cells on a block's side, and boxes that a read asks for one by one.
BLOCK, RANGES = 256, 200


def save_rasters(cells: DataFrame, where: DataFrame, path: str, bands: list[str], levels: int = 6) -> None:
    """Write rasters (source, i, j, bands), laid out by where (source, west, north, dx, dy), to a new store.

    Rows are counted from the north and columns from the west, as in all rasters here."""
    at = ["source", "i", "j"]
    level = cells.select(*at, *[raster.finite(F.col(b).cast("double")).alias(b) for b in bands])
    for k in range(levels):
        if k:
            level = raster_level(spark_table(cells.sparkSession, path, k - 1), bands)
        blocks = level.withColumns({"bi": F.floor(F.col("i") / BLOCK).cast("int"), "bj": F.floor(F.col("j") / BLOCK).cast("int")})
        order = ["source", "bi", "bj", "i", "j"]
        blocks.repartitionByRange("source", "bi", "bj").sortWithinPartitions(*order).write.mode("append").parquet(f"{path}/cells/level={k}")
    scale = F.pow(F.lit(2.0), F.col("level"))
    laid = where.select("source", "west", "north", "dx", "dy", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    laid.select("source", "level", "west", "north", (F.col("dx") * scale).alias("dx"), (F.col("dy") * scale).alias("dy")).write.parquet(f"{path}/where")


def spark_table(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.parquet(f"{path}/cells/level={level}")


def raster_level(finer: DataFrame, bands: list[str]) -> DataFrame:
    half = {c: F.floor(F.col(c) / 2).cast("int") for c in "ij"}
    return finer.groupBy("source", half["i"].alias("i"), half["j"].alias("j")).agg(*[F.avg(b).alias(b) for b in bands])


def read_rasters(spark: SparkSession, path: str, boxes: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, where) over boxes (job_id, source, west, south, east, north) in the rasters' own coordinates.

    cells has job_id, i, j and the bands, of all blocks that a box touches with a cell to spare; where has
    job_id, level, west, north, dx, dy of what was read. With `most`, a box is read at the coarsest level that still
    gives its longer side that many cells."""
    where = spark.read.parquet(f"{path}/where")
    met = boxes.join(sized(where.withColumnsRenamed({"west": "w0", "north": "n0"})), "source")
    longest = F.greatest((F.col("east") - F.col("west")) / F.col("dx"), (F.col("north") - F.col("south")) / F.col("dy"))
    enough = F.lit(False) if most is None else longest >= most
    level = met.groupBy("job_id").agg(F.coalesce(F.max(F.when(enough, F.col("level"))), F.min("level")).alias("level"))
    need = met.join(level, ["job_id", "level"])
    edge = {"i0": (F.col("n0") - F.col("north")) / F.col("dy") - 1, "i1": (F.col("n0") - F.col("south")) / F.col("dy") + 1, "j0": (F.col("west") - F.col("w0")) / F.col("dx") - 1, "j1": (F.col("east") - F.col("w0")) / F.col("dx") + 1}
    need = need.select("job_id", "source", "level", "w0", "n0", "dx", "dy", *[F.floor(c / BLOCK).cast("int").alias(n) for n, c in edge.items()])
    # what the scan is asked for: each box's own blocks, or of very many boxes those of their source and level
    spans = need.select("source", "level", "i0", "i1", "j0", "j1").distinct().limit(RANGES + 1).collect()
    if len(spans) > RANGES:
        spans = need.groupBy("source", "level").agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.min("j0").alias("j0"), F.max("j1").alias("j1")).collect()
    cells = spark.read.parquet(f"{path}/cells")
    ranges = [(F.col("source") == r.source) & (F.col("level") == r.level) & F.col("bi").between(r.i0, r.i1) & F.col("bj").between(r.j0, r.j1) for r in spans]
    cells = cells.where(reduce(lambda x, y: x | y, ranges, F.lit(False)))
    wanted = need.select("job_id", "source", "level", "i0", "i1", "j0", "j1")
    inside = (cells["source"] == wanted["source"]) & (cells["level"] == wanted["level"]) & F.col("bi").between(F.col("i0"), F.col("i1")) & F.col("bj").between(F.col("j0"), F.col("j1"))
    bands = [c for c in cells.columns if c not in ("source", "level", "i", "j", "bi", "bj")]
    found = cells.join(sized(wanted), inside).select("job_id", "i", "j", *bands)
    return found, need.select("job_id", "level", F.col("w0").alias("west"), F.col("n0").alias("north"), "dx", "dy")
