"""Tables in the folder that all executors share, where long plans are cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only in local mode, where that setting may be absent, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="orolith-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing will read again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Tables made since each scratch() that is open began.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` makes in this block are removed at its end; nothing may read them later."""
    _open.append([])
    try:
        yield
    finally:
        removed(spark, *_open.pop())


#: Rows of a stored file at most, so that what one task wrote is read by several.
FILE_ROWS = 1 << 17


def stored(df: DataFrame, name: str, path: str | None = None, rows: int = FILE_ROWS) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there,
    and a lost executor costs no more than the tasks that were running on it."""
    path = path or table_path(df.sparkSession, name)
    if _open:
        _open[-1].append(path)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Sides with at most so many rows and so many bytes, counted first, may be broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows, which written as JSON have at most `size` bytes; reads no
    more than one row beyond that."""
    measured = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(measured.cast("long"))).first()
    return n <= rows and (total or 0) <= size


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows it; else as it is, and Spark shuffles."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df
