"""Jobs as tables: progress snapshots (job_id, status, percent, updated_at, ...) and their lifecycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orolith.storage import sized

#: How a progress file is read.
PROGRESS = "status string, step string, message string, percent int, error string, started_at double, updated_at double"


@dataclass(frozen=True)
class Lifecycle:
    """Seconds: of a job's running time, of keeping finished ones, until a silent one counts as
    stale, and between sweeps."""

    max_runtime: float = 3600.0
    ttl: float = 86_400.0
    stale: float = 7200.0
    sweep: float = 900.0

    @staticmethod
    def of(spark: SparkSession) -> Lifecycle:
        """From the session's settings orolith.jobs.*; what is no number of 0 or more is the default."""
        def read(name: str, default: float) -> float:
            try:
                value = float(spark.conf.get(f"orolith.jobs.{name}", str(default)))
            except ValueError:
                return default
            return value if value >= 0 else default

        return Lifecycle(*[read(n, getattr(Lifecycle, n)) for n in ("max_runtime", "ttl", "stale", "sweep")])


def snapshot(text: Column) -> Column:
    """A progress file's text as a struct; null if it is missing, empty or broken."""
    return F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), PROGRESS)


def known_or_busy(progress: Column) -> Column:
    """The progress, or a stand-in for one that could not be read."""
    busy = F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in (("status", "string", "busy"), ("step", "string", ""), ("message", "string", "Reading progress"), ("percent", "int", 0), ("error", "string", None), ("started_at", "double", None), ("updated_at", "double", None))])
    return F.coalesce(progress, busy)


def written(events: DataFrame) -> DataFrame:
    """Snapshots as they are kept: percent within 0..100, started_at that of the job's first one."""
    first = F.first("updated_at").over(Window.partitionBy("job_id").orderBy("updated_at", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumns({"percent": F.greatest(F.lit(0), F.least(F.lit(100), F.col("percent"))), "started_at": first})


def latest(events: DataFrame) -> DataFrame:
    """(job_id, status, percent, started_at, updated_at): a job's last snapshot, of equal times the
    larger event_id, with the time of its first; a grouping, so snapshots meet map-side first."""
    last = F.max(F.struct("updated_at", "event_id", "status", "percent")).alias("s")
    out = events.groupBy("job_id").agg(last, F.min("updated_at").alias("started_at"))
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.col("s.percent")))
    return out.select("job_id", "s.status", percent.alias("percent"), "started_at", "s.updated_at")


def should_expire(now: Column, settings: Lifecycle, seen: Column) -> Column:
    """Whether a job (status, updated_at, started_at, all null without progress) is to go; `seen` is
    when its folder last changed. Statuses other than done, error and running stay."""
    updated = F.coalesce("updated_at", seen)
    started = F.coalesce("started_at", updated)
    status = F.coalesce("status", F.lit("running"))
    unknown = F.col("status").isNull() & F.col("updated_at").isNull()
    return (
        F.when(unknown, now - seen >= settings.ttl)
        .when(status.isin("done", "error"), now - updated >= settings.ttl)
        .when(status == "running", (now - updated >= settings.stale) | (now - started >= settings.max_runtime))
        .otherwise(F.lit(False))
    )


def expired(jobs: DataFrame, now: Column, settings: Lifecycle | None = None, active: DataFrame | None = None) -> DataFrame:
    """The job_ids to remove, in order; jobs has job_id, seen and the last snapshot's columns, and
    active the ids of jobs at work, which stay."""
    settings = settings or Lifecycle()
    idle = jobs if active is None else jobs.join(sized(active.select("job_id").distinct()), "job_id", "left_anti")
    return idle.where(should_expire(now, settings, F.col("seen"))).select("job_id").orderBy("job_id")


def pruned(files: DataFrame) -> DataFrame:
    """Files (job_id, name) that go when a job fails: all but its progress."""
    return files.where("name <> 'progress.json'")
