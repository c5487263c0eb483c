"""Progress of jobs as a stream: the last snapshot of each job, with a timeout for silent ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What the folder's JSON lines hold.
EVENTS = "job_id string, status string, percent int, updated_at double, event_id long"
STATE = "status string, percent int, started_at double, updated_at double, event_id long"


def events(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Snapshots appended as JSON lines; lines that can't be read give no job and are left out."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).json(folder).where("job_id IS NOT NULL")


def track(stream: DataFrame, max_runtime: float = 3600.0) -> DataFrame:
    """(job_id, status, percent, started_at, updated_at): a row whenever a job's last snapshot
    changes, and one of status `timeout` if a job stays silent for `max_runtime` seconds.

    The state of a job is one row; it is dropped once the job is done, failed or timed out. Late
    snapshots only move started_at back.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, percent, started, updated, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "timeout", percent, started, updated)], columns=["job_id", "status", "percent", "started_at", "updated_at"])
            return
        status, percent, started, updated, number = state.get if state.exists else ("", 0, float("inf"), float("-inf"), -1)
        changed = False
        for frame in frames:
            started = min(started, float(frame["updated_at"].min()))
            last = frame.sort_values(["updated_at", "event_id"]).iloc[-1]
            if (float(last.updated_at), int(last.event_id)) > (updated, number):
                status, percent, updated, number, changed = str(last.status), max(0, min(100, int(last.percent))), float(last.updated_at), int(last.event_id), True
        if status in ("done", "error"):
            if state.exists:
                state.remove()
        else:
            state.update((status, percent, started, updated, number))
            state.setTimeoutDuration(int(max_runtime * 1000))
        if changed:
            yield pd.DataFrame([(key[0], status, percent, started, updated)], columns=["job_id", "status", "percent", "started_at", "updated_at"])

    out = "job_id string, status string, percent int, started_at double, updated_at double"
    whole = stream.where("updated_at IS NOT NULL").select("job_id", F.coalesce("status", F.lit("running")).alias("status"), F.coalesce("percent", F.lit(0)).alias("percent"), "updated_at", F.coalesce("event_id", F.lit(0)).alias("event_id"))
    return whole.groupBy("job_id").applyInPandasWithState(run, out, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)

