"""Reports on migration runs: runs, statements, objects, snapshots, change streams, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _seconds(start: str, end: str):
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def runs_by_status(runs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return runs.filter(F.col("status").isin(*statuses)).orderBy(F.desc("started_at"), "run_id")


def finished_runs(runs: DataFrame) -> DataFrame:
    return runs.filter("finished_at is not null").withColumn("seconds", _seconds("started_at", "finished_at"))


def statement_outcome(statements: DataFrame) -> DataFrame:
    """Per run and phase: statements, applied ones, retries, errors, seconds from the first start to the last end."""
    return statements.groupBy("run_id", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "applied").alias("applied"), F.sum("retries").alias("retries"),
        F.count_if(F.col("status") == "error").alias("errors"),
        (F.unix_timestamp(F.max("finished_at")) - F.unix_timestamp(F.min("started_at"))).alias("seconds"),
    )


def changed_objects(states: DataFrame) -> DataFrame:
    """Objects whose latest snapshot before and after a run differ; absent ones on either side count as changed."""
    latest = states.groupBy("run_id", "object").pivot("side", ["before", "after"]).agg(F.max_by("state", F.struct("noted_at", "state")))
    return latest.filter(~F.col("before").eqNullSafe(F.col("after")))


def active_snapshots(progress: DataFrame) -> DataFrame:
    """Pending and running snapshots per run, with rows copied and rows a second."""
    live = progress.filter(F.col("status").isin("pending", "running"))
    sums = live.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_snapshots"), F.sum("rows_copied").alias("rows_copied"), F.sum(_seconds("started_at", "updated_at")).alias("seconds")
    )
    return sums.withColumn("rate", F.when(F.col("seconds") > 0, F.col("rows_copied") / F.col("seconds")))


def stream_progress(progress: DataFrame) -> DataFrame:
    """Active change streams: events, bytes, where to resume, and seconds behind the highest mark of all streams of the run."""
    high = progress.groupBy("run_id").agg(F.max("high_watermark").alias("_high"))
    active = progress.filter("active").groupBy("run_id", "stream").agg(
        F.sum("n_events").alias("n_events"), F.sum("n_bytes").alias("n_bytes"), F.max("position").alias("resume_at"), F.max("high_watermark").alias("_own")
    )
    return active.join(high, "run_id").withColumn("lag_seconds", _seconds("_own", "_high")).drop("_own", "_high")


def newest_events(log: DataFrame, levels: Sequence[str], per_run: int = 20) -> DataFrame:
    """The newest events of the levels for each run; each task keeps no more than ``per_run`` rows of a run."""
    order = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return log.filter(F.col("level").isin(*levels)).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_run)
