"""Runs: their order, their state and their liveness, and a log of their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phases that end a run, and the seconds since a heartbeat after which a run counts as resuming or lost.
ENDED = ("COMPLETE", "FAILED", "PURGED", "CLEANED", "STAGED")
RUNNING_SECONDS, RESUMING_SECONDS = 30, 300


def newest(scans: DataFrame, k: int) -> DataFrame:
    """The k newest runs by created_at, then id, with their ``place``; unknown times come last."""
    few = scans.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(k)
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    return few.withColumn("place", F.row_number().over(order))


def in_progress(scans: DataFrame) -> DataFrame:
    """The newest run whose phase is known and ends no run."""
    return newest(scans.filter(~F.col("phase").isin(*ENDED)), 1).drop("place")


def latest_complete(scans: DataFrame, archive_root: str | None = None) -> DataFrame:
    done = scans.filter(F.col("phase") == "COMPLETE")
    return newest(done if archive_root is None else done.filter(F.col("archive_root") == archive_root), 1).drop("place")


def seconds_since(at: Column, now: Column) -> Column:
    """Whole seconds from ``at`` to ``now``, none below 0; null for null."""
    n = F.timestamp_diff("SECOND", F.date_trunc("SECOND", at).cast("timestamp_ntz"), now)
    return F.when(n < 0, F.lit(0).cast("long")).otherwise(n)


def heartbeat_state(beat: Column, now: Column) -> Column:
    s = seconds_since(beat, now)
    return F.when(beat.isNull(), "UNKNOWN").when(s < RUNNING_SECONDS, "RUNNING").when(s < RESUMING_SECONDS, "RESUMING").otherwise("INTERRUPTED")


def current_state(log: DataFrame) -> DataFrame:
    """The run table of an append-only log of its changes: of each id the row with the highest ``seq``."""
    rest = [c for c in log.columns if c not in ("id", "seq")]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")
