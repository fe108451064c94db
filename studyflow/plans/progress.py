"""Folding learning events into per-topic progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow.functions.scalars import from_hundredths, hundredths, whole_div
from studyflow.session import wide

KEYS = ["enrollment_id", "topic_id"]

#: A rollup of the events of one event batch, added by one run of the fold.
ROLLUP_SCHEMA = """
    event_batch string, enrollment_id string, topic_id string, minutes bigint, new_percent decimal(5,2),
    first_activity_at timestamp_ntz, batch_last_at timestamp_ntz"""

#: Sums of an enrollment's progress, by domain too: exact whole numbers (hundredths), from which every report follows.
SUMS_SCHEMA = """
    enrollment_id string, completed bigint, in_progress bigint, begun bigint, percent bigint, hours bigint,
    by_domain map<string,struct<completed:bigint,percent:bigint,hours:bigint>>"""


def _minutes() -> Column:
    return F.coalesce(F.col("duration_minutes"), F.lit(0)).cast("bigint")


def _percent() -> Column:
    return F.coalesce(F.col("completion_percent"), F.lit(0)).cast("decimal(5,2)")


def stored_hours(minutes: Column) -> Column:
    """Minutes as hundredths of an hour, rounded half-up as the two-decimal column stores them."""
    return whole_div(minutes * 10 + 3, F.lit(6).cast("bigint"))


def rollup(events: DataFrame, *more_keys: str | Column) -> DataFrame:
    """Minutes, highest percent, first and last time per (enrollment, topic) of a batch."""
    return events.groupBy(*KEYS, *more_keys).agg(
        F.sum(_minutes()).alias("minutes"),
        F.max(_percent()).alias("new_percent"),
        F.min("event_timestamp").alias("first_activity_at"),
        F.max("event_timestamp").alias("batch_last_at"),
    )


def _status(percent: Column, minutes: Column, kept: Column) -> Column:
    return (
        F.when(percent >= 100, "COMPLETED")
        .when((percent > 0) | (minutes > 0), "IN_PROGRESS")
        .otherwise(kept)
    )


def apply_rollup(state: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Merge one batch rollup into the progress state: add, max, keep-first, overwrite.

    Rows without new events keep every value.
    """
    old = {c: F.col(f"_t_{c}") for c in state.columns if c not in KEYS}
    t = state.select(
        *KEYS, *[F.col(c).alias(f"_t_{c}") for c in old], F.lit(True).alias("_known")
    )
    joined = t.join(batch.withColumn("_new", F.lit(True)), KEYS, "full_outer")

    percent = F.greatest(
        F.coalesce(old["completion_percent"], F.lit(0).cast("decimal(5,2)")), F.col("new_percent")
    )
    hours = hundredths(F.coalesce(old["hours_spent"], F.lit(0).cast("decimal(7,2)")))
    kept_status = F.when(F.col("_known"), old["progress_status"]).otherwise(F.lit("NOT_STARTED"))
    values = {
        "progress_status": _status(percent, F.col("minutes"), kept_status),
        "completion_percent": percent,
        "hours_spent": from_hundredths(hours + stored_hours(F.col("minutes")), 7),
        "started_at": F.coalesce(old["started_at"], F.col("first_activity_at")),
        "completed_at": F.when(
            percent >= 100, F.coalesce(old["completed_at"], F.col("batch_last_at"))
        ).otherwise(old["completed_at"]),
        "last_activity_at": F.col("batch_last_at"),
        "updated_at": now.cast("timestamp_ntz"),
    }
    return joined.select(
        *[
            F.col(c) if c in KEYS else F.when(F.col("_new"), values[c]).otherwise(old[c]).alias(c)
            for c in state.columns
        ]
    )


def fold_progress(state: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """New progress snapshot after one batch of events."""
    return apply_rollup(state, rollup(events), now)


def fold_result(batch: DataFrame) -> DataFrame:
    """Result text of a fold: every (enrollment, topic) of the rollup is one affected record."""
    # Fixed value: the text of the result.
    head = "Learning events processed successfully. Progress records affected: "
    return batch.agg(
        F.concat(F.lit(head), F.count(F.lit(1)).cast("string")).alias("run_result")
    )


def progress_fold(
    events: DataFrame, batch_col: str, initial: DataFrame | None = None
) -> DataFrame:
    """Progress after folding all batches in the order of ``batch_col``, computed in one pass.

    Equal to applying ``fold_progress`` batch after batch. Events are rolled up per batch, then the
    rollups per key; both steps combine on the map side, so a key with most of the events is small
    before it is shuffled.
    """
    return fold_rollups(rollup(events, batch_col), F.col(batch_col), initial)


def fold_rollups(
    per_batch: DataFrame, batch: Column, initial: DataFrame | None = None, run_at: Column | None = None
) -> DataFrame:
    """``progress_fold`` of rollups, one row per key and batch; with ``run_at``, also ``updated_at`` of the last run."""
    complete = F.col("new_percent") >= 100
    folded = per_batch.groupBy(*KEYS).agg(
        F.sum("minutes").alias("minutes"),
        F.sum(stored_hours(F.col("minutes"))).alias("hours"),
        F.max("new_percent").alias("new_percent"),
        F.min_by("first_activity_at", batch).alias("first_at"),
        F.min_by("batch_last_at", batch).alias("first_batch_last_at"),
        F.max_by("batch_last_at", batch).alias("last_at"),
        F.min_by("batch_last_at", F.when(complete, batch)).alias("reached_at"),
        *([F.max(run_at).alias("run_at")] if run_at is not None else []),
    )
    if initial is None:
        percent = F.col("new_percent")
        return folded.select(
            *KEYS,
            _status(percent, F.col("minutes"), F.lit("NOT_STARTED")).alias("progress_status"),
            percent.alias("completion_percent"),
            from_hundredths(F.col("hours"), 7).alias("hours_spent"),
            F.col("first_at").alias("started_at"),
            F.when(percent >= 100, F.col("reached_at")).alias("completed_at"),
            F.col("last_at").alias("last_activity_at"),
        )
    start = initial.select(
        *KEYS,
        F.lit(True).alias("_known"),
        *[
            F.col(c).alias(f"_t_{c}")
            for c in (
                "progress_status", "completion_percent", "hours_spent",
                "started_at", "completed_at", "last_activity_at",
                *(["updated_at"] if run_at is not None else []),
            )
        ],
    )
    joined = start.join(folded.withColumn("_new", F.lit(True)), KEYS, "full_outer")
    before = F.coalesce(F.col("_t_completion_percent"), F.lit(0).cast("decimal(5,2)"))
    percent = F.greatest(before, F.coalesce("new_percent", F.lit(0).cast("decimal(5,2)")))
    hours = hundredths(F.coalesce("_t_hours_spent", F.lit(0).cast("decimal(7,2)")))
    kept = F.when(F.col("_known"), F.col("_t_progress_status")).otherwise(F.lit("NOT_STARTED"))
    reached = F.when(before >= 100, F.col("first_batch_last_at")).otherwise(F.col("reached_at"))
    touched = {
        "progress_status": _status(percent, F.col("minutes"), kept),
        "completion_percent": percent,
        "hours_spent": from_hundredths(hours + F.col("hours"), 7),
        "started_at": F.coalesce("_t_started_at", "first_at"),
        "completed_at": F.when(
            percent >= 100, F.coalesce(F.col("_t_completed_at"), reached)
        ).otherwise(F.col("_t_completed_at")),
        "last_activity_at": F.col("last_at"),
        **({"updated_at": F.col("run_at")} if run_at is not None else {}),
    }
    return joined.select(
        *KEYS,
        *[F.when(F.col("_new"), v).otherwise(F.col(f"_t_{c}")).alias(c) for c, v in touched.items()],
    )


def from_logs(assignments: DataFrame, rollups: DataFrame) -> DataFrame:
    """Topic progress from its two logs: the first assignment of every (enrollment, topic), and all runs of the fold.

    The rollups of an event batch count in the first run that added them, so a run that meets the batch again (because its
    files were written again) has no effect. Everything is grouped by the key or more, so either log is shuffled once.
    Few keys repeat within a log, and its small files pack many rows: nothing is sorted and combined before that shuffle.
    """
    order, parts = F.struct("applied_at", "batch"), wide(rollups.sparkSession)
    values = ["minutes", "new_percent", "first_activity_at", "batch_last_at"]
    added = (
        rollups.repartition(parts, *KEYS)
        .groupBy(*KEYS, "event_batch")
        .agg(F.min_by(F.struct(*values, "applied_at", "batch"), order).alias("of_"))
        .select(*KEYS, "of_.*")
        .groupBy(*KEYS, "applied_at", "batch")
        .agg(
            F.sum("minutes").alias("minutes"),
            F.max("new_percent").alias("new_percent"),
            F.min("first_activity_at").alias("first_activity_at"),
            F.max("batch_last_at").alias("batch_last_at"),
        )
    )
    columns = [c for c in assignments.columns if c not in ("applied_at", "batch", "bucket")]
    kept = [c for c in columns if c not in KEYS]
    assigned = (
        assignments.repartition(parts, *KEYS)
        .groupBy(*KEYS)
        .agg(F.min_by(F.struct(*kept), order).alias("of_"))
        .select(*KEYS, "of_.*")
    )
    return fold_rollups(added, order, assigned, F.col("applied_at")).select(*columns)
