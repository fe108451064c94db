"""Activity inbox and direct recording: validate, resolve the enrollment, append events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.functions.scalars import is_blank, learner_key, trimmed, try_decimal, try_timestamp
from studyflow.operators.keyed import (
    flag_existing,
    key_facts,
    latest_by,
    lookup,
    restrict,
)
from studyflow.operators.rules import ERROR, first_failure, run_counts, split, to_rejects
from studyflow.plans.learners import ledger_ids, record_processed

# Event types, rejection reasons and result texts.
CSV_EVENT_TYPES = ("STARTED", "STUDIED", "COMPLETED")
DIRECT_EVENT_TYPES = ("STARTED", "STUDIED", "PROGRESS_UPDATED", "COMPLETED")
ACTIVITY_ID_REQUIRED = "Activity ID is required."
EMPLOYEE_REQUIRED = "Employee ID is required."
TOPIC_REQUIRED = "Topic ID is required."
TYPE_REQUIRED = "Event type is required."
BAD_TYPE = "Event type must be STARTED, STUDIED or COMPLETED."
DURATION_REQUIRED = "Duration in minutes is required."
DURATION_NOT_NUMERIC = "Duration in minutes must be numeric."
DURATION_TOO_LONG = "Duration in minutes is too large."
DURATION_NEGATIVE = "Duration in minutes cannot be negative."
DURATION_NOT_WHOLE = "Duration in minutes must be a whole number."
PERCENT_REQUIRED = "Completion percentage is required."
PERCENT_NOT_NUMERIC = "Completion percentage must be numeric."
PERCENT_RANGE = "Completion percentage must be between 0 and 100."
TIMESTAMP_REQUIRED = "Activity timestamp is required."
TIMESTAMP_INVALID = "Activity timestamp is invalid."
DUPLICATE_ACTIVITY = "Duplicate activity ID exists in the uploaded batch."
ALREADY_PROCESSED = "Activity has already been processed successfully."
EVENT_EXISTS = "Activity ID already exists in the learning-events table."
NO_ENROLLMENT = "No active SnowPro Core enrollment was found for the employee."
NOT_ASSIGNED = "Topic is not assigned to the learner enrollment."
LEDGER_TEXT = "Learning activity accepted and inserted into CORE.LEARNING_EVENTS."
CSV_SOURCE = "CSV_UPLOAD"
DIRECT_SOURCE = "RECORD_LEARNING_ACTIVITY"
DIRECT_NOT_ASSIGNED = "Activity rejected: The topic is not assigned to this enrollment."
DIRECT_BAD_TYPE = "Activity rejected: Use STARTED, STUDIED, PROGRESS_UPDATED or COMPLETED."
DIRECT_NEGATIVE = "Activity rejected: Duration cannot be negative."
DIRECT_RANGE = "Activity rejected: Completion percentage must be between 0 and 100."
DIRECT_RECORDED = "Activity recorded successfully. Event ID: "
# The most minutes whose hours the progress table's decimal(7,2) column can hold.
MAX_MINUTES = 5_999_999


def normalize_activity(df: DataFrame) -> DataFrame:
    """Trim every field; upper-case topic and event type."""
    cleaned = {c: trimmed(c) for c in T.ACTIVITY_INBOX}
    for c in ("topic_id", "event_type"):
        cleaned[c] = F.upper(F.trim(c)).alias(c)
    return df.select(*[cleaned.get(c, F.col(c)) for c in df.columns])


def activity_rules(strict: bool = False) -> list[tuple[Column, str]]:
    """Row rules in order.

    Minutes are rounded to a whole number on conversion, so ``30.5`` counts as 31. With ``strict``
    a fraction is refused instead.
    """
    minutes = try_decimal(F.col("duration_minutes"), 38, 0)
    exact = try_decimal(F.col("duration_minutes"), 38, 10) if strict else minutes
    percent = try_decimal(F.col("completion_percent"), 5, 2)
    return [
        (is_blank(F.col("activity_id")), ACTIVITY_ID_REQUIRED),
        (is_blank(F.col("employee_id")), EMPLOYEE_REQUIRED),
        (is_blank(F.col("topic_id")), TOPIC_REQUIRED),
        (is_blank(F.col("event_type")), TYPE_REQUIRED),
        (~F.col("event_type").isin(*CSV_EVENT_TYPES), BAD_TYPE),
        (is_blank(F.col("duration_minutes")), DURATION_REQUIRED),
        (minutes.isNull(), DURATION_NOT_NUMERIC),
        (minutes < 0, DURATION_NEGATIVE),
        (minutes > MAX_MINUTES, DURATION_TOO_LONG),
        (exact != F.floor(exact), DURATION_NOT_WHOLE),
        (is_blank(F.col("completion_percent")), PERCENT_REQUIRED),
        (percent.isNull(), PERCENT_NOT_NUMERIC),
        ((percent < 0) | (percent > 100), PERCENT_RANGE),
        (is_blank(F.col("activity_timestamp")), TIMESTAMP_REQUIRED),
        (try_timestamp(F.col("activity_timestamp")).isNull(), TIMESTAMP_INVALID),
    ]


def latest_enrollment(learners: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Newest active enrollment per employee id spelling.

    Enrollments meet the learners first, so those of others are never ranked. An employee has one
    learner id, so the rows are ranked where they were joined, without another shuffle.
    """
    newest = [F.desc("created_at"), F.desc("enrollment_id")]
    active = enrollments.filter(
        (F.col("certification_id") == T.CERTIFICATION_ID)
        & (F.col("enrollment_status") == "ACTIVE")
    ).select("learner_id", "enrollment_id", "created_at")
    owned = learners.select("learner_id", "employee_id").join(active, "learner_id")
    return latest_by(owned, ["learner_id", "employee_id"], newest).select("employee_id", "enrollment_id")


def resolve_enrollment(df: DataFrame, learners: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Add the active enrollment of each row's employee, null when there is none.

    Only the learners that the batch names are taken from the learner table, and only their
    enrollments are ranked. All of this goes by learner id: where both tables are laid out by it
    (``sources.layout``), only ids of the batch are moved.
    """
    mine = df.select(learner_key(F.col("employee_id")).alias("learner_id"))
    named = restrict(learners.select("learner_id", "employee_id"), mine, ["learner_id"])
    return lookup(df, latest_enrollment(named, enrollments), ["employee_id"], T.LINEAGE)


def resolve_assignment(
    df: DataFrame,
    learners: DataFrame,
    enrollments: DataFrame,
    progress: DataFrame,
) -> DataFrame:
    """``resolve_enrollment`` and ``flag_unassigned`` with one join on the batch.

    The topics of an enrollment (a bounded set) travel with it, so the batch is not shuffled a
    second time by enrollment and topic.
    """
    named = restrict(learners.select("learner_id", "employee_id"), df, ["employee_id"])
    current = latest_enrollment(named, enrollments)
    held = restrict(progress.select("enrollment_id", "topic_id"), current, ["enrollment_id"])
    topics = held.groupBy("enrollment_id").agg(F.collect_set("topic_id").alias("_topics"))
    found = current.join(topics, "enrollment_id", "left")
    assigned = F.coalesce(F.array_contains("_topics", F.col("topic_id")), F.lit(False))
    return (
        lookup(df, found, ["employee_id"], T.LINEAGE)
        .withColumn("is_unassigned", ~assigned)
        .drop("_topics")
    )


def flag_unassigned(
    df: DataFrame,
    progress: DataFrame,
    spread: Sequence[str] = T.LINEAGE,
) -> DataFrame:
    """Mark rows whose (enrollment, topic) has no progress row."""
    flagged = flag_existing(
        df, progress, ["enrollment_id", "topic_id"], spread, "_assigned", unique=True
    )
    return flagged.withColumn("is_unassigned", ~F.col("_assigned")).drop("_assigned")


def validate_activity(
    df: DataFrame,
    ledger: DataFrame,
    events: DataFrame,
    learners: DataFrame,
    enrollments: DataFrame,
    progress: DataFrame,
    strict: bool = False,
) -> DataFrame:
    """Normalised rows with enrollment and first failing rule: row rules, then table rules."""
    checked = normalize_activity(df).withColumn(
        "_row_error", first_failure(activity_rules(strict))
    )
    known = {
        "is_processed": ledger_ids(ledger, T.ACTIVITY_PIPELINE, "activity_id"),
        "is_event": events.select(F.col("event_id").alias("activity_id")),
    }
    flagged = key_facts(checked, "activity_id", T.LINEAGE, known)
    open_reason = first_failure(
        [
            (F.col("_row_error").isNotNull(), F.col("_row_error")),
            (F.col("is_duplicate"), DUPLICATE_ACTIVITY),
            (F.col("is_processed"), ALREADY_PROCESSED),
            (F.col("is_event"), EVENT_EXISTS),
        ]
    )
    staged = flagged.withColumn("_open", open_reason).drop(
        "_row_error", "is_duplicate", "is_processed", "is_event"
    )
    assigned = resolve_assignment(staged, learners, enrollments, progress)
    reason = first_failure(
        [
            (F.col("_open").isNotNull(), F.col("_open")),
            (F.col("enrollment_id").isNull(), NO_ENROLLMENT),
            (F.col("is_unassigned"), NOT_ASSIGNED),
        ]
    )
    return assigned.withColumn(ERROR, reason).drop("_open", "is_unassigned")


def csv_events(valid: DataFrame, now: Column) -> DataFrame:
    """Event rows of accepted activity."""
    return valid.select(
        F.col("activity_id").alias("event_id"),
        "enrollment_id",
        "topic_id",
        "event_type",
        try_timestamp(F.col("activity_timestamp")).alias("event_timestamp"),
        try_decimal(F.col("duration_minutes"), 8, 0).alias("duration_minutes"),
        try_decimal(F.col("completion_percent"), 5, 2).alias("completion_percent"),
        F.lit(CSV_SOURCE).alias("event_source"),
        "notes",
        now.cast("timestamp_ntz").alias("processed_at"),
    )


@dataclass
class ActivityRun:
    events: DataFrame
    rejects: DataFrame
    ledger: DataFrame
    counts: DataFrame


def process_validated_activity(validated: DataFrame, now: Column) -> ActivityRun:
    valid, rejected = split(validated)
    return ActivityRun(
        csv_events(valid, now),
        to_rejects(rejected, T.ACTIVITY_PIPELINE, "activity_id", T.ACTIVITY_INBOX, now),
        record_processed(valid, T.ACTIVITY_PIPELINE, "activity_id", F.lit(LEDGER_TEXT), now),
        run_counts(validated),
    )


def process_activity(
    inbox: DataFrame,
    ledger: DataFrame,
    events: DataFrame,
    learners: DataFrame,
    enrollments: DataFrame,
    progress: DataFrame,
    now: Column,
    strict: bool = False,
) -> ActivityRun:
    """One batch of the activity pipeline."""
    validated = validate_activity(inbox, ledger, events, learners, enrollments, progress, strict)
    return process_validated_activity(validated, now)


def validate_direct(df: DataFrame, progress: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Check direct recordings (enrollment, topic, type, minutes, percent) and settle the percent.

    A completed activity always counts as 100 percent. A missing type is refused here because an
    event row must have one. Minutes and percent are whole numbers.
    """
    df = df.withColumn("duration_minutes", F.col("duration_minutes").cast("decimal(38,0)"))
    kind = F.upper(F.trim("event_type"))
    percent = F.when(kind == "COMPLETED", F.lit(100).cast("decimal(38,0)")).otherwise(
        F.coalesce(F.col("completion_percent").cast("decimal(38,0)"), F.lit(0))
    )
    flagged = flag_unassigned(df, progress, spread).withColumn("final_percent", percent)
    reason = first_failure(
        [
            (F.col("is_unassigned"), DIRECT_NOT_ASSIGNED),
            (kind.isNull() | ~kind.isin(*DIRECT_EVENT_TYPES), DIRECT_BAD_TYPE),
            (F.col("duration_minutes") < 0, DIRECT_NEGATIVE),
            ((F.col("final_percent") < 0) | (F.col("final_percent") > 100), DIRECT_RANGE),
        ]
    )
    return flagged.withColumn(ERROR, reason).drop("is_unassigned")


def record_activity(validated: DataFrame, event_id: Column, now: Column) -> DataFrame:
    """Events of the accepted direct recordings."""
    valid, _ = split(validated)
    return valid.select(
        event_id.alias("event_id"),
        "enrollment_id",
        "topic_id",
        F.upper(F.trim("event_type")).alias("event_type"),
        now.cast("timestamp_ntz").alias("event_timestamp"),
        F.coalesce("duration_minutes", F.lit(0)).cast("decimal(8,0)").alias("duration_minutes"),
        F.col("final_percent").cast("decimal(5,2)").alias("completion_percent"),
        F.lit(DIRECT_SOURCE).alias("event_source"),
        "notes",
        F.lit(None).cast("timestamp_ntz").alias("processed_at"),
    )


def new_event_id() -> Column:
    return F.concat(F.lit("EVT_"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))


def direct_result(event_id: Column) -> Column:
    """Result text of a direct recording."""
    return F.coalesce(F.col(ERROR), F.concat(F.lit(DIRECT_RECORDED), event_id))
