"""Learner inbox and registration: validate, band, path, keys, dates, upserts, first progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.functions.scalars import (
    enrollment_key,
    is_blank,
    learner_key,
    trimmed,
    try_decimal,
)
from studyflow.operators.keyed import insert_missing, key_facts, upsert
from studyflow.operators.ranges import range_join
from studyflow.operators.rules import ERROR, first_failure, run_counts, split, to_rejects
from studyflow.plans.schedule import fresh_progress

# Rejection reasons and result texts.
SOURCE_ID_REQUIRED = "Source record ID is required."
EMPLOYEE_REQUIRED = "Employee ID is required."
NAME_REQUIRED = "Learner name is required."
EMAIL_REQUIRED = "Email is required."
BAD_EMAIL = "Email format is invalid."
EXPERIENCE_REQUIRED = "Snowflake experience is required."
EXPERIENCE_NOT_NUMERIC = "Snowflake experience must be numeric."
EXPERIENCE_NEGATIVE = "Snowflake experience must be zero or greater."
DUPLICATE_SOURCE_ID = "Duplicate source record ID exists in the uploaded batch."
ALREADY_PROCESSED = "Source record has already been processed successfully."
DETAILS_REQUIRED = "Registration failed: Employee ID, learner name and email are required."
REGISTRATION_NEGATIVE = "Registration failed: Snowflake experience must be zero or greater."

YEARS = "snowflake_experience_years"


def normalize_learners(df: DataFrame) -> DataFrame:
    """Trim every field and lower-case the email."""
    cleaned = {c: trimmed(c) for c in T.LEARNER_INBOX}
    cleaned["email"] = F.lower(F.trim("email")).alias("email")
    return df.select(*[cleaned.get(c, F.col(c)) for c in df.columns])


def learner_rules() -> list[tuple[Column, str]]:
    years = try_decimal(F.col(YEARS), 4, 1)
    return [
        (is_blank(F.col("source_record_id")), SOURCE_ID_REQUIRED),
        (is_blank(F.col("employee_id")), EMPLOYEE_REQUIRED),
        (is_blank(F.col("learner_name")), NAME_REQUIRED),
        (is_blank(F.col("email")), EMAIL_REQUIRED),
        (~F.col("email").like("%@%.%"), BAD_EMAIL),
        (is_blank(F.col(YEARS)), EXPERIENCE_REQUIRED),
        (years.isNull(), EXPERIENCE_NOT_NUMERIC),
        (years < 0, EXPERIENCE_NEGATIVE),
    ]


def ledger_ids(ledger: DataFrame, pipeline: str, key: str) -> DataFrame:
    """Accepted ids of one pipeline, under the batch's key name."""
    return ledger.filter(F.col("pipeline_name") == pipeline).select(
        F.col("source_record_id").alias(key)
    )


def validate_learners(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Normalised rows with the first failing rule.

    Every copy of a repeated source id is refused, and invalid rows count towards the repetition.
    """
    checked = normalize_learners(df).withColumn("_row_error", first_failure(learner_rules()))
    known = {"is_processed": ledger_ids(ledger, T.LEARNERS_PIPELINE, "source_record_id")}
    flagged = key_facts(checked, "source_record_id", T.LINEAGE, known)
    reason = first_failure(
        [
            (F.col("_row_error").isNotNull(), F.col("_row_error")),
            (F.col("is_duplicate"), DUPLICATE_SOURCE_ID),
            (F.col("is_processed"), ALREADY_PROCESSED),
        ]
    )
    return flagged.withColumn(ERROR, reason).drop("_row_error", "is_duplicate", "is_processed")


def typed_learners(valid: DataFrame) -> DataFrame:
    return valid.withColumn(YEARS, try_decimal(F.col(YEARS), 4, 1))


def experience_band(years: Column) -> Column:
    """Level code by years of experience: none, up to 5, up to 9, more."""
    return (
        F.when(years == 0, "FRESHER")
        .when(years <= 5, "EXP_0_5")
        .when(years <= 9, "EXP_5_9")
        .otherwise("EXP_9_PLUS")
    )


def band_by_range(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Level by the bounds kept in the level table, so that bands are data, any number of them. Years have one decimal."""
    bounds = levels.select("experience_level_code", "min_years", "max_years")
    joined = range_join(df, _tenths(YEARS), bounds, _tenths("min_years"), _tenths("max_years"))
    return joined.drop("min_years", "max_years")


def _tenths(column: str) -> Column:
    return (F.col(column) * 10).cast("bigint")


def registration_error() -> Column:
    years = F.col(YEARS)
    missing = F.lit(False)
    for c in ("employee_id", "learner_name", "email"):
        missing = missing | is_blank(F.trim(F.col(c)))
    return first_failure(
        [(missing, DETAILS_REQUIRED), (years.isNull() | (years < 0), REGISTRATION_NEGATIVE)]
    )


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "learner_id": learner_key(F.col("employee_id")),
            "enrollment_id": enrollment_key(F.col("employee_id")),
        }
    )


def assign_path(df: DataFrame, paths: DataFrame) -> DataFrame:
    """The active path of the certification for each learner's level.

    A level without a path, or with two, fails the run; dropping its learners would lose accepted
    rows, and joining both would accept them twice.
    """
    chosen = (
        paths.filter(F.col("active_flag") & (F.col("certification_id") == T.CERTIFICATION_ID))
        .groupBy("experience_level_code")
        .agg(
            F.min("path_id").alias("path_id"),
            F.min("duration_weeks").alias("duration_weeks"),
            F.count(F.lit(1)).alias("_paths"),
        )
    )
    several = F.concat(F.lit("two active paths for level "), F.col("experience_level_code"))
    missing = F.concat(F.lit("no active path for level "), F.col("experience_level_code"))
    one = F.when(F.col("_paths") > 1, F.raise_error(several).cast("string")).otherwise(
        F.coalesce("path_id", F.raise_error(missing).cast("string"))
    )
    return (
        df.join(chosen, "experience_level_code", "left").withColumn("path_id", one).drop("_paths")
    )


def with_targets(df: DataFrame, as_of: Column) -> DataFrame:
    """Completion after the weeks of the path, exam a week later."""
    done = F.date_add(as_of, (F.col("duration_weeks") * 7).cast("int"))
    return df.withColumns(
        {"target_completion_date": done, "target_exam_date": F.date_add(done, 7)}
    )


def placed(df: DataFrame, paths: DataFrame, as_of: Column) -> DataFrame:
    """Registration values of each valid row: level, path, keys and target dates."""
    banded = df.withColumn("experience_level_code", experience_band(F.col(YEARS)))
    return with_targets(with_keys(assign_path(banded, paths)), as_of)


MUTABLE = [
    "learner_name", "email", "department_name", YEARS, "experience_level_code",
    "path_id", "target_completion_date", "target_exam_date",
]


def last_per_learner(rows: DataFrame) -> DataFrame:
    """One row per learner of a batch: changeable values of the last row, spelling of the first.

    Rows go by their number in the file, equal numbers by file name. Minimum and maximum combine on
    the map side, so a learner repeated any number of times sends one row per map task.
    """
    order = F.struct("source_row_number", "source_file_name")
    return (
        rows.groupBy("learner_id", "enrollment_id")
        .agg(
            F.min_by("employee_id", order).alias("employee_id"),
            F.max_by(F.struct(*MUTABLE), order).alias("_last"),
        )
        .select("learner_id", "enrollment_id", "employee_id", "_last.*")
    )


def registration_text() -> Column:
    return F.concat(
        F.lit("Learner registered successfully. Experience level: "),
        F.col("experience_level_code"),
        F.lit(", learning path: "),
        F.col("path_id"),
        F.lit(", duration: "),
        F.col("duration_weeks").cast("string"),
        F.lit(" weeks."),
    )


def upsert_learners(learners: DataFrame, last: DataFrame, as_of: Column, now: Column) -> DataFrame:
    """Merge learners; employee id spelling, joined date and creation time never change."""
    source = last.select(
        "learner_id", "employee_id", "learner_name", "email", "department_name",
        YEARS, "experience_level_code",
    )
    return upsert(
        learners,
        source,
        ["learner_id"],
        update=["learner_name", "email", "department_name", YEARS, "experience_level_code"],
        on_update={"active_flag": F.lit(True), "updated_at": now},
        on_insert={
            "joined_date": as_of, "active_flag": F.lit(True), "created_at": now, "updated_at": now,
        },
    )


def upsert_enrollments(
    enrollments: DataFrame, last: DataFrame, as_of: Column, now: Column
) -> DataFrame:
    """Merge enrollments; learner, certification, enrolled date and status never change."""
    source = last.select(
        "enrollment_id", "learner_id", F.lit(T.CERTIFICATION_ID).alias("certification_id"),
        "path_id", "target_completion_date", "target_exam_date",
    )
    return upsert(
        enrollments,
        source,
        ["enrollment_id"],
        update=["path_id", "target_completion_date", "target_exam_date"],
        on_update={"updated_at": now},
        on_insert={
            "enrolled_date": as_of, "enrollment_status": F.lit("ACTIVE"),
            "created_at": now, "updated_at": now,
        },
    )


def first_topics(rows: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
    """Untouched progress for the required topics of every path a learner was given in the batch."""
    given = rows.select("enrollment_id", "path_id").distinct()
    required = plan.filter("required_flag").select("path_id", "topic_id")
    pairs = given.join(F.broadcast(required), "path_id").select("enrollment_id", "topic_id")
    return fresh_progress(pairs.distinct(), now)


@dataclass
class Registration:
    learners: DataFrame
    enrollments: DataFrame
    progress: DataFrame


def register(
    rows: DataFrame,
    learners: DataFrame,
    enrollments: DataFrame,
    progress: DataFrame,
    plan: DataFrame,
    as_of: Column,
    now: Column,
) -> Registration:
    """Apply a batch of placed rows to the three learner tables, as if one by one in row order."""
    last = last_per_learner(rows)
    return Registration(
        upsert_learners(learners, last, as_of, now),
        upsert_enrollments(enrollments, last, as_of, now),
        insert_missing(progress, first_topics(rows, plan, now), ["enrollment_id", "topic_id"]),
    )


def register_learners(calls: DataFrame, paths: DataFrame, as_of: Column) -> DataFrame:
    """Batch form of single registrations: one result text per call, failures included.

    Rows without a ``failure`` carry the values ``register`` needs.
    """
    banded = calls.withColumn("failure", registration_error()).withColumn(
        "experience_level_code",
        F.when(F.col("failure").isNull(), experience_band(F.col(YEARS))),
    )
    chosen = paths.filter(
        F.col("active_flag") & (F.col("certification_id") == T.CERTIFICATION_ID)
    ).select("experience_level_code", "path_id", "duration_weeks")
    joined = banded.join(F.broadcast(chosen), "experience_level_code", "left")
    return with_targets(with_keys(joined), as_of).withColumn(
        "registration_result", F.coalesce("failure", registration_text())
    )


@dataclass
class LearnerRun:
    tables: Registration
    rejects: DataFrame
    ledger: DataFrame
    counts: DataFrame


def process_validated_learners(
    validated: DataFrame,
    learners: DataFrame,
    enrollments: DataFrame,
    progress: DataFrame,
    plan: DataFrame,
    paths: DataFrame,
    as_of: Column,
    now: Column,
) -> LearnerRun:
    valid, rejected = split(validated)
    rows = placed(typed_learners(valid), paths, as_of)
    return LearnerRun(
        register(rows, learners, enrollments, progress, plan, as_of, now),
        to_rejects(rejected, T.LEARNERS_PIPELINE, "source_record_id", T.LEARNER_INBOX, now),
        record_processed(
            rows, T.LEARNERS_PIPELINE, "source_record_id", registration_text(), now
        ),
        run_counts(validated),
    )


def record_processed(
    df: DataFrame, pipeline: str, key: str, result: Column, now: Column
) -> DataFrame:
    """Ledger rows for accepted ids."""
    return df.select(
        F.lit(pipeline).alias("pipeline_name"),
        F.col(key).alias("source_record_id"),
        now.cast("timestamp_ntz").alias("processed_at"),
        result.alias("processing_result"),
    )


def process_learners(
    inbox: DataFrame,
    ledger: DataFrame,
    learners: DataFrame,
    enrollments: DataFrame,
    progress: DataFrame,
    plan: DataFrame,
    paths: DataFrame,
    as_of: Column,
    now: Column,
) -> LearnerRun:
    """One batch of the learner pipeline."""
    return process_validated_learners(
        validate_learners(inbox, ledger), learners, enrollments, progress, plan, paths, as_of, now
    )
