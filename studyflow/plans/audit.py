"""Run log, ledger and reject reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow.operators.keyed import lookup

# Run messages and result texts.
RUN_MESSAGES = {
    "STUDY_TOPICS_PIPELINE": "Study-topic pipeline completed successfully",
    "LEARNER_INFORMATION": "Learner-information processing completed.",
    "LEARNER_PROGRESS": "Learner-progress processing completed.",
}
RESULT_TEXTS = {
    "STUDY_TOPICS_PIPELINE": ("Processed ", " rows. Valid: ", ", Rejected: ", ""),
    "LEARNER_INFORMATION": (
        "Learner pipeline completed. Received: ", ", accepted: ", ", rejected: ", ".",
    ),
    "LEARNER_PROGRESS": (
        "Progress pipeline completed. Received: ", ", accepted: ", ", rejected: ", ".",
    ),
}
FAILURE_TEXTS = {
    "LEARNER_INFORMATION": "Learner pipeline failed: ",
    "LEARNER_PROGRESS": "Progress pipeline failed: ",
}


def log_run(
    counts: DataFrame,
    pipeline: str,
    run_id: Column,
    started_at: Column,
    completed_at: Column,
    status: str = "SUCCESS",
    message: str | None = None,
) -> DataFrame:
    """The log row of one run, from its counts."""
    return counts.select(
        run_id.alias("run_id"),
        F.lit(pipeline).alias("pipeline_name"),
        started_at.cast("timestamp_ntz").alias("started_at"),
        completed_at.cast("timestamp_ntz").alias("completed_at"),
        F.lit(status).alias("run_status"),
        "records_received",
        "records_accepted",
        "records_rejected",
        F.lit(message or RUN_MESSAGES[pipeline]).alias("run_message"),
    )


def run_result(counts: DataFrame, pipeline: str) -> DataFrame:
    """The counts of one run with its result text."""
    head, accepted, rejected, tail = RESULT_TEXTS[pipeline]
    text = F.concat(
        F.lit(head), F.col("records_received").cast("string"),
        F.lit(accepted), F.col("records_accepted").cast("string"),
        F.lit(rejected), F.col("records_rejected").cast("string"),
        F.lit(tail),
    )
    return counts.withColumns({"pipeline_name": F.lit(pipeline), "run_result": text})


def latest_run(log: DataFrame, pipeline: str) -> DataFrame:
    """Newest run of a pipeline."""
    chosen = log.filter(F.col("pipeline_name") == pipeline)
    return chosen.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Rejects by pipeline and reason, the most recently seen reason first."""
    return (
        rejects.groupBy("pipeline_name", "rejection_reason")
        .agg(
            F.count(F.lit(1)).alias("reject_count"),
            F.max("rejected_at").alias("last_rejected_at"),
            F.count_if("resolved_flag").alias("resolved_count"),
        )
        .orderBy(F.desc("last_rejected_at"), "pipeline_name", "rejection_reason")
    )


def rejected_records(rejects: DataFrame) -> DataFrame:
    """All rejects, newest first."""
    return rejects.orderBy(F.desc("rejected_at"), "pipeline_name", "source_record_id")


def resolutions(rejects: DataFrame, accepted: DataFrame, pipeline: str, now: Column) -> DataFrame:
    """Rejects that are settled because their id has been accepted now (``accepted`` has the ids, one column).

    Only rejects of the pipeline that are still open are settled.
    """
    ids = accepted.toDF("source_record_id").distinct()
    return (
        rejects.where((F.col("pipeline_name") == pipeline) & ~F.col("resolved_flag"))
        .join(ids, "source_record_id", "left_semi")
        .select(
            "rejection_id", "source_record_id", "pipeline_name",
            now.cast("timestamp_ntz").alias("resolved_at"),
        )
    )


def with_resolutions(rejects: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rejects as the table shows them: resolved at the first resolution appended for them."""
    first = resolved.groupBy("rejection_id").agg(F.min("resolved_at").alias("_settled_at"))
    return rejects.join(first, "rejection_id", "left").select(
        *[
            (F.col(c) | F.col("_settled_at").isNotNull()).alias(c)
            if c == "resolved_flag"
            else F.coalesce(c, "_settled_at").alias(c)
            if c == "resolved_at"
            else F.col(c)
            for c in rejects.columns
        ]
    )


def resolve_rejects(rejects: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mark a reject resolved at the first acceptance of its id after the rejection.

    An id is accepted once per pipeline, so the ledger side is first reduced to one row per id; only
    rejects with an id can be resolved.
    """
    accepted = ledger.groupBy("pipeline_name", "source_record_id").agg(
        F.max("processed_at").alias("_accepted_at")
    )
    later = F.col("_accepted_at") > F.col("rejected_at")
    joined = lookup(rejects, accepted, ["pipeline_name", "source_record_id"], ["rejection_id"])
    return joined.select(
        *[
            F.coalesce(F.col(c) | later, F.col(c)).alias(c)
            if c == "resolved_flag"
            else F.coalesce(F.col(c), F.when(later, F.col("_accepted_at"))).alias(c)
            if c == "resolved_at"
            else F.col(c)
            for c in rejects.columns
        ]
    )
