"""Data-quality and acceptance reports: one row per check with its status and values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.operators.keyed import duplicate_keys
from studyflow.plans.schedule import incomplete_paths


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _status(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


# --- Invariants -----------------------------------------------------------------------------------


def orphans(progress: DataFrame, enrollments: DataFrame, topics: DataFrame) -> DataFrame:
    """Progress rows whose enrollment or topic does not exist."""
    e = enrollments.select("enrollment_id", F.lit(True).alias("_e"))
    t = topics.select("topic_id", F.lit(True).alias("_t"))
    return (
        progress.select("enrollment_id", "topic_id")
        .join(F.broadcast(t), "topic_id", "left")
        .join(e, "enrollment_id", "left")
        .filter(F.col("_e").isNull() | F.col("_t").isNull())
        .select(
            "enrollment_id",
            "topic_id",
            F.col("_e").isNull().alias("no_enrollment"),
            F.col("_t").isNull().alias("no_topic"),
        )
    )


def idle_learners(learners: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Active learners without an active enrollment."""
    active = (
        enrollments.filter(F.col("enrollment_status") == "ACTIVE").select("learner_id").distinct()
    )
    return learners.filter("active_flag").join(active, "learner_id", "left_anti").select(
        "learner_id", "employee_id"
    )


def path_mismatch(learners: DataFrame, enrollments: DataFrame, paths: DataFrame) -> DataFrame:
    """Enrollments on a path of another level than the learner's."""
    levels = paths.select("path_id", F.col("experience_level_code").alias("path_level_code"))
    return (
        enrollments.select("enrollment_id", "learner_id", "path_id")
        .join(F.broadcast(levels), "path_id")
        .join(learners.select("learner_id", "experience_level_code"), "learner_id")
        .filter("experience_level_code <> path_level_code")
        .select(
            "enrollment_id", "learner_id", "path_id", "experience_level_code", "path_level_code"
        )
    )


def incomplete_enrollments(
    enrollments: DataFrame, progress: DataFrame, plan: DataFrame
) -> DataFrame:
    """Active enrollments whose topic count differs from the required topics of their path."""
    wanted = (
        plan.filter("required_flag").groupBy("path_id").agg(F.count(F.lit(1)).alias("_wanted"))
    )
    held = progress.groupBy("enrollment_id").agg(F.count("topic_id").alias("_held"))
    return (
        enrollments.filter(F.col("enrollment_status") == "ACTIVE")
        .select("enrollment_id", "path_id")
        .join(held, "enrollment_id", "left")
        .join(F.broadcast(wanted), "path_id", "left")
        .select(
            "enrollment_id",
            "path_id",
            F.coalesce("_held", F.lit(0)).alias("assigned_topics"),
            F.coalesce("_wanted", F.lit(0)).alias("required_topics"),
        )
        .filter("assigned_topics <> required_topics")
    )


def _progress_findings(
    progress: DataFrame, enrollments: DataFrame, topics: DataFrame, plan: DataFrame
) -> DataFrame:
    """Bad values, orphans and incomplete enrollments from one pass over progress.

    Progress is reduced to a row per enrollment before it meets the enrollments.
    """
    t = topics.select("topic_id", F.lit(True).alias("_t"))
    wrong = (
        (F.col("completion_percent") < 0)
        | (F.col("completion_percent") > 100)
        | (F.col("hours_spent") < 0)
    )
    per_enrollment = (
        progress.select("enrollment_id", "topic_id", "completion_percent", "hours_spent")
        .join(F.broadcast(t), "topic_id", "left")
        .groupBy("enrollment_id")
        .agg(
            F.count(F.lit(1)).alias("_held"),
            F.count_if(wrong).alias("_wrong"),
            F.count_if(F.col("_t").isNull()).alias("_no_topic"),
        )
    )
    wanted = (
        plan.filter("required_flag").groupBy("path_id").agg(F.count(F.lit(1)).alias("_wanted"))
    )
    joined = (
        enrollments.select("enrollment_id", "path_id", "enrollment_status", F.lit(True).alias("_e"))
        .join(per_enrollment, "enrollment_id", "full_outer")
        .join(F.broadcast(wanted), "path_id", "left")
    )
    zero = F.lit(0)
    short = F.coalesce("_held", zero) != F.coalesce("_wanted", zero)
    return joined.agg(
        F.coalesce(F.sum("_wrong"), zero).alias("wrong"),
        F.coalesce(
            F.sum(F.when(F.col("_e").isNull(), F.col("_held")).otherwise(F.col("_no_topic"))), zero
        ).alias("orphans"),
        F.count_if(F.col("_e") & (F.col("enrollment_status") == "ACTIVE") & short).alias(
            "incomplete"
        ),
    )


def _zero_check(found: DataFrame, name: str, expected: str, count: str | None = None) -> DataFrame:
    n = F.col(count) if count else F.count(F.lit(1))
    counted = found.select(n.alias("_n")) if count else found.agg(n.alias("_n"))
    return counted.select(
        F.lit(name).alias("test_name"),
        _status(F.col("_n") == 0).alias("test_status"),
        F.col("_n").cast("string").alias("actual_value"),
        F.lit(expected).alias("expected_value"),
    )


def quality_report(t: dict[str, DataFrame]) -> DataFrame:
    """Twelve PASS/FAIL checks over the tables in ``t``, ordered by name.

    Keys: domains, paths, plan, topics, progress, enrollments, learners, assessments.
    """
    weights = t["domains"].filter("active_flag").agg(F.sum("exam_weight_percent").alias("_w"))
    active_paths = (
        t["paths"]
        .filter(F.col("active_flag") & (F.col("certification_id") == T.CERTIFICATION_ID))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    weeks = (
        t["plan"]
        .join(F.broadcast(t["paths"].select("path_id", "duration_weeks")), "path_id")
        .filter("planned_week < 1 or planned_week > duration_weeks")
    )
    scores = t["assessments"].filter("score_percent < 0 or score_percent > 100")
    found = _progress_findings(t["progress"], t["enrollments"], t["topics"], t["plan"])
    three = found.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), F.col(c).alias("n"), F.lit(text).alias("e"))
                    for name, c, text in (
                        ("05_VALID_PROGRESS_VALUES", "wrong", "0 invalid progress rows"),
                        ("06_NO_ORPHAN_TOPIC_PROGRESS", "orphans", "0 orphan rows"),
                        (
                            "10_ACTIVE_ENROLLMENT_TOPIC_COUNT",
                            "incomplete",
                            "0 incomplete enrollments",
                        ),
                    )
                ]
            )
        ).alias("c")
    ).select(
        F.col("c.name").alias("test_name"),
        _status(F.col("c.n") == 0).alias("test_status"),
        F.col("c.n").cast("string").alias("actual_value"),
        F.col("c.e").alias("expected_value"),
    )
    # The names of the checks and the texts of what they expect.
    checks = [
        weights.select(
            F.lit("01_DOMAIN_WEIGHTS_TOTAL").alias("test_name"),
            _status(F.col("_w") == 100).alias("test_status"),
            F.col("_w").cast("decimal(7,2)").cast("string").alias("actual_value"),
            F.lit("100").alias("expected_value"),
        ),
        active_paths.select(
            F.lit("02_ACTIVE_LEARNING_PATH_COUNT").alias("test_name"),
            _status(F.col("_n") == 4).alias("test_status"),
            F.col("_n").cast("string").alias("actual_value"),
            F.lit("4").alias("expected_value"),
        ),
        _zero_check(
            incomplete_paths(t["paths"], t["plan"], t["topics"]),
            "03_PATH_TOPIC_COMPLETENESS",
            "0 incomplete paths",
        ),
        _zero_check(weeks, "04_VALID_PLANNED_WEEKS", "0 invalid schedule rows"),
        three,
        _zero_check(
            duplicate_keys(t["learners"], "employee_id"),
            "07_NO_DUPLICATE_LEARNERS",
            "0 duplicate employee IDs",
        ),
        _zero_check(
            duplicate_keys(t["enrollments"], "learner_id", "certification_id"),
            "08_NO_DUPLICATE_ENROLLMENTS",
            "0 duplicate enrollments",
        ),
        _zero_check(scores, "09_VALID_ASSESSMENT_SCORES", "0 invalid assessments"),
        _zero_check(
            path_mismatch(t["learners"], t["enrollments"], t["paths"]),
            "11_EXPERIENCE_PATH_MATCH",
            "0 mismatched enrollments",
        ),
        _zero_check(
            idle_learners(t["learners"], t["enrollments"]),
            "12_ACTIVE_LEARNERS_HAVE_ENROLLMENT",
            "0 learners without enrollment",
        ),
    ]
    return _stack(checks).orderBy("test_name")


# --- Acceptance -----------------------------------------------------------------------------------

# What each acceptance check states.
DESCRIPTIONS = {
    "TC-001": "Three demo learners were registered",
    "TC-002": "Each demo learner has an active enrollment",
    "TC-003": "Experience-based learning paths were assigned correctly",
    "TC-004": "Each demo learner has 31 initialized topics",
    "TC-005": "Learner source records were processed successfully",
    "TC-006": "Progress source records were processed successfully",
    "TC-007": "Intentional invalid records were rejected",
    "TC-008": "Corrected rejected records are marked resolved",
    "TC-009": "No duplicate demo employee IDs exist",
    "TC-010": "No duplicate demo activity IDs exist",
}


def _acceptance(counted: DataFrame, test_id: str, text: str, expected: Column, unit: str) -> DataFrame:
    """One acceptance row from a one-row frame with columns ``n`` (found) and ``want``."""
    return counted.select(
        F.lit(test_id).alias("test_id"),
        F.lit(text).alias("test_description"),
        expected.alias("expected_result"),
        F.concat(F.col("n").cast("string"), F.lit(unit)).alias("actual_result"),
        _status(F.col("n") == F.col("want")).alias("test_status"),
    )


def acceptance_report(
    t: dict[str, DataFrame],
    expected_learners: DataFrame,
    learner_ids: DataFrame,
    activity_ids: DataFrame,
    rejected_ids: DataFrame,
    outcomes: Sequence[tuple[str, str, str, str, str, str] | tuple[DataFrame, str]],
    topics_each: int = 31,
    descriptions: dict[str, str] | None = None,
) -> DataFrame:
    """Acceptance checks over chosen keys.

    ``expected_learners``: employee_id, path_id. ``learner_ids``, ``activity_ids`` (accepted) and
    ``rejected_ids``: source_record_id. ``outcomes``: (employee, topic, status, percent, hours,
    description) of the final checks, one row each; or a frame of one row (enrollment_id, topic_id, status, percent,
    hours) that says what must be found, and the description. Keys of ``t``: learners, enrollments, progress,
    ledger, rejects, events.
    """
    texts = DESCRIPTIONS | (descriptions or {})
    chosen = t["learners"].join(
        expected_learners.select("employee_id", F.col("path_id").alias("want_path")), "employee_id"
    ).select("employee_id", "learner_id", "want_path")
    enrolled = chosen.join(
        t["enrollments"].select("learner_id", "enrollment_id", "path_id", "enrollment_status"),
        "learner_id",
    )
    held = t["progress"].groupBy("enrollment_id").agg(F.count("topic_id").alias("_held"))
    complete = (
        enrolled.join(held, "enrollment_id")
        .groupBy("employee_id")
        .agg(F.sum("_held").alias("_held"))
        .filter(F.col("_held") == topics_each)
    )
    # Ids repeat among rejects and events, so they are counted per id before they meet other tables.
    rejected = (
        t["rejects"]
        .groupBy("source_record_id")
        .agg(F.count(F.lit(1)).alias("_rows"), F.count_if("resolved_flag").alias("_resolved"))
        .join(rejected_ids.select("source_record_id"), "source_record_id", "left_semi")
    )
    repeated_events = duplicate_keys(t["events"], "event_id").join(
        activity_ids.select(F.col("source_record_id").alias("event_id")), "event_id", "left_semi"
    )

    def counted(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"))

    def beside(found: DataFrame, keys: DataFrame) -> DataFrame:
        """The number found beside the number of expected keys: two single rows."""
        want = keys.agg(F.count(F.lit(1)).alias("want"))
        return found.join(F.broadcast(want), how="cross")

    def among(found: DataFrame, keys: DataFrame) -> DataFrame:
        return beside(counted(found), keys)

    def total(name: str) -> DataFrame:
        return rejected.agg(F.coalesce(F.sum(name), F.lit(0)).alias("n"))

    def in_ledger(ids: DataFrame, pipeline: str) -> DataFrame:
        accepted = t["ledger"].filter(F.col("pipeline_name") == pipeline)
        found = accepted.join(ids.select("source_record_id"), "source_record_id", "left_semi")
        return among(found, ids)

    def none_of(found: DataFrame) -> DataFrame:
        return counted(found).withColumn("want", F.lit(0))

    rows = {
        "TC-001": (among(chosen, expected_learners), ""),
        "TC-002": (
            among(enrolled.filter("enrollment_status = 'ACTIVE'"), expected_learners), "",
        ),
        "TC-003": (
            among(enrolled.filter("path_id = want_path"), expected_learners),
            " correct path assignments",
        ),
        "TC-004": (among(complete, expected_learners), f" learners with {topics_each} topics"),
        "TC-005": (in_ledger(learner_ids, T.LEARNERS_PIPELINE), ""),
        "TC-006": (in_ledger(activity_ids, T.ACTIVITY_PIPELINE), ""),
        "TC-007": (beside(total("_rows"), rejected_ids), ""),
        "TC-008": (beside(total("_resolved"), rejected_ids), ""),
        "TC-009": (none_of(duplicate_keys(chosen, "employee_id")), " duplicate employee IDs"),
        "TC-010": (none_of(repeated_events), " duplicate activity IDs"),
    }
    checks = [
        _acceptance(
            found, test_id, texts[test_id], F.concat(F.col("want").cast("string"), F.lit(unit)), unit
        )
        for test_id, (found, unit) in rows.items()
    ]
    for number, outcome in enumerate(outcomes, start=11):
        check = _outcome_check if isinstance(outcome[0], str) else _derived_outcome_check
        checks.append(check(t, f"TC-{number:03d}", *outcome))
    return _stack(checks).orderBy("test_id")


def _outcome_check(
    t: dict[str, DataFrame],
    test_id: str,
    employee: str,
    topic: str,
    status: str,
    percent: str,
    hours: str,
    text: str,
) -> DataFrame:
    """Final status, percent and hours of one employee and topic."""
    rows = (
        t["learners"].filter(F.col("employee_id") == employee).select("learner_id")
        .join(t["enrollments"].select("learner_id", "enrollment_id"), "learner_id")
        .join(t["progress"].filter(F.col("topic_id") == topic), "enrollment_id")
    )
    shown = F.concat_ws(
        " / ",
        F.col("progress_status"),
        F.col("completion_percent").cast("string"),
        F.concat(F.col("hours_spent").cast("string"), F.lit(" hours")),
    )
    right = (
        (F.col("progress_status") == status)
        & (F.col("completion_percent") == F.lit(percent).cast("decimal(5,2)"))
        & (F.col("hours_spent") == F.lit(hours).cast("decimal(7,2)"))
    )
    return rows.agg(
        F.max(shown).alias("_shown"), F.count_if(right).alias("_right")
    ).select(
        F.lit(test_id).alias("test_id"),
        F.lit(text).alias("test_description"),
        F.lit(f"{status} / {percent} / {hours} hours").alias("expected_result"),
        F.coalesce("_shown", F.lit("No result")).alias("actual_result"),
        _status(F.col("_right") == 1).alias("test_status"),
    )


def _derived_outcome_check(t: dict[str, DataFrame], test_id: str, expected: DataFrame, text: str) -> DataFrame:
    """Final status, percent and hours of the enrollment and topic that ``expected`` (one row) names."""
    keys = ["enrollment_id", "topic_id"]
    # Progress meets the one row first: as the inner side of a left join it might be broadcast whole.
    named = t["progress"].join(F.broadcast(expected.select(*keys)), keys, "left_semi")
    found = expected.join(named, keys, "left")

    def shown(status: str, percent: str, hours: str) -> Column:
        return F.concat_ws(
            " / ",
            F.col(status),
            F.col(percent).cast("decimal(5,2)").cast("string"),
            F.concat(F.col(hours).cast("decimal(7,2)").cast("string"), F.lit(" hours")),
        )

    return found.select(
        F.lit(test_id).alias("test_id"),
        F.lit(text).alias("test_description"),
        shown("status", "percent", "hours").alias("expected_result"),
        F.when(F.col("progress_status").isNull(), "No result")
        .otherwise(shown("progress_status", "completion_percent", "hours_spent"))
        .alias("actual_result"),
    ).withColumn("test_status", _status(F.col("expected_result") == F.col("actual_result")))
