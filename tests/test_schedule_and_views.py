from decimal import Decimal

import pytest
from fixtures import topic_table
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.plans import audit as AU
from studyflow.plans import checks as C
from studyflow.plans import schedule as S
from studyflow.plans import views as V
from studyflow.sources import reference

WEEKS = {
    "PATH_FRESHER": ([2, 3, 2, 3, 2, 3, 3, 2, 3, 2, 3, 3], "96.3"),
    "PATH_0_5": ([3, 3, 3, 3, 3, 3, 3, 3, 3, 4], "69.6"),
    "PATH_5_9": ([3, 4, 4, 4, 4, 4, 4, 4], "47.9"),
    "PATH_9_PLUS": ([5, 5, 5, 5, 5, 6], "30.0"),
}


@pytest.fixture(scope="module")
def plan(spark):
    return S.build_schedule(topic_table(spark), reference.paths(spark)).cache()


def test_schedule_of_31_topics(spark, plan):
    per_week = {}
    for r in plan.groupBy("path_id", "planned_week").count().orderBy("planned_week").collect():
        per_week.setdefault(r.path_id, []).append(r["count"])
    hours = {r.path_id: str(r.total_study_hours) for r in S.path_hours(plan).collect()}
    assert {p: (per_week[p], hours[p]) for p in per_week} == WEEKS
    first = plan.filter("path_id = 'PATH_FRESHER' and topic_id in ('D01_T01', 'D01_T02')")
    assert [str(r.recommended_hours) for r in first.orderBy("topic_id").collect()] == ["3.2", "4.8"]
    assert S.incomplete_paths(reference.paths(spark), plan, topic_table(spark)).count() == 0
    view = S.weekly_study_plan(
        reference.paths(spark), plan, topic_table(spark), reference.domains(spark)
    )
    assert S.study_plan(view, "PATH_9_PLUS").count() == 31


def test_positions_break_ties_by_id_and_skip_inactive(spark):
    rows = [("b", 1, True), ("a", 1, True), ("z", 2, False), ("c", 2, True)]
    topics = spark.createDataFrame(rows, "topic_id string, n int, active_flag boolean").select(
        "topic_id", F.lit(1).cast("decimal(5,1)").alias("estimated_hours"),
        F.col("n").cast("decimal(3,0)").alias("topic_order"), "active_flag",
    )
    got = S.with_position(topics).orderBy("topic_position").collect()
    assert [(r.topic_id, r.topic_position, r.total_topics) for r in got] == [
        ("a", 1, 3), ("b", 2, 3), ("c", 3, 3),
    ]


def test_study_week_counts_mondays(spark):
    from studyflow.functions.scalars import weeks_between

    cases = [("2026-09-27", "2026-09-28", 1), ("2026-09-28", "2026-10-04", 0), ("2026-09-21", "2026-10-05", 2)]
    for a, b, n in cases:
        got = spark.range(1).select(
            weeks_between(F.lit(a).cast("date"), F.lit(b).cast("date")).alias("w")
        ).first().w
        assert got == n


@pytest.mark.parametrize(
    "progress,score,status,advice",
    [
        ("80.00", None, "ASSESSMENT_REQUIRED", "Complete a mock"),
        ("90.00", "75.00", "READY", "Learner meets"),
        ("99.99", "74.99", "ALMOST_READY", "Continue revision"),
        ("65.00", None, "ALMOST_READY", "Complete a mock"),
        ("0.01", None, "IN_PROGRESS", "Complete a mock"),
        ("0.00", None, "NOT_STARTED", "Complete a mock"),
        ("0.00", "0.00", "NOT_STARTED", "Continue the assigned"),
    ],
)
def test_readiness_thresholds(spark, progress, score, status, advice):
    df = spark.createDataFrame(
        [(Decimal(progress), None if score is None else Decimal(score))],
        "weighted_learning_progress decimal(7,2), latest_assessment_score decimal(5,2)",
    )
    (r,) = V.classify(V.with_readiness_score(df)).collect()
    assert r.readiness_status == status and r.readiness_recommendation.startswith(advice)


def test_shares_are_rounded_before_they_are_summed(spark, plan):
    """Three 50-percent topics: every domain share is rounded, then the shares are added."""
    enrollments = spark.createDataFrame(
        [("E", "L", T.CERTIFICATION_ID, "PATH_9_PLUS", "ACTIVE")],
        "enrollment_id string, learner_id string, certification_id string, path_id string, "
        "enrollment_status string",
    ).select(
        "*",
        *[
            F.lit("2026-01-01").cast("date").alias(c)
            for c in ("enrolled_date", "target_completion_date", "target_exam_date")
        ],
    )
    progress = spark.createDataFrame(
        [("E", t, "IN_PROGRESS", Decimal(50), Decimal("1.25")) for t in ("D01_T01", "D02_T01", "D03_T01")]
        + [("E", "D09_T09", "COMPLETED", Decimal(100), Decimal(9))],
        "enrollment_id string, topic_id string, progress_status string, "
        "completion_percent decimal(5,2), hours_spent decimal(7,2)",
    )
    view = V.domain_progress(
        enrollments, plan, topic_table(spark), reference.domains(spark), progress
    )
    got = {
        r.domain_id: (
            r.total_domain_topics, str(r.domain_completion_percent),
            str(r.weighted_progress_contribution), str(r.domain_hours_spent),
        )
        for r in view.collect()
    }
    assert got == {
        "DOMAIN_01": (7, "7.14", "2.21", "1.25"),
        "DOMAIN_02": (7, "7.14", "1.50", "1.25"),
        "DOMAIN_03": (6, "8.33", "1.67", "1.25"),
        "DOMAIN_04": (6, "0.00", "0.00", "0.00"),
        "DOMAIN_05": (5, "0.00", "0.00", "0.00"),
    }
    (w,) = V.weighted_progress(view).collect()
    assert str(w.weighted_learning_progress) == "5.38"
    learners = spark.createDataFrame(
        [("L", "Name", "Dept", Decimal(12), "EXP_9_PLUS")],
        "learner_id string, learner_name string, department_name string, "
        "snowflake_experience_years decimal(4,1), experience_level_code string",
    )
    assessments = spark.createDataFrame([], T.ASSESSMENT_SCHEMA)
    as_of = F.lit("2026-01-15").cast("date")
    args = (learners, enrollments, reference.paths(spark), plan)
    (r,) = V.certification_readiness(
        *args, topic_table(spark), reference.domains(spark), progress, assessments, as_of
    ).collect()
    assert (str(r.weighted_learning_progress), str(r.overall_completion_percent)) == ("5.38", "4.84")
    (p,) = V.learner_progress(*args, progress, as_of).collect()
    assert (p.total_topics, p.in_progress_topics, p.not_started_topics) == (31, 3, 28)
    assert (p.current_study_week, p.days_to_target_completion) == (3, -14)
    report = C.incomplete_enrollments(enrollments, progress, plan).collect()
    assert [(x.assigned_topics, x.required_topics) for x in report] == [(4, 31)]


def test_rejects_resolve_only_after_a_later_acceptance(spark):
    def at(hour):
        return f"2026-01-01 {hour:02d}:00:00"

    rejects = spark.createDataFrame(
        [("r1", "P", "a", at(10)), ("r2", "P", "a", at(14)), ("r3", "Q", "a", at(10)), ("r4", "P", None, at(1))],
        "rejection_id string, pipeline_name string, source_record_id string, rejected_at string",
    ).select(
        "*", F.lit(False).alias("resolved_flag"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    ).withColumn("rejected_at", F.col("rejected_at").cast("timestamp_ntz"))
    ledger = spark.createDataFrame(
        [("P", "a", at(12))], "pipeline_name string, source_record_id string, processed_at string"
    ).withColumn("processed_at", F.col("processed_at").cast("timestamp_ntz"))
    resolved = AU.resolve_rejects(rejects, ledger).orderBy("rejection_id").collect()
    assert [r.resolved_flag for r in resolved] == [True, False, False, False]
    assert [str(r.resolved_at) for r in resolved] == ["2026-01-01 12:00:00", "None", "None", "None"]


def test_fanout_of_one_task_is_dealt_out(spark, plan):
    """Whatever is shuffled later can be split no finer than by the tasks that made it."""
    rows = spark.range(0, 2000, 1, 1).selectExpr(
        "concat('E', id) as enrollment_id", "'PATH_0_5' as path_id", "'ACTIVE' as enrollment_status"
    )
    per_task = [r["count"] for r in S.fanout(rows, plan).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 2000 * 31 and max(per_task) < 2000 * 31 // 16


def test_assignments_are_not_combined_before_their_shuffle(spark, folder, capsys):
    from studyflow.plans import progress as P
    from studyflow.sources.reference import empty_table

    assigned = f"{T.PROGRESS_SCHEMA}, applied_at timestamp_ntz, batch string, bucket int"
    rolled = f"{P.ROLLUP_SCHEMA}, applied_at timestamp_ntz, batch string, bucket int"
    for k, schema in enumerate((assigned, rolled)):
        empty_table(spark, schema).write.parquet(f"{folder}/{k}")
    P.from_logs(*[spark.read.parquet(f"{folder}/{k}") for k in range(2)]).explain()
    text = capsys.readouterr().out
    assert text.count("REPARTITION_BY_NUM") == 2 and text.count("ENSURE_REQUIREMENTS") == 0


def test_outcome_check_does_not_broadcast_progress(spark, capsys):
    expected = spark.createDataFrame(
        [("E7", "D01_T01", "COMPLETED", 100, 2)],
        "enrollment_id string, topic_id string, status string, percent int, hours int",
    )
    progress = spark.range(100).selectExpr(
        "concat('E', id) as enrollment_id", "'D01_T01' as topic_id", "'COMPLETED' as progress_status",
        "cast(100 as decimal(5,2)) as completion_percent", "cast(2 as decimal(7,2)) as hours_spent",
    )
    check = C._derived_outcome_check({"progress": progress}, "TC-011", expected, "found")
    assert [tuple(r)[2:] for r in check.collect()] == [("COMPLETED / 100.00 / 2.00 hours",) * 2 + ("PASS",)]
    check.explain()
    text = capsys.readouterr().out
    assert "LeftSemi" in text and text.index("LeftOuter") < text.index("LeftSemi")
    other = C._derived_outcome_check({"progress": progress.limit(0)}, "TC-011", expected, "found")
    assert [tuple(r)[3:] for r in other.collect()] == [("No result", "FAIL")]
