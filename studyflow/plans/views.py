"""Progress by learner and domain, weighted progress and exam readiness.

All of them start from one base with a row per enrollment: progress is shuffled once, by enrollment,
and never expanded to enrollment x planned topic. A planned topic without a progress row contributes
nothing to a sum, so counts and means come from the progress that exists and the number of topics
planned for the path and domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow.functions.scalars import (
    from_hundredths,
    half_up,
    hundredths,
    weeks_between,
)
from studyflow.operators.keyed import latest_by

ENROLLMENT = [
    "enrollment_id", "learner_id", "certification_id", "path_id", "enrollment_status",
    "enrolled_date", "target_completion_date", "target_exam_date",
]
NO_DOMAIN = ""


def planned_progress(enrollments: DataFrame, plan: DataFrame, progress: DataFrame) -> DataFrame:
    """Every planned topic of every enrollment with its progress or the defaults."""
    planned = enrollments.select("enrollment_id", "path_id").join(
        F.broadcast(plan.select("path_id", "topic_id")), "path_id"
    )
    return planned.join(progress, ["enrollment_id", "topic_id"], "left").select(
        "enrollment_id",
        "path_id",
        "topic_id",
        F.coalesce("progress_status", F.lit("NOT_STARTED")).alias("progress_status"),
        F.coalesce("completion_percent", F.lit(0)).cast("decimal(5,2)").alias(
            "completion_percent"
        ),
        F.coalesce("hours_spent", F.lit(0)).cast("decimal(7,2)").alias("hours_spent"),
    )


def plan_domains(plan: DataFrame, topics: DataFrame, domains: DataFrame) -> DataFrame:
    """Plan rows with the domain of their topic (null when the topic or domain is missing)."""
    known = topics.select("topic_id", "domain_id").join(
        F.broadcast(domains.select("domain_id")), "domain_id"
    )
    return plan.select("path_id", "topic_id").join(F.broadcast(known), "topic_id", "left")


def progress_base(enrollments: DataFrame, placed_plan: DataFrame, progress: DataFrame) -> DataFrame:
    """Per enrollment: totals over planned topics and the same sums per domain as a map.

    A path has at most a hundred domains, so the map is bounded.
    """
    facts = progress.select(
        "enrollment_id",
        "topic_id",
        "progress_status",
        hundredths(F.col("completion_percent")).alias("_percent"),
        hundredths(F.col("hours_spent")).alias("_hours"),
    )
    planned = placed_plan.select(
        "path_id",
        "topic_id",
        F.coalesce("domain_id", F.lit(NO_DOMAIN)).alias("_domain"),
        F.lit(True).alias("_planned"),
    )
    rows = (
        enrollments.select(*ENROLLMENT)
        .join(facts, "enrollment_id", "left")
        .join(F.broadcast(planned), ["path_id", "topic_id"], "left")
    )

    def counted(condition: Column) -> Column:
        return F.count_if(F.col("_planned") & condition)

    def summed(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_planned"), F.col(name))), F.lit(0))

    status = F.col("progress_status")
    per_domain = rows.groupBy(*ENROLLMENT, F.coalesce("_domain", F.lit(NO_DOMAIN)).alias("_d")).agg(
        counted(status == "COMPLETED").alias("completed"),
        counted(status == "IN_PROGRESS").alias("in_progress"),
        counted(status.isNotNull() & (status != "NOT_STARTED")).alias("begun"),
        summed("_percent").alias("percent"),
        summed("_hours").alias("hours"),
    )
    sums = ["completed", "in_progress", "begun", "percent", "hours"]
    return per_domain.groupBy(*ENROLLMENT).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.map_from_entries(
            F.collect_list(F.struct("_d", F.struct("completed", "percent", "hours")))
        ).alias("by_domain"),
    )


def path_totals(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """Path attributes with the number of planned topics; paths without a plan are left out."""
    totals = plan.groupBy("path_id").agg(F.count("topic_id").alias("total_topics"))
    return paths.select("path_id", "path_name", "duration_weeks", "weekly_study_hours").join(
        totals, "path_id"
    )


def learner_progress_from(
    base: DataFrame, learners: DataFrame, paths: DataFrame, plan: DataFrame, as_of: Column
) -> DataFrame:
    people = learners.select(
        "learner_id", "learner_name", "department_name", "snowflake_experience_years",
        "experience_level_code",
    )
    week = F.least(
        F.col("duration_weeks").cast("bigint"),
        F.greatest(F.lit(1).cast("bigint"), weeks_between(F.col("enrolled_date"), as_of) + 1),
    )
    carried = [
        c
        for c in base.columns
        if c == "weighted_learning_progress" or c.startswith("latest_assessment_")
    ]
    return (
        base.join(F.broadcast(path_totals(paths, plan)), "path_id")
        .join(people, "learner_id")
        .select(
            *people.columns,
            "enrollment_id", "certification_id", "enrollment_status", "enrolled_date",
            "target_completion_date", "target_exam_date",
            "path_id", "path_name", "duration_weeks", "weekly_study_hours",
            "total_topics",
            F.col("completed").alias("completed_topics"),
            F.col("in_progress").alias("in_progress_topics"),
            (F.col("total_topics") - F.col("begun")).alias("not_started_topics"),
            from_hundredths(half_up(F.col("percent"), F.col("total_topics")), 5).alias(
                "overall_completion_percent"
            ),
            from_hundredths(F.col("hours"), 12).alias("total_hours_spent"),
            week.alias("current_study_week"),
            F.datediff("target_completion_date", as_of).alias("days_to_target_completion"),
            *carried,
        )
    )


def learner_progress(
    learners: DataFrame,
    enrollments: DataFrame,
    paths: DataFrame,
    plan: DataFrame,
    progress: DataFrame,
    as_of: Column,
) -> DataFrame:
    """One row per enrollment: topic counts, mean completion, hours, study week, days to target."""
    placed_plan = plan.select("path_id", "topic_id", F.lit(NO_DOMAIN).alias("domain_id"))
    base = progress_base(enrollments, placed_plan, progress).drop("by_domain")
    return learner_progress_from(base, learners, paths, plan, as_of)


def path_domains(placed_plan: DataFrame, domains: DataFrame) -> DataFrame:
    """Planned topics per path and domain, with the domain's attributes."""
    named = domains.select("domain_id", "domain_name", "domain_order", "exam_weight_percent")
    return (
        placed_plan.groupBy("path_id", "domain_id")
        .agg(F.count("topic_id").alias("total_domain_topics"))
        .join(F.broadcast(named), "domain_id")
    )


def _domain_sum(name: str) -> Column:
    return F.coalesce(
        F.col("by_domain")[F.col("domain_id")][name], F.lit(0).cast("bigint")
    )


def weighted_share(percent: Column, weight: Column, topics: Column) -> Column:
    """Hundredths of mean completion x weight / 100, rounded half-up."""
    return half_up(percent * hundredths(weight), topics * 10000)


def domain_progress(
    enrollments: DataFrame,
    plan: DataFrame,
    topics: DataFrame,
    domains: DataFrame,
    progress: DataFrame,
) -> DataFrame:
    """One row per enrollment and domain of its path."""
    placed_plan = plan_domains(plan, topics, domains)
    base = progress_base(enrollments, placed_plan, progress)
    return domain_progress_from(base, placed_plan, domains)


def domain_progress_from(base: DataFrame, placed_plan: DataFrame, domains: DataFrame) -> DataFrame:
    topics_n = F.col("total_domain_topics")
    return base.join(F.broadcast(path_domains(placed_plan, domains)), "path_id").select(
        "enrollment_id", "learner_id", "path_id",
        "domain_id", "domain_name", "domain_order", "exam_weight_percent",
        "total_domain_topics",
        _domain_sum("completed").alias("completed_domain_topics"),
        from_hundredths(half_up(_domain_sum("percent"), topics_n), 5).alias(
            "domain_completion_percent"
        ),
        from_hundredths(
            weighted_share(_domain_sum("percent"), F.col("exam_weight_percent"), topics_n), 5
        ).alias("weighted_progress_contribution"),
        from_hundredths(_domain_sum("hours"), 12).alias("domain_hours_spent"),
    )


def weighted_progress(domain_view: DataFrame) -> DataFrame:
    """Sum of the already rounded domain shares per enrollment."""
    return domain_view.groupBy("enrollment_id").agg(
        F.sum("weighted_progress_contribution")
        .cast("decimal(7,2)")
        .alias("weighted_learning_progress")
    )


def latest_assessment(assessments: DataFrame) -> DataFrame:
    """Newest whole-exam result per enrollment; equal times go to the higher assessment id."""
    whole = assessments.filter(F.col("domain_id").isNull())
    newest = [F.desc("attempted_at"), F.desc("assessment_id")]
    return latest_by(whole, ["enrollment_id"], newest).select(
        "enrollment_id",
        F.col("assessment_name").alias("latest_assessment_name"),
        F.col("assessment_type").alias("latest_assessment_type"),
        F.col("score_percent").alias("latest_assessment_score"),
        F.col("passed_flag").alias("latest_assessment_passed"),
        F.col("attempted_at").alias("latest_assessment_date"),
    )


READINESS_INPUT = [
    "learner_id", "learner_name", "department_name", "snowflake_experience_years",
    "experience_level_code", "enrollment_id", "path_id", "path_name", "enrollment_status",
    "target_completion_date", "target_exam_date", "overall_completion_percent",
    "completed_topics", "total_topics", "total_hours_spent",
]


def readiness_inputs(
    progress_view: DataFrame, weighted: DataFrame, latest: DataFrame
) -> DataFrame:
    """Progress with weighted progress and the latest assessment, where there are any."""
    zero = F.lit(0).cast("decimal(7,2)")
    return (
        progress_view.select(*READINESS_INPUT)
        .join(weighted, "enrollment_id", "left")
        .join(latest, "enrollment_id", "left")
        .withColumn("weighted_learning_progress", F.coalesce("weighted_learning_progress", zero))
    )


def fused_inputs(
    learners: DataFrame,
    enrollments: DataFrame,
    paths: DataFrame,
    plan: DataFrame,
    topics: DataFrame,
    domains: DataFrame,
    progress: DataFrame,
    assessments: DataFrame,
    as_of: Column,
) -> DataFrame:
    """``readiness_inputs`` with the weighted progress taken from the same base as the totals.

    The domains of a path travel with the path as a short array, so neither a second pass over
    progress nor a row per domain is needed.
    """
    placed_plan = plan_domains(plan, topics, domains)
    base = progress_base(enrollments, placed_plan, progress)
    assessed = base.join(latest_assessment(assessments), "enrollment_id", "left")
    weights = (
        path_domains(placed_plan, domains)
        .groupBy("path_id")
        .agg(
            F.collect_list(
                F.struct("domain_id", "total_domain_topics", "exam_weight_percent")
            ).alias("_domains")
        )
    )

    def share(d: Column) -> Column:
        percent = F.coalesce(
            F.col("by_domain")[d["domain_id"]]["percent"], F.lit(0).cast("bigint")
        )
        return weighted_share(percent, d["exam_weight_percent"], d["total_domain_topics"])

    total = F.aggregate(
        F.coalesce("_domains", F.array().cast(weights.schema["_domains"].dataType)),
        F.lit(0).cast("bigint"),
        lambda acc, d: acc + share(d),
    )
    latest = [c for c in assessed.columns if c.startswith("latest_")]
    weighted = assessed.join(F.broadcast(weights), "path_id", "left").withColumn(
        "weighted_learning_progress", from_hundredths(total, 7)
    )
    view = learner_progress_from(weighted.drop("by_domain", "_domains"), learners, paths, plan, as_of)
    return view.select(*READINESS_INPUT, "weighted_learning_progress", *latest)


def with_readiness_score(inputs: DataFrame) -> DataFrame:
    """Weighted progress, or 60 percent of it plus 40 percent of the latest score."""
    progress = hundredths(F.col("weighted_learning_progress"))
    score = hundredths(F.col("latest_assessment_score"))
    mixed = half_up(progress * 6 + score * 4, F.lit(10).cast("bigint"))
    return inputs.withColumn(
        "readiness_score",
        from_hundredths(F.when(score.isNull(), progress).otherwise(mixed), 7),
    )


def classify(df: DataFrame) -> DataFrame:
    """Readiness status and recommendation by threshold."""
    ready, score = F.col("readiness_score"), F.col("latest_assessment_score")
    # Statuses, recommendations and the thresholds 80, 75 and 65.
    status = (
        F.when(score.isNull() & (ready >= 80), "ASSESSMENT_REQUIRED")
        .when((ready >= 80) & (score >= 75), "READY")
        .when(ready >= 65, "ALMOST_READY")
        .when(ready > 0, "IN_PROGRESS")
        .otherwise("NOT_STARTED")
    )
    advice = (
        F.when(score.isNull(), "Complete a mock assessment to confirm readiness.")
        .when((ready >= 80) & (score >= 75), "Learner meets the internal readiness criteria.")
        .when(ready >= 65, "Continue revision and improve weaker domains.")
        .otherwise("Continue the assigned learning path.")
    )
    return df.withColumns({"readiness_status": status, "readiness_recommendation": advice})


def certification_readiness(
    learners: DataFrame,
    enrollments: DataFrame,
    paths: DataFrame,
    plan: DataFrame,
    topics: DataFrame,
    domains: DataFrame,
    progress: DataFrame,
    assessments: DataFrame,
    as_of: Column,
) -> DataFrame:
    inputs = fused_inputs(
        learners, enrollments, paths, plan, topics, domains, progress, assessments, as_of
    )
    return classify(with_readiness_score(inputs))


def enrollment_topics(enrollments: DataFrame, progress: DataFrame) -> DataFrame:
    """Assigned and untouched topics per enrollment; enrollments without progress show zero."""
    counted = progress.groupBy("enrollment_id").agg(
        F.count("topic_id").alias("assigned_topics"),
        F.count_if(F.col("progress_status") == "NOT_STARTED").alias("not_started_topics"),
    )
    joined = enrollments.select("enrollment_id", "path_id").join(counted, "enrollment_id", "left")
    return joined.na.fill(0, ["assigned_topics", "not_started_topics"])


def status_counts(progress: DataFrame) -> DataFrame:
    """Topics per status and enrollment."""
    status = F.col("progress_status")
    return progress.groupBy("enrollment_id").agg(
        F.count(F.lit(1)).alias("assigned_topics"),
        F.count_if(status == "COMPLETED").alias("completed_topics"),
        F.count_if(status == "IN_PROGRESS").alias("in_progress_topics"),
        F.count_if(status == "NOT_STARTED").alias("not_started_topics"),
    )
