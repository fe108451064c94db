"""Weekly study schedules: every active topic spread over the weeks of every active path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyflow.functions.scalars import from_tenths, half_up, whole_div
from studyflow.operators.keyed import insert_missing, upsert
from studyflow.session import wide
from studyflow.tables import CERTIFICATION_ID


def with_position(topics: DataFrame) -> DataFrame:
    """Rank of each active topic by (order, id) and the number of active topics.

    Topic orders are whole numbers of at most three digits. Topics are counted per order value, the
    counts are summed in order (at most 999 rows), and topics are ranked inside their order value.
    """
    active = topics.filter("active_flag").select("topic_id", "estimated_hours", "topic_order")
    per_order = active.groupBy("topic_order").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_order.selectExpr(
        "topic_order",
        "sum(_n) over (order by topic_order) - _n as _before",
        "sum(_n) over () as total_topics",
    )
    inside = F.row_number().over(Window.partitionBy("topic_order").orderBy("topic_id"))
    return (
        active.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "topic_order")
        .select(
            "topic_id",
            "estimated_hours",
            "topic_order",
            (F.col("_before") + F.col("_inside")).alias("topic_position"),
            "total_topics",
        )
    )


def cross_paths(topics: DataFrame, paths: DataFrame) -> DataFrame:
    """Every active path of the certification with every topic; the paths are four broadcast rows."""
    chosen = paths.filter(
        F.col("active_flag") & (F.col("certification_id") == CERTIFICATION_ID)
    ).select("path_id", "duration_weeks", "weekly_study_hours")
    return topics.join(F.broadcast(chosen), how="cross")


def with_week(df: DataFrame) -> DataFrame:
    """Planned week: the topic's share of the path, rounded up, never beyond the last week."""
    weeks = F.col("duration_weeks").cast("bigint")
    total = F.col("total_topics")
    ceiling = whole_div(F.col("topic_position") * weeks + total - 1, total)
    return df.withColumn("planned_week", F.least(weeks, ceiling).cast("decimal(3,0)"))


def with_hours_share(df: DataFrame) -> DataFrame:
    """Weekly hours of the path shared out by topic hours within a week, to one decimal.

    A (path, week) group holds at most all topics, a bounded number (see ``plans.topics``).
    """
    tenths = (F.col("estimated_hours") * 10).cast("bigint")
    total = F.sum(tenths).over(Window.partitionBy("path_id", "planned_week"))
    share = half_up(F.col("weekly_study_hours").cast("bigint") * tenths * 10, F.col("_total"))
    return (
        df.withColumn("_total", total)
        .withColumn("recommended_hours", F.when(F.col("_total") != 0, from_tenths(share, 5)))
        .drop("_total")
    )


def build_schedule(topics: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, topic, planned week, recommended hours, required) for all active paths and topics."""
    return with_hours_share(with_week(cross_paths(with_position(topics), paths))).select(
        "path_id",
        "topic_id",
        "planned_week",
        "recommended_hours",
        F.lit(True).alias("required_flag"),
    )


def upsert_plan(plan: DataFrame, schedule: DataFrame, now: Column) -> DataFrame:
    return upsert(
        plan,
        schedule,
        ["path_id", "topic_id"],
        update=["planned_week", "recommended_hours", "required_flag"],
        on_update={"updated_at": now},
        on_insert={"created_at": now, "updated_at": now},
    )


def fanout(enrollments: DataFrame, plan: DataFrame) -> DataFrame:
    """(enrollment, topic) for active enrollments and the required topics of their path.

    Enrollments are dealt out before they are multiplied: a small file of them is one task, whose output a later shuffle
    could not split finer than by that task.
    """
    required = plan.filter("required_flag").select("path_id", "topic_id")
    return (
        enrollments.filter(F.col("enrollment_status") == "ACTIVE")
        .select("enrollment_id", "path_id")
        .repartition(wide(enrollments.sparkSession), "enrollment_id", "path_id")
        .join(F.broadcast(required), "path_id")
        .select("enrollment_id", "topic_id")
    )


def fresh_progress(pairs: DataFrame, now: Column) -> DataFrame:
    """Progress rows for topics nobody has touched yet."""
    return pairs.select(
        "enrollment_id",
        "topic_id",
        F.lit("NOT_STARTED").alias("progress_status"),
        F.lit(0).cast("decimal(5,2)").alias("completion_percent"),
        F.lit(0).cast("decimal(7,2)").alias("hours_spent"),
        *[
            F.lit(None).cast("timestamp_ntz").alias(c)
            for c in ("started_at", "completed_at", "last_activity_at")
        ],
        now.cast("timestamp_ntz").alias("updated_at"),
    )


def initialise_progress(
    progress: DataFrame, enrollments: DataFrame, plan: DataFrame, now: Column
) -> DataFrame:
    """Add the missing (enrollment, topic) rows of all active enrollments."""
    pairs = fanout(enrollments, plan)
    return insert_missing(progress, fresh_progress(pairs, now), ["enrollment_id", "topic_id"])


def weekly_study_plan(
    paths: DataFrame, plan: DataFrame, topics: DataFrame, domains: DataFrame
) -> DataFrame:
    """Path, week, domain and topic of every planned topic, active ones only."""
    p = paths.filter("active_flag").select(
        "path_id", "path_name", "experience_level_code", "duration_weeks", "weekly_study_hours"
    )
    t = topics.filter("active_flag").select(
        "topic_id", "domain_id", "topic_name", "topic_description",
        "difficulty_level", "estimated_hours", "topic_order",
    )
    d = domains.filter("active_flag").select(
        "domain_id", "domain_name", "domain_order", "exam_weight_percent"
    )
    return (
        plan.select("path_id", "topic_id", "planned_week", "recommended_hours", "required_flag")
        .join(F.broadcast(p), "path_id")
        .join(F.broadcast(t), "topic_id")
        .join(F.broadcast(d), "domain_id")
        .select(
            *p.columns,
            "planned_week", "recommended_hours", "required_flag",
            *d.columns,
            *[c for c in t.columns if c != "domain_id"],
        )
    )


def study_plan(plan_view: DataFrame, path_id: str) -> DataFrame:
    """One path's plan in reading order."""
    return plan_view.filter(F.col("path_id") == path_id).orderBy(
        "planned_week", "domain_order", "topic_order"
    )


def schedule_summary(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """Topics, first and last week per path."""
    per_path = plan.groupBy("path_id").agg(
        F.count("topic_id").alias("total_topics"),
        F.min("planned_week").alias("first_week"),
        F.max("planned_week").alias("last_week"),
    )
    named = paths.select("path_id", "path_name", "duration_weeks", "weekly_study_hours")
    return named.join(per_path, "path_id")


def path_hours(plan: DataFrame) -> DataFrame:
    """Topics, weeks and recommended hours per path."""
    return plan.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("total_topics"),
        F.min("planned_week").alias("first_week"),
        F.max("planned_week").alias("last_week"),
        F.sum("recommended_hours").cast("decimal(12,1)").alias("total_study_hours"),
    )


def incomplete_paths(paths: DataFrame, plan: DataFrame, topics: DataFrame) -> DataFrame:
    """Active paths whose number of planned topics is not the number of active topics."""
    chosen = paths.filter(
        F.col("active_flag") & (F.col("certification_id") == CERTIFICATION_ID)
    ).select("path_id")
    planned = plan.groupBy("path_id").agg(F.count("topic_id").alias("_n"))
    wanted = topics.filter("active_flag").agg(F.count(F.lit(1)).alias("active_topics"))
    return (
        chosen.join(planned, "path_id", "left")
        .join(F.broadcast(wanted), how="cross")
        .select("path_id", F.coalesce("_n", F.lit(0)).alias("planned_topics"), "active_topics")
        .filter("planned_topics <> active_topics")
    )
