"""Every operator as a query over the star-schema tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial, reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyflow import adapters as A
from studyflow import tables as T
from studyflow.functions.scalars import enrollment_key, learner_key
from studyflow.operators.keyed import (
    duplicate_keys,
    flag_duplicates,
    flag_existing,
    insert_missing,
)
from studyflow.operators.rules import ERROR, count_columns, counts_row, first_failure, raw_json, split, to_rejects
from studyflow.plans import activity as AC
from studyflow.plans import audit as AU
from studyflow.plans import checks as C
from studyflow.plans import deltas as D
from studyflow.plans import learners as L
from studyflow.plans import progress as P
from studyflow.plans import schedule as S
from studyflow.plans import topics as TP
from studyflow.plans import views as V
from studyflow.session import shared_dir
from studyflow.sources import inbox as IN
from studyflow.sources.fingerprints import load_unseen
from studyflow.sources.layout import clustered
from studyflow.sources.reference import empty_table
from studyflow.sources.store import Store, at_once
from studyflow.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LATER = "timestamp_ntz'2024-02-01'"


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        A.start_query()
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return fn


def later():
    return F.expr(LATER)


# --- Scans, sources, sinks ------------------------------------------------------------------------


def _write_inbox(df: DataFrame, cols: list[str], folder: str) -> str:
    df.select(*cols).write.option("header", True).csv(folder)
    return folder


def _plain_customers(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "customer").selectExpr(
        "concat('LRN-', c_custkey) as source_record_id",
        "concat('EMP-', c_custkey) as employee_id",
        "c_name as learner_name",
        "concat('user', c_custkey, '@example.com') as email",
        "c_mktsegment as department_name",
        "'1' as snowflake_experience_years",
        "c_custkey as k",
    )


@query
def inbox_csv_read(spark, sf):
    path = _write_inbox(
        A.learner_inbox(spark, sf), T.LEARNER_INBOX, shared_dir(spark, "inbox") + "/csv"
    )
    return IN.read_inbox(spark, path, T.LEARNER_INBOX).select(*T.LEARNER_INBOX)


@query
def inbox_row_number(spark, sf):
    """Row numbers of files that hold ascending customer keys: the distance from the first key."""
    base = shared_dir(spark, "inbox")
    rows = _plain_customers(spark, sf).repartitionByRange("k").sortWithinPartitions("k")
    _write_inbox(rows, T.LEARNER_INBOX, f"{base}/csv")
    IN.with_position(IN.read_inbox(spark, f"{base}/csv", T.LEARNER_INBOX)).write.parquet(
        f"{base}/rows"
    )
    numbered = IN.with_row_number(spark.read.parquet(f"{base}/rows")).withColumn(
        "k", F.expr("cast(substr(source_record_id, 5) as bigint)")
    )
    first = numbered.groupBy("source_file_name").agg(F.min("k").alias("first_key"))
    return numbered.join(first, "source_file_name").select(
        "source_record_id",
        (F.col("source_row_number") - 1 - (F.col("k") - F.col("first_key"))).alias("off_by"),
    )


@query
def inbox_strict_load(spark, sf):
    path = _write_inbox(
        _plain_customers(spark, sf), T.LEARNER_INBOX, shared_dir(spark, "inbox") + "/csv"
    )
    loaded = IN.read_inbox(spark, path, T.LEARNER_INBOX, strict=True)
    return loaded.groupBy("department_name").agg(F.count(F.lit(1)).alias("row_count"))


@query
def inline_reference_tables(spark, sf):
    people = A.people(spark, sf).groupBy("experience_level_code").agg(
        F.count(F.lit(1)).alias("learner_count")
    )
    return (
        A.levels(spark)
        .select(
            "experience_level_code", "experience_level_name", "min_years", "max_years",
            "recommended_weeks", "display_order",
        )
        .join(
            A.paths(spark).select(
                "experience_level_code", "path_id", "path_name", "duration_weeks",
                "weekly_study_hours",
            ),
            "experience_level_code",
        )
        .join(people, "experience_level_code", "left")
        .na.fill(0, ["learner_count"])
    )


@query
def inbox_incremental_read(spark, sf):
    """Two deliveries, the inbox drained twice after each: rows seen per batch."""
    base = shared_dir(spark, "incremental")
    rows = _plain_customers(spark, sf)

    def keep(df: DataFrame, batch_id: int) -> None:
        seen = df.select("department_name")
        seen.write.mode("overwrite").parquet(f"{base}/seen/round={batch_id + 1}")

    for condition in ("department_name < 'C'", "department_name >= 'C'"):
        rows.filter(condition).select(*T.LEARNER_INBOX).write.mode("append").option(
            "header", True
        ).csv(f"{base}/inbox")
        for _ in range(2):
            source = IN.stream_inbox(spark, f"{base}/inbox", T.LEARNER_INBOX)
            jobs.start(source, f"{base}/checkpoint", None, keep).awaitTermination()
    seen = spark.read.schema("department_name string, round bigint").parquet(f"{base}/seen")
    return seen.groupBy("round").agg(F.count(F.lit(1)).alias("new_rows"))


@query
def inbox_read_by_content(spark, sf):
    """Two deliveries, the second with copies of the first under other names: rows taken per round."""
    store = Store(spark, shared_dir(spark, "history"), buckets=1)
    rows, inbox = _plain_customers(spark, sf), f"{store.root}/inbox"
    taken = []
    for number, condition in ((1, "department_name < 'C'"), (2, "true")):
        # A file per department: those of the first delivery come again in the second.
        delivered = rows.filter(condition).select(*T.LEARNER_INBOX, F.col("department_name").alias("of"))
        delivered.repartition("of").write.mode("append").partitionBy("of").option("header", True).csv(inbox)
        fresh = load_unseen(store, inbox, T.LEARNER_INBOX, f"round-{number}", A.now())
        taken.append(
            fresh.groupBy("department_name").agg(F.count(F.lit(1)).alias("new_rows")).withColumn("round", F.lit(number))
        )
    return taken[0].unionByName(taken[1])


@query
def batch_snapshot(spark, sf):
    store = Store(spark, shared_dir(spark, "store"))
    frozen, _ = store.freeze(T.LEARNERS_PIPELINE, "1", lambda: A.validated_learners(spark, sf))
    again, _ = store.freeze(T.LEARNERS_PIPELINE, "1", lambda: frozen.limit(0))
    return (
        again.groupBy(F.coalesce(ERROR, F.lit("valid")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def _learner_rejects(spark, sf):
    _, rejected = split(A.validated_learners(spark, sf))
    return to_rejects(
        rejected, T.LEARNERS_PIPELINE, "source_record_id", T.LEARNER_INBOX, A.now()
    )


def _topic_rejects(spark, sf):
    _, rejected = split(A.validated_topics(spark, sf))
    return to_rejects(rejected, T.TOPICS_PIPELINE, "topic_id", T.TOPIC_INBOX, A.now())


@query
def raw_record_capture(spark, sf):
    """Rejects as the table keeps them, their fields read back from the stored variant by path."""
    store = Store(spark, shared_dir(spark, "store"), buckets=1)
    store.append("rejected_records", _learner_rejects(spark, sf).unionByName(_topic_rejects(spark, sf)), "1")
    of_topic = F.col("pipeline_name") == T.TOPICS_PIPELINE
    return store.read("rejected_records").select(
        "pipeline_name", "source_record_id", "source_file_name", "source_row_number",
        F.when(of_topic, raw_json(T.TOPIC_INBOX)).otherwise(raw_json(T.LEARNER_INBOX)).alias("raw_record"),
        "rejection_reason", "resolved_flag",
        F.length("rejection_id").cast("bigint").alias("rejection_id_length"),
    )


@query
def append_sink(spark, sf):
    store = Store(spark, shared_dir(spark, "store"))
    for batch in ("learners-1", "learners-1"):
        store.append("rejected_records", _learner_rejects(spark, sf), batch)
    store.append("rejected_records", _topic_rejects(spark, sf), "topics-1")
    return (
        store.read("rejected_records")
        .groupBy("pipeline_name", "rejection_reason")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


@query
def upsert_dimension(spark, sf):
    valid, _ = split(A.validated_topics(spark, sf))
    oldest = TP.latest_by(
        valid, ["topic_id"], [F.asc("ingested_at"), F.asc("source_file_name"), F.asc("source_row_number")]
    )
    target = oldest.filter("topic_id < 'D04'").select(
        "topic_id", "domain_id", "topic_name", "topic_description",
        F.upper(F.trim("difficulty_level")).alias("difficulty_level"),
        F.col("hours_value").alias("estimated_hours"),
        F.col("order_value").alias("topic_order"),
        F.lit(False).alias("active_flag"),
        A.now().alias("created_at"),
        A.now().alias("updated_at"),
    )
    source = TP.latest_topic_version(valid)
    return TP.upsert_topics(target, source, later())


@query
def upsert_protected(spark, sf):
    target = A.learners(spark, sf).withColumn("active_flag", F.lit(False))
    last = L.last_per_learner(A.placed_learners(spark, sf))
    return L.upsert_learners(target, last, A.as_of(), later())


@query
def insert_if_absent(spark, sf):
    touched = P.progress_fold(A.learning_events(spark, sf), "batch_day")
    fresh = A.initial_progress(spark, sf).drop("updated_at")
    return insert_missing(touched, fresh, P.KEYS)


@query
def upsert_accumulate(spark, sf):
    events = A.learning_events(spark, sf)
    early = events.filter("batch_day < date'2024-01-16'")
    state = P.progress_fold(early, "batch_day").withColumn("updated_at", A.now())
    batch = events.filter("batch_day >= date'2024-01-16'")
    return P.fold_progress(state, batch, later())


# --- Projections, filters, predicates -------------------------------------------------------------


@query
def normalize_learners(spark, sf):
    return L.normalize_learners(A.learner_inbox(spark, sf))


@query
def normalize_activity(spark, sf):
    return AC.normalize_activity(A.activity_inbox(spark, sf))


@query
def first_failure_reason(spark, sf):
    rows = L.normalize_learners(A.learner_inbox(spark, sf))
    return rows.select("source_row_number", first_failure(L.learner_rules()).alias("reason"))


@query
def validate_topics(spark, sf):
    return A.validated_topics(spark, sf).select(
        "source_row_number", "topic_id", "domain_id", "hours_value", "order_value", ERROR
    )


@query
def validate_learners(spark, sf):
    return A.validated_learners(spark, sf).select(
        "source_row_number", "source_record_id", "employee_id", "email", ERROR
    )


@query
def validate_activity(spark, sf):
    return A.validated_activity(spark, sf).select(
        "source_row_number", "activity_id", "employee_id", "topic_id",
        F.when(F.col(ERROR).isNull(), F.col("enrollment_id")).alias("enrollment_id"),
        ERROR,
    )


def _checked_calls(spark, sf):
    return AC.validate_direct(
        A.direct_calls(spark, sf), A.initial_progress(spark, sf), ["call_id"]
    )


@query
def validate_direct_activity(spark, sf):
    return _checked_calls(spark, sf).select(
        "call_id", F.col("final_percent").cast("bigint").alias("final_percent"), ERROR
    )


@query
def split_valid_rejected(spark, sf):
    valid, rejected = split(A.validated_activity(spark, sf))
    return reduce(
        DataFrame.unionByName,
        [
            side.agg(
                F.lit(name).alias("side"),
                F.count(F.lit(1)).alias("row_count"),
                F.coalesce(F.sum("source_row_number"), F.lit(0)).alias("row_number_sum"),
            )
            for name, side in (("valid", valid), ("rejected", rejected))
        ],
    )


@query
def experience_band(spark, sf):
    return A.people(spark, sf).select(
        "employee_id",
        "snowflake_experience_years",
        L.experience_band(F.col("snowflake_experience_years")).alias("experience_level_code"),
    )


def _calls(spark, sf):
    return A.learner_inbox(spark, sf).withColumn(
        "snowflake_experience_years", F.col("snowflake_experience_years").try_cast("decimal(4,1)")
    )


@query
def registration_checks(spark, sf):
    return _calls(spark, sf).select("source_row_number", L.registration_error().alias("failure"))


@query
def surrogate_keys(spark, sf):
    return A.learner_inbox(spark, sf).select(
        "source_row_number",
        learner_key(F.col("employee_id")).alias("learner_id"),
        enrollment_key(F.col("employee_id")).alias("enrollment_id"),
    )


@query
def target_dates(spark, sf):
    return A.people(spark, sf).select(
        "employee_id", "path_id", "target_completion_date", "target_exam_date"
    )


def _tables(spark, sf) -> dict[str, DataFrame]:
    return {
        "learners": A.learners(spark, sf),
        "enrollments": A.enrollments(spark, sf),
        "paths": A.paths(spark),
        "plan": A.plan(spark, sf),
        "topics": A.topics(spark, sf),
        "domains": A.domains(spark, sf),
        "progress": A.progress(spark, sf),
        "assessments": A.assessments(spark, sf),
    }


def _readiness(spark, sf):
    return V.certification_readiness(**_tables(spark, sf), as_of=A.as_of())


@query
def readiness_status(spark, sf):
    return _readiness(spark, sf).select(
        "enrollment_id", "readiness_status", "readiness_recommendation"
    )


# --- Joins ----------------------------------------------------------------------------------------


def _weekly(spark, sf):
    return S.weekly_study_plan(
        A.paths(spark), A.plan(spark, sf), A.topics(spark, sf), A.domains(spark, sf)
    )


@query
def weekly_study_plan(spark, sf):
    return _weekly(spark, sf)


@query
def progress_left_join(spark, sf):
    return V.planned_progress(
        A.enrollments(spark, sf), A.plan(spark, sf), A.progress(spark, sf)
    )


@query
def path_topic_cross(spark, sf):
    return S.cross_paths(A.topics(spark, sf).select("topic_id", "domain_id"), A.paths(spark))


@query
def assign_path(spark, sf):
    return A.people(spark, sf).select(
        "employee_id", "experience_level_code", "path_id", "duration_weeks"
    )


@query
def experience_level_range_join(spark, sf):
    rows = A.people(spark, sf).select("employee_id", "snowflake_experience_years")
    return L.band_by_range(rows, A.levels(spark))


@query
def domain_exists_filter(spark, sf):
    return TP.keep_known(A.topic_inbox(spark, sf), A.domains(spark, sf)).select(
        "source_row_number", "topic_id", "domain_id"
    )


@query
def already_processed(spark, sf):
    """Ids accepted before: the ledger lies in a store, whose filters name the batches that may hold an id."""
    store = Store(spark, shared_dir(spark, "store"), buckets=8)
    store.append("processed_records", A.learner_ledger(spark, sf), "earlier")
    rows = L.normalize_learners(A.learner_inbox(spark, sf))
    held = store.read_known("processed_records", rows.select("source_record_id"))
    ids = L.ledger_ids(held, T.LEARNERS_PIPELINE, "source_record_id")
    return flag_existing(rows, ids, ["source_record_id"], T.LINEAGE, "is_processed").select(
        "source_row_number", "source_record_id", "is_processed"
    )


@query
def event_id_exists(spark, sf):
    store = Store(spark, shared_dir(spark, "store"), buckets=8)
    earlier = empty_table(spark, T.EVENT_SCHEMA).unionByName(A.earlier_events(spark, sf), allowMissingColumns=True)
    store.append("learning_events", earlier, "earlier")
    rows = AC.normalize_activity(A.activity_inbox(spark, sf))
    known = store.read_known("learning_events", rows.select("activity_id")).select(F.col("event_id").alias("activity_id"))
    return flag_existing(rows, known, ["activity_id"], T.LINEAGE, "is_event").select(
        "source_row_number", "activity_id", "is_event"
    )


@query
def in_duplicate_keys(spark, sf):
    rows = A.line_inbox(spark, sf)
    flagged = flag_duplicates(
        rows, "source_record_id", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    )
    return flagged.select("source_record_id", "l_partkey", "l_suppkey", "is_duplicate")


@query
def topic_not_assigned(spark, sf):
    flagged = AC.flag_unassigned(
        A.direct_calls(spark, sf), A.initial_progress(spark, sf), ["call_id"]
    )
    return flagged.select("call_id", "enrollment_id", "topic_id", "is_unassigned")


@query
def resolve_active_enrollment(spark, sf):
    rows = AC.normalize_activity(A.activity_inbox(spark, sf))
    return AC.resolve_enrollment(
        rows, A.learners(spark, sf), A.order_enrollments(spark, sf)
    ).select("source_row_number", "employee_id", "enrollment_id")


@query
def resolve_active_enrollment_by_layout(spark, sf):
    """The same over learners and enrollments laid out by learner: no row of either is moved to be joined."""
    learners = A.learners(spark, sf).select("learner_id", "employee_id")
    learners, enrollments = at_once(
        [
            partial(clustered, learners, "learner_id", 16, "learners"),
            partial(clustered, A.order_enrollments(spark, sf), "learner_id", 16, "enrollments"),
        ]
    )
    rows = AC.normalize_activity(A.activity_inbox(spark, sf))
    return AC.resolve_enrollment(rows, learners, enrollments).select(
        "source_row_number", "employee_id", "enrollment_id"
    )


@query
def enrollment_topic_fanout(spark, sf):
    return S.fanout(A.enrollments(spark, sf), A.plan(spark, sf))


@query
def orphan_rows(spark, sf):
    lost = C.orphans(A.progress(spark, sf), A.enrollments(spark, sf), A.topics(spark, sf))
    idle = C.idle_learners(A.learners(spark, sf), A.enrollments(spark, sf))
    return lost.select(
        F.lit("progress").alias("kind"), F.col("enrollment_id").alias("key_1"),
        F.col("topic_id").alias("key_2"), "no_enrollment", "no_topic",
    ).unionByName(
        idle.select(
            F.lit("learner").alias("kind"), F.col("learner_id").alias("key_1"),
            F.col("employee_id").alias("key_2"), F.lit(True).alias("no_enrollment"),
            F.lit(False).alias("no_topic"),
        )
    )


@query
def experience_path_mismatch(spark, sf):
    a_year_later = L.experience_band(F.col("snowflake_experience_years") + 1)
    grown = A.learners(spark, sf).withColumn("experience_level_code", a_year_later)
    return C.path_mismatch(grown, A.enrollments(spark, sf), A.paths(spark))


def _progress_view(spark, sf, **given):
    t = _tables(spark, sf) | given
    return V.learner_progress(
        t["learners"], t["enrollments"], t["paths"], t["plan"], t["progress"], A.as_of()
    )


def _domain_view(spark, sf, **given):
    t = _tables(spark, sf) | given
    return V.domain_progress(
        t["enrollments"], t["plan"], t["topics"], t["domains"], t["progress"]
    )


@query
def readiness_join(spark, sf):
    progress = A.progress_table(spark, sf)
    return V.readiness_inputs(
        _progress_view(spark, sf, progress=progress),
        V.weighted_progress(_domain_view(spark, sf, progress=progress)),
        V.latest_assessment(A.assessments(spark, sf)),
    )


# --- Aggregations ---------------------------------------------------------------------------------


@query
def load_profile(spark, sf):
    return TP.load_profile(A.topic_inbox(spark, sf), "domain_id")


@query
def schedule_summary(spark, sf):
    return S.schedule_summary(A.paths(spark), A.plan(spark, sf))


@query
def path_hours_summary(spark, sf):
    return S.path_hours(A.plan(spark, sf))


@query
def enrollment_topic_summary(spark, sf):
    return V.enrollment_topics(A.enrollments(spark, sf), A.progress(spark, sf))


@query
def topic_status_counts(spark, sf):
    return V.status_counts(A.progress(spark, sf))


@query
def learner_progress(spark, sf):
    return _progress_view(spark, sf)


@query
def domain_progress(spark, sf):
    return _domain_view(spark, sf)


@query
def weighted_progress(spark, sf):
    return V.weighted_progress(_domain_view(spark, sf))


def _summed_store(spark, sf) -> Store:
    """The event log in three deliveries, rolled up day by day; the sums are renewed after each delivery."""
    store = _new_store(
        spark, sf, "learners", "enrollments", "topic_progress", "exam_domains", "learning_paths", "path_topic_plan"
    )
    store.load("study_topics", A.topics(spark, sf))
    D.update_sums(store, "sums-0", A.now())
    day = F.col("batch_day").cast("string")
    events = A.learning_events(spark, sf).withColumn("delivery", F.expr("day(batch_day) % 3"))
    for delivery in range(3):
        added = P.rollup(events.filter(F.col("delivery") == delivery), "batch_day")
        store.append("progress_rollups", added.withColumn("event_batch", day), day, A.now())
        D.update_sums(store, f"sums-{delivery + 1}", A.now())
    return store


@query
def learner_progress_by_deltas(spark, sf):
    return D.learner_progress(_summed_store(spark, sf), A.as_of())


@query
def domain_progress_by_deltas(spark, sf):
    return D.domain_progress(_summed_store(spark, sf))


@query
def weighted_progress_by_deltas(spark, sf):
    return D.weighted_progress(_summed_store(spark, sf))


@query
def activity_rollup(spark, sf):
    return P.rollup(A.learning_events(spark, sf))


@query
def duplicate_key_report(spark, sf):
    employees = duplicate_keys(A.learner_inbox(spark, sf), "employee_id")
    enrolled = duplicate_keys(A.order_enrollments(spark, sf), "learner_id", "certification_id")
    lines = duplicate_keys(A.line_inbox(spark, sf), "source_record_id")
    none = A.text_null()
    return reduce(
        DataFrame.unionByName,
        [
            employees.select(
                F.lit("employee").alias("check"), F.col("employee_id").alias("key_1"),
                none.alias("key_2"), "row_count",
            ),
            enrolled.select(
                F.lit("enrollment").alias("check"), F.col("learner_id").alias("key_1"),
                F.col("certification_id").alias("key_2"), "row_count",
            ),
            lines.select(
                F.lit("line").alias("check"), F.col("source_record_id").alias("key_1"),
                none.alias("key_2"), "row_count",
            ),
        ],
    )


QUERIES["duplicate_keys"] = QUERIES.pop("duplicate_key_report")


@query
def incomplete_paths(spark, sf):
    whole = A.plan(spark, sf)
    holed = whole.filter("not (path_id = 'PATH_0_5' and planned_week = 1) and path_id <> 'PATH_5_9'")
    return S.incomplete_paths(A.paths(spark), holed, A.topics(spark, sf))


@query
def incomplete_enrollments(spark, sf):
    touched = P.progress_fold(A.learning_events(spark, sf), "batch_day")
    return C.incomplete_enrollments(A.enrollments(spark, sf), touched, A.plan(spark, sf))


def _run_counts(spark, sf) -> dict[str, DataFrame]:
    """Counts of the three pipelines, observed while each validated batch is written: one scan of it, no job to count."""
    store = Store(spark, shared_dir(spark, "store"))
    batches = {
        T.TOPICS_PIPELINE: (A.validated_topics, TP.topic_count_columns()),
        T.LEARNERS_PIPELINE: (A.validated_learners, count_columns()),
        T.ACTIVITY_PIPELINE: (A.validated_activity, count_columns()),
    }
    return {
        name: counts_row(spark, store.freeze(name, "1", partial(validated, spark, sf), counts)[1])
        for name, (validated, counts) in batches.items()
    }


@query
def pipeline_run_counts(spark, sf):
    return reduce(
        DataFrame.unionByName,
        [
            AU.run_result(counts, name)
            for name, counts in _run_counts(spark, sf).items()
        ],
    )


@query
def readiness_score(spark, sf):
    return _readiness(spark, sf).select(
        "enrollment_id", "weighted_learning_progress", "latest_assessment_score", "readiness_score"
    )


# --- Windows --------------------------------------------------------------------------------------


@query
def latest_topic_version(spark, sf):
    valid, _ = split(A.validated_topics(spark, sf))
    return TP.latest_topic_version(valid)


@query
def topic_position(spark, sf):
    return S.with_position(A.topics(spark, sf))


@query
def planned_week(spark, sf):
    return S.with_week(S.cross_paths(S.with_position(A.topics(spark, sf)), A.paths(spark))).select(
        "path_id", "topic_id", "topic_position", "planned_week"
    )


@query
def weekly_hours_share(spark, sf):
    return A.plan(spark, sf)


@query
def latest_enrollment(spark, sf):
    return AC.latest_enrollment(A.learners(spark, sf), A.order_enrollments(spark, sf))


@query
def latest_assessment(spark, sf):
    return V.latest_assessment(A.assessments(spark, sf))


# --- Sorts, limits --------------------------------------------------------------------------------


@query
def study_plan_report(spark, sf):
    return S.study_plan(_weekly(spark, sf), "PATH_FRESHER")


@query
def progress_reports(spark, sf):
    return _readiness(spark, sf).orderBy("learner_id")


@query
def learner_progress_report(spark, sf):
    """Learner progress by learner."""
    return _progress_view(spark, sf).orderBy("learner_name", "enrollment_id")


@query
def domain_progress_report(spark, sf):
    """Domain progress by enrollment, domains in exam order."""
    return _domain_view(spark, sf).orderBy("enrollment_id", "domain_order")


@query
def run_log_report(spark, sf):
    """The run log, newest first."""
    return run_log(spark, sf).orderBy(F.desc("started_at"), "pipeline_name")


@query
def rejected_records_report(spark, sf):
    """Rejected learner rows, newest first."""
    _, rejected = split(A.validated_learners(spark, sf))
    rejects = to_rejects(
        rejected, T.LEARNERS_PIPELINE, "source_record_id", T.LEARNER_INBOX, A.now()
    )
    return AU.rejected_records(rejects).select(
        "pipeline_name", "source_record_id", "rejection_reason", "rejected_at"
    )


@query
def seed_reports(spark, sf):
    """Paths and levels in their display order, with the domains' number and weights and the learners of each."""
    weights = A.domains(spark, sf).agg(
        F.count(F.lit(1)).alias("domains"), F.sum("exam_weight_percent").alias("total_weight")
    )
    people = A.people(spark, sf).groupBy("path_id").agg(F.count(F.lit(1)).alias("learners"))
    levels = A.levels(spark).select("experience_level_code", "experience_level_name", "display_order")
    listed = (
        A.paths(spark)
        .select("path_id", "experience_level_code", "duration_weeks", "weekly_study_hours")
        .join(levels, "experience_level_code")
        .join(people, "path_id", "left")
        .na.fill(0, ["learners"])
        .withColumn("certification_id", F.lit(T.CERTIFICATION_ID))
    )
    totals = weights.withColumn("certification_id", F.lit(T.CERTIFICATION_ID))
    return listed.join(totals, "certification_id").orderBy("display_order")


def _daily_log(spark, sf):
    days = AC.normalize_activity(A.activity_inbox(spark, sf)).withColumn(
        ERROR, first_failure(AC.activity_rules())
    )
    days = days.join(
        A.table(spark, sf, "events").select(
            F.col("event_id").alias("source_row_number"), F.to_date("ts").alias("run_day")
        ),
        "source_row_number",
    )
    counts = days.groupBy("run_day").agg(
        F.count(F.lit(1)).alias("records_received"),
        F.count_if(F.col(ERROR).isNull()).alias("records_accepted"),
        F.count_if(F.col(ERROR).isNotNull()).alias("records_rejected"),
    )
    day = F.col("run_day").cast("timestamp_ntz")
    run_id = F.concat(F.lit("RUN_"), F.date_format("run_day", "yyyyMMdd"))
    return AU.log_run(counts, T.ACTIVITY_PIPELINE, run_id, day, day)


@query
def latest_run(spark, sf):
    return AU.latest_run(_daily_log(spark, sf), T.ACTIVITY_PIPELINE)


@query
def registration_order(spark, sf):
    return L.last_per_learner(A.placed_learners(spark, sf))


# --- Reports --------------------------------------------------------------------------------------


@query
def quality_report(spark, sf):
    return C.quality_report(_tables(spark, sf))


@query
def acceptance_report(spark, sf):
    """Acceptance over the customers with an active enrollment: registered, enrolled, recorded, rejected, resolved.

    What the pipelines accept and refuse is settled once; all they write goes to a store, and the report reads the
    store alone, progress included.
    """
    store = Store(spark, shared_dir(spark, "store"), buckets=1)
    A.plan(spark, sf)
    (validated, _), (acted, _) = at_once(
        [
            partial(store.freeze, T.LEARNERS_PIPELINE, "1", partial(A.validated_learners, spark, sf)),
            partial(store.freeze, T.ACTIVITY_PIPELINE, "1", partial(A.validated_activity, spark, sf)),
        ]
    )
    valid, rejected = split(validated)
    rejects = to_rejects(
        rejected, T.LEARNERS_PIPELINE, "source_record_id", T.LEARNER_INBOX, A.now()
    )
    entries = L.record_processed(valid, T.LEARNERS_PIPELINE, "source_record_id", F.lit("ok"), A.now())
    run = AC.process_validated_activity(acted, A.now())
    rolled = P.rollup(run.events)
    writes = {
        "learners": A.learners(spark, sf),
        "enrollments": A.enrollments(spark, sf),
        "topic_assignments": A.initial_progress(spark, sf),
        "learning_events": run.events,
        "progress_rollups": rolled.withColumn("event_batch", F.lit("1")),
        "processed_records": run.ledger.unionByName(entries),
        "rejected_records": rejects,
    }
    store.append_all("1", A.now(), **writes)
    # Ids that were refused once, for negative years, are corrected and accepted later.
    bad = (
        rejected.groupBy("source_record_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max(ERROR).alias("why"))
        .filter((F.col("n") == 1) & (F.col("why") == L.EXPERIENCE_NEGATIVE))
        .select("source_record_id")
    )
    settled = AU.resolutions(store.read("rejected_records"), bad, T.LEARNERS_PIPELINE, later())
    store.append("reject_resolutions", settled, "2", later())

    def first(condition: str, *order: str | Column) -> DataFrame:
        chosen = rolled.filter(condition).orderBy(*order, "enrollment_id", "topic_id").limit(1)
        hours = F.round(F.col("minutes").cast("decimal(20,6)") / 60, 2)
        return chosen.select(
            "enrollment_id",
            "topic_id",
            F.when(F.col("new_percent") >= 100, "COMPLETED").otherwise("IN_PROGRESS").alias("status"),
            F.col("new_percent").alias("percent"),
            hours.alias("hours"),
        )

    return C.acceptance_report(
        {
            "learners": store.read("learners"),
            "enrollments": store.read("enrollments"),
            "progress": store.read("topic_progress"),
            "ledger": store.read("processed_records"),
            "rejects": store.read("rejected_records"),
            "events": store.read("learning_events"),
        },
        A.people(spark, sf).filter("c_nationkey <> 24").select("employee_id", "path_id"),
        valid.select("source_record_id"),
        run.ledger.select("source_record_id"),
        bad,
        [
            (first("new_percent > 0", F.desc("new_percent")), "The topic furthest along shows its percentage and hours"),
            (first("new_percent > 0 and new_percent < 100"), "The first topic under way shows its percentage and hours"),
        ],
        35,
        {
            "TC-001": "All demo learners were registered",
            "TC-004": "Each demo learner has 35 initialized topics",
        },
    )


# --- Streams --------------------------------------------------------------------------------------


def _clock() -> datetime:
    return A.NOW


def _new_store(spark: SparkSession, sf: str, *tables: str) -> Store:
    """A fresh store with the reference tables and the named tables loaded."""
    store = Store(spark, shared_dir(spark, "store"), buckets=8)
    available = {
        "exam_domains": lambda: A.domains(spark, sf),
        "learning_paths": lambda: A.paths(spark),
        "path_topic_plan": lambda: A.plan(spark, sf).select(
            "*", A.now().alias("created_at"), A.now().alias("updated_at")
        ),
        "learners": lambda: A.learners(spark, sf),
        "enrollments": lambda: A.enrollments(spark, sf),
        "topic_progress": lambda: A.initial_progress(spark, sf),
    }
    # Derived tables that two of them share are stored first.
    rows = {name: available[name]() for name in tables}
    at_once([partial(store.load, name, df) for name, df in rows.items()])
    return store


def _ordered_csv(df: DataFrame, cols: list[str], folder: str) -> str:
    """An inbox whose files, taken in name order, keep the order of the row numbers.

    Rows that name the same learner lie within 17 rows of each other and come in one file: between files, the order of
    rows is not defined.
    """
    block = F.expr("source_row_number div 17")
    parts = df.repartitionByRange(block).sortWithinPartitions("source_row_number")
    return _write_inbox(parts, cols, folder)


@query
def stream_topics(spark, sf):
    store = _new_store(spark, sf, "exam_domains")
    inbox = _ordered_csv(A.topic_inbox(spark, sf), T.TOPIC_INBOX, f"{store.root}/inbox")
    jobs.run_topic_stream(
        spark, inbox, store, f"{store.root}/checkpoint", clock=_clock
    ).awaitTermination()
    return store.read("study_topics")


def _learner_stream(spark, sf):
    """The learner stream over the whole inbox, learners that repeat included, some ids accepted before."""
    store = _new_store(spark, sf, "learning_paths", "path_topic_plan")
    store.append("processed_records", A.learner_ledger(spark, sf), "earlier")
    inbox = _ordered_csv(A.learner_inbox(spark, sf), T.LEARNER_INBOX, f"{store.root}/inbox")

    def run() -> None:
        jobs.run_learner_stream(
            spark, inbox, store, f"{store.root}/checkpoint", clock=_clock
        ).awaitTermination()

    run()
    return store, run


@query
def stream_learners(spark, sf):
    store, _ = _learner_stream(spark, sf)
    assigned = store.read("topic_progress").groupBy("enrollment_id").agg(
        F.count(F.lit(1)).alias("assigned_topics")
    )
    return (
        store.read("learners")
        .join(store.read("enrollments").drop("created_at", "updated_at"), "learner_id")
        .join(assigned, "enrollment_id")
    )


def _activity_store(spark, sf):
    store = _new_store(spark, sf, "learners", "enrollments", "topic_progress")
    store.append("processed_records", A.activity_ledger(spark, sf), "earlier")
    folder = f"{store.root}/inbox"
    return store, _ordered_csv(A.activity_inbox(spark, sf), T.ACTIVITY_INBOX, folder)


@query
def stream_activity(spark, sf):
    store, inbox = _activity_store(spark, sf)
    jobs.run_activity_stream(
        spark, inbox, store, f"{store.root}/checkpoint", clock=_clock
    ).awaitTermination()
    return store.read("learning_events")


@query
def stream_progress(spark, sf):
    store = _new_store(spark, sf, "topic_progress")
    events = A.learning_events(spark, sf).drop("batch_day")
    before = F.col("event_id").endswith("7")
    store.append("learning_events", events.filter(before), "before-the-stream")
    jobs.begin_progress_stream(store, f"{store.root}/checkpoint")
    store.append("learning_events", events.filter(~before), "recorded-1")
    for _ in range(2):
        jobs.run_progress_stream(
            spark, store, f"{store.root}/checkpoint", clock=_clock
        ).awaitTermination()
    return store.read("topic_progress").drop("updated_at")


@query
def stream_chain(spark, sf):
    store, inbox = _activity_store(spark, sf)
    for _ in range(2):
        jobs.run_chain(spark, inbox, store, f"{store.root}/checkpoint", clock=_clock)
    return store.read("topic_progress").drop("updated_at")


@query
def trigger_if_data(spark, sf):
    """Two runs over one delivery: the second finds nothing and logs nothing."""
    store, run = _learner_stream(spark, sf)
    run()
    return store.read("pipeline_run_log").select(
        "pipeline_name", "run_status", "records_received", "records_accepted", "records_rejected",
        "run_message",
    )


@query
def progress_fold(spark, sf):
    return P.progress_fold(A.learning_events(spark, sf), "batch_day")


# --- Jobs -----------------------------------------------------------------------------------------


@query
def process_topics(spark, sf):
    run = TP.process_topics(
        A.topic_inbox(spark, sf), A.domains(spark, sf), empty_table(spark, T.TOPIC_SCHEMA), A.now()
    )
    return run.topics


@query
def register_learners(spark, sf):
    return L.register_learners(_calls(spark, sf), A.paths(spark), A.registered()).select(
        "source_row_number", "experience_level_code", "path_id", "target_completion_date",
        "registration_result",
    )


@query
def record_activity(spark, sf):
    events = AC.record_activity(_checked_calls(spark, sf), AC.new_event_id(), A.now())
    return events.select(
        F.length("event_id").cast("bigint").alias("event_id_length"),
        "enrollment_id", "topic_id", "event_type", "event_timestamp", "duration_minutes",
        "completion_percent", "event_source", "notes", "processed_at",
    )


@query
def process_events(spark, sf):
    return P.fold_progress(
        A.initial_progress(spark, sf), A.learning_events(spark, sf), later()
    )


@query
def process_learners(spark, sf):
    run = L.process_learners(
        A.learner_inbox(spark, sf),
        A.learner_ledger(spark, sf),
        empty_table(spark, T.LEARNER_SCHEMA),
        empty_table(spark, T.ENROLLMENT_SCHEMA),
        empty_table(spark, T.PROGRESS_SCHEMA),
        A.plan(spark, sf),
        A.paths(spark),
        A.registered(),
        A.now(),
    ).tables
    assigned = run.progress.groupBy("enrollment_id").agg(
        F.count(F.lit(1)).alias("assigned_topics")
    )
    return (
        run.learners.join(run.enrollments.drop("created_at", "updated_at"), "learner_id")
        .join(assigned, "enrollment_id")
    )


@query
def process_activity(spark, sf):
    return AC.process_activity(
        A.activity_inbox(spark, sf),
        A.activity_ledger(spark, sf),
        A.earlier_events(spark, sf),
        A.learners(spark, sf),
        A.enrollments(spark, sf),
        A.initial_progress(spark, sf),
        A.now(),
    ).events


# --- Control --------------------------------------------------------------------------------------


@query
def run_log(spark, sf):
    return reduce(
        DataFrame.unionByName,
        [
            AU.log_run(counts, name, F.lit("RUN_1"), A.now(), later())
            for name, counts in _run_counts(spark, sf).items()
        ],
    )


@query
def processed_ledger(spark, sf):
    rows = A.placed_learners(spark, sf)
    acts, _ = split(A.validated_activity(spark, sf))
    return L.record_processed(
        rows, T.LEARNERS_PIPELINE, "source_record_id", L.registration_text(), A.now()
    ).unionByName(
        L.record_processed(
            acts, T.ACTIVITY_PIPELINE, "activity_id", F.lit(AC.LEDGER_TEXT), A.now()
        )
    )


def _dated_rejects(spark, sf):
    """Learner rejects, dated by their position in the inbox."""
    moment = F.expr(
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, source_row_number % 1440, 0)"
    )
    _, rejected = split(A.validated_learners(spark, sf))
    return to_rejects(rejected, T.LEARNERS_PIPELINE, "source_record_id", T.LEARNER_INBOX, moment)


def _second_ledger(spark, sf):
    """Corrected ids, accepted at noon of the first day."""
    return A.learner_ledger(spark, sf).withColumn(
        "processed_at", F.expr("timestamp_ntz'2024-01-01 12:00:00'")
    )


@query
def reject_summary(spark, sf):
    return AU.reject_summary(
        AU.resolve_rejects(_dated_rejects(spark, sf), _second_ledger(spark, sf))
    )


@query
def resolve_rejects(spark, sf):
    resolved = AU.resolve_rejects(_dated_rejects(spark, sf), _second_ledger(spark, sf))
    return resolved.select(
        "source_record_id", "source_row_number", "rejected_at", "resolved_flag", "resolved_at"
    )
